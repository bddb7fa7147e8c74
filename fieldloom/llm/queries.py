"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, cover_tree, impact_index, jaccard_join, line_dedup, mixing, mpegts, packing, suffix_dedup, suffix_tree_lm, toxicity, url_filter
from .common import bytes_of, residue, table, tuned


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", bytes_of("text").alias("raw"))
    n = F.length("raw")
    size = F.greatest(F.lit(64), F.ceil(n / 64) * 64).cast("int")
    padded = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.expr("rpad(raw, int(greatest(64, ceil(length(raw) / 64) * 64)), X'00')").alias("payload"), size.alias("want"))
    read = mpegts.from_media(mpegts.to_media(padded, "payload"), "media").select("doc_id", "n_bytes", "report")
    r = F.col("report")
    stamps = F.transform(r["units"], lambda u: F.concat_ws("@", u["pts"], u["offset"], u["random_access"].cast("int")))
    return read.select(
        "doc_id", "n_bytes",
        F.length(r["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(r["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(r["payload"], -64, 64)).alias("tail_crc32"),
        r["media_bytes"].alias("media_bytes"), r["media_sha256"].alias("media_sha256"),
        F.concat_ws(";", F.concat_ws("=", F.lit("packets"), r["packets"]), F.concat_ws("=", F.lit("programs"), r["programs"]), F.concat_ws("=", F.lit("streams"), r["streams"]), F.concat_ws("=", F.lit("continuity_errors"), r["continuity_errors"]), F.concat_ws("=", F.lit("crc_errors"), r["crc_errors"]), F.concat(F.lit("units="), F.concat_ws(",", stamps))).alias("feature"),
        F.size(r["units"]).alias("n_units"), r["continuity_errors"].alias("continuity_errors"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_tree.vectors(table(tuned(spark), sf_dir, "embeddings"), "vec_id", "embedding")
    return cover_tree.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
  from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from s qualify rank <= 10
"""


def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_size(table(tuned(spark), sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return mixing.mix(docs)


def op5_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = url_filter.with_rule(url_filter.with_parts(table(tuned(spark), sf_dir, "pages").select("page_id", "url")))
    model = url_filter.fit(ruled, label_col="by_rule")
    judged = model.judge(ruled, out="by_model")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_model").alias("verdict"), "by_model")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.classes(docs, words=3, percent=90).drop("row", "is_first")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return suffix_tree_lm.score(docs, residue(F.col("doc_id"), 7) != 2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(bytes_of("text"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(residue(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), offending_col="offending").drop("text")
    return scored.select("doc_id", (residue(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = impact_index.build(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"))
    return impact_index.search(index, table(spark, sf_dir, "benchmark"), k=50)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mpegts, op2_suffix_dedup, op3_cover_tree, op4_entropy_balancing, op5_url_gbt, op6_jaccard_join, op7_bpe, op8_suffix_tree, op9_line_dedup, op10_toxicity, op11_alignment, op12_impact_search, op13_packing)}
#: What the rules decide of op5; the verdict of the other urls is learnt.
OP5_RULES_SQL = r"""
with p as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') as h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages
), q as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p
), r(rule, rule_host, rule_path, verdict) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
)
select page_id, host, path, arg_max(rule, len(rule)) as rule, arg_max(r.verdict, len(rule)) as by_rule
from q left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id, host, path
"""

ORACLES: dict[str, str] = {"op3_cover_tree": OP3_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op12_impact_search": impact_index.ORACLE_SQL}
