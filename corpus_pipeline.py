"""The corpus pipeline: toxicity filter, line dedup, n-gram Jaccard dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; the last returns the tokens of what the mix takes. `run` deletes a stage's scratch files once the stage's
result is written. Null and empty texts pass all stages: they are not toxic, have no lines to delete and no near copies,
and take no words and no tokens. Ids may be null or repeat: each row is a document of its own, and rows that agree in
id and text get the same decisions, but for the mix, which takes each of them as often as their source needs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from fieldloom.llm.common import bytes_of, release, scratch, stored, table, tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below 0.5."""
    model = toxicity.fit(docs, table(tuned(spark), sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score").where("_score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 50 words or more; a text that changes gets its new n_chars."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each class of similarity 0.8 or more over five-word n-grams."""
    tuned(spark)
    return jaccard_join.keep_one(docs, words=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents with rate below 1 may go, others come up to three times."""
    taken = mixing.mix(mixing.with_size(docs), carry=COLUMNS)
    return taken.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each document, and whether its ids decode to its text."""
    tuned(spark)
    ranks = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    digest = lambda col: F.sha2(col, 256)
    keyed = docs.select("doc_id", "source", "text", digest(bytes_of("text")).alias("digest"))
    encoded = bpe.decode(bpe.encode(keyed, ranks, public_tokenizers.PATTERN), ranks)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (digest("decoded") == F.col("digest")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("byte-level BPE", tokenize)]

#: SQL can't express the learned filter and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(tuned(spark), sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch() as made:
            kept = stage(spark, docs, sf_dir)
        with scratch() as result:
            docs = stored(kept)
        release(spark, made + written)
        written = result
    return STAGES[-1][1](spark, docs, sf_dir)
