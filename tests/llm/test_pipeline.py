"""The pipeline's stages on the smallest tables, each against its own input."""

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from fieldloom.llm import bpe

from .test_operators import SF, jaccard_classes


def through(spark, docs, folder):
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
    return seen


def test_stages(spark, tmp_path):
    seen = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    for df in seen[:-1]:
        assert tuple(df.columns) == P.COLUMNS
    clean, lines, single, mixed, tokens = seen
    assert 0.8 * 200 < clean.count() < 200
    assert lines.count() == clean.count()
    rows = {r["doc_id"]: r["text"] for r in lines.collect()}
    ids = sorted(rows)
    classes = jaccard_classes([rows[i] for i in ids], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for k, i in enumerate(ids) if classes[k][1] == k}
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in tokens.collect():
        assert list(r["ids"]) == own.encode_ordinary(rows[r["doc_id"]]) and r["round_trip"]


def test_empty_table(spark, tmp_path):
    assert through(spark, spark.read.parquet(f"{SF}/documents.parquet").where("false"), tmp_path)[-1].count() == 0


def test_run(spark):
    assert P.run(spark, SF).where("round_trip").count() > 100
