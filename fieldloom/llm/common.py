"""Session helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds what one Arrow batch of whole texts can hold in a Python worker, and what a plan's text takes in a log."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.maxPlanStringLength", "16384")
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written in the block has Arrow batches of up to so many rows, still of at most BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, as in tests, gets a temporary one where none is set; elsewhere
    that is an error, since other machines wouldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that `stored` writes in the block. Whoever has written what is built on them may `release` them; frames
    made elsewhere are never touched. What nobody releases goes when the application ends."""
    made: list[str] = []
    before = _folders.set(made)
    try:
        yield made
    finally:
        _folders.reset(before)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again. The write's shuffle files go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    if (made := _folders.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, made: list[str]) -> None:
    """Deletes folders that a `scratch` block has listed. Frames that are built on them are lost."""
    while made:
        system, where = _at(spark, made.pop())
        system.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(text: str | Column) -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def lower_ascii(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo modulus."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
