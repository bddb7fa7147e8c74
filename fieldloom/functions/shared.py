"""Tables in the folder that the whole cluster shares, which cut the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tasks that sum what all others have summed, where these are more, before the driver does.
SUMS = 16

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master gets a temporary folder where it is unset; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes in the block are deleted after it."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again. Outside `scratch` the table stays until the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], kind: type = np.float64) -> np.ndarray | None:
    """The sum of the flat arrays that `part` makes of df's batches, None without rows. Summed in tasks, then by SUMS tasks where there
    are more, and only their sums reach the driver."""

    def total(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = None
        for a in arrays:
            found = a if found is None else found + a
        if found is not None:
            yield pa.RecordBatch.from_pydict({"total": [found.astype(kind).tobytes()]})

    sums = df.mapInArrow(lambda it: total(part(b) for b in it if b.num_rows), "total binary")
    if df.rdd.getNumPartitions() > SUMS:
        sums = sums.repartition(SUMS).mapInArrow(lambda it: total(np.frombuffer(v, kind) for b in it for v in b.column("total").to_pylist()), "total binary")
    found = [np.frombuffer(r["total"], kind) for r in sums.collect()]  # at most SUMS rows
    return sum(found[1:], found[0]) if found else None
