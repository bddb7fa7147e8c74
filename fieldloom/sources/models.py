"""Fitted parameters as versioned tables: `save` publishes a new version at once, `load` reads one."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    system, at = _fs(spark, path)
    if not system.exists(at):
        return []
    return sorted(int(m[1]) for s in system.listStatus(at) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName())))


def save(parts: dict[str, DataFrame], path: str) -> int:
    """Writes named tables as the next version and gives its number. Readers see all of a version or nothing: the tables are written
    beside it and one rename publishes them; if another writer took the number meanwhile, the next one is tried."""
    spark = next(iter(parts.values())).sparkSession
    temporary = f"{path}/.{uuid.uuid4().hex}"
    try:
        for name, df in parts.items():
            df.write.parquet(f"{temporary}/{name}")
        system, source = _fs(spark, temporary)
        n = max(versions(spark, path), default=0) + 1
        while True:
            _, target = _fs(spark, f"{path}/v{n}")
            if not system.exists(target) and system.rename(source, target):
                return n
            if not system.exists(target):
                raise OSError(f"{target} can't be published")
            n += 1
    finally:
        system, source = _fs(spark, temporary)
        system.delete(source, True)


def load(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, of the newest if none is named; FileNotFoundError if there is none."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no {'version ' + str(version) if version else 'model'} in {path}: it must be fitted and saved first")
    return spark.read.parquet(f"{path}/v{version or have[-1]}/{name}")
