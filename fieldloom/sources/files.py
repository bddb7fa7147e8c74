"""Tables in and out: CSV ledgers, with types if wanted, and monthly tables. Scenes, tiles and shapefiles have modules of their own."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_ledger(spark: SparkSession, path: str, columns: Iterable[str] = ()) -> DataFrame:
    """A CSV with a header; every column is text, so an id such as 12.0 or 007 stays as it is."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(*columns) if columns else df


def write_ledger(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.csv(path, header=True, mode=mode)


def write_months(df: DataFrame, path: str) -> None:
    """Parquet by month; only the months in df are replaced, so a run can be taken up again."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("month").mode("overwrite").parquet(path)


def missing_months(spark: SparkSession, path: str, months: Iterable[int]) -> list[int]:
    """Months that path has no rows of yet."""
    try:
        have = {r["month"] for r in spark.read.parquet(path).select("month").distinct().collect()}  # a row for each month
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = set()
    return [m for m in months if m not in have]


def find_months(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(month, path, bytes) of the files under path named {name}{month}.csv, by number: out_4 comes before out_10. Empty files and
    names whose rest isn't a number are left out. Files are listed, not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*.csv").option("recursiveFileLookup", "true").load(path).select("path", "length")
    digits = F.regexp_extract("path", re.escape(name) + r"([0-9]+)\.csv$", 1)
    found = listed.where((digits != "") & (F.col("length") > 0))
    return found.select(digits.cast("int").alias("month"), "path", F.col("length").alias("bytes")).orderBy("month", "path")


def typed(df: DataFrame, keep: Iterable[str] = ("parcel_id",)) -> DataFrame:
    """A table of texts with the narrowest type that holds each column: boolean, long, double, else text; a column without values is
    text. Blanks are null. One aggregate over all columns; columns in `keep` stay text."""
    names = [c for c in df.columns if c not in set(keep)]
    if not names:
        return df
    clean = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    fits = {"boolean": lambda v: F.lower(v).isin("true", "false"), "bigint": lambda v: v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(), "double": lambda v: v.try_cast("double").isNotNull()}
    counts = df.agg(*(F.count(clean(c)).alias(f"n{i}") for i, c in enumerate(names)), *(F.count_if(F.coalesce(f(clean(c)), F.lit(False))).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in fits.items())).first()
    kinds = {c: next((k for k in fits if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), "string") for i, c in enumerate(names)}
    return df.select(*((clean(c).cast(kinds[c]) if kinds[c] != "string" else clean(c)).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


def read_typed(spark: SparkSession, path: str, keep: Iterable[str] = ("parcel_id",)) -> DataFrame:
    """A ledger with inferred types."""
    return typed(read_ledger(spark, path), keep)


def read_months(spark: SparkSession, path: str, name: str, keep: Iterable[str] = ("parcel_id",)) -> DataFrame:
    """The ledgers of all months that `find_months` finds, by column name: (month, ...) with types over all of them. A column that
    a month lacks is null there. FileNotFoundError without any."""
    months = find_months(spark, path, name).collect()  # a row for each file
    if not months:
        raise FileNotFoundError(f"no {name}*.csv with rows in {path}")
    parts = [read_ledger(spark, r["path"]).withColumn("month", F.lit(r["month"])) for r in months]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    rest = [c for c in whole.columns if c != "month"]
    return typed(whole, [*keep, "month"]).select("month", *(F.col(f"`{c}`") for c in rest))
