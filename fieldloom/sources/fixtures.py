"""Parcel inputs derived from the star schema: pixels, parcels, scenes, ids, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONTHS = (4, 5, 6, 7, 8, 9, 10)
_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bands() -> dict[str, F.Column]:
    d = lambda c: F.col(c).cast("double")
    valid = d("l_quantity") != 50
    of = {"blue": 200 + d("l_tax") * 10000, "green": 300 + d("l_discount") * 8000, "red": 400 + d("l_quantity") * 40, "nir": 500 + d("l_extendedprice") / 20}
    return {k: F.when(valid, v).otherwise(0.0) for k, v in of.items()}


def pixels(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """(parcel_id, month, blue, green, red, nir); key l_partkey gives sparse parcels."""
    rows = read(spark, sf_dir, "lineitem").where(F.month("l_shipdate").between(4, 10))
    return rows.select(F.col(key).cast("string").alias("parcel_id"), F.month("l_shipdate").alias("month"), *(v.alias(k) for k, v in _bands().items()))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping scenes of one 8 x 8 raster: (scene, month, y, x, bands)."""
    cell = F.col("l_partkey") % 64
    rows = read(spark, sf_dir, "lineitem").where(F.month("l_shipdate").between(4, 10))
    return rows.select(F.year("l_shipdate").alias("scene"), F.month("l_shipdate").alias("month"), F.floor(cell / 8).cast("int").alias("y"), (cell % 8).cast("int").alias("x"), *(v.alias(k) for k, v in _bands().items()))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a place in an 8 column raster of their parcel and month."""
    rows = read(spark, sf_dir, "lineitem").where(F.month("l_shipdate").between(4, 10)).withColumn("month", F.month("l_shipdate"))
    rn = F.row_number().over(W.partitionBy("l_suppkey", "month").orderBy(*_ORDER)) - 1
    return rows.withColumn("rn", rn).select(F.col("l_suppkey").cast("string").alias("parcel_id"), "month", F.floor(F.col("rn") / 8).cast("int").alias("y"), (F.col("rn") % 8).cast("int").alias("x"), *(v.alias(k) for k, v in _bands().items()))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 32) * 10 + 1, F.floor(k / 32) * 10 + 1
    return read(spark, sf_dir, "supplier").select(k.cast("string").alias("parcel_id"), (F.col("s_nationkey") % 10).cast("int").alias("g10_cls_id"), *(c.cast("double").alias(n) for n, c in (("minx", x), ("miny", y), ("maxx", x + 8), ("maxy", y + 8))))


def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k % 5) * 70, F.floor(k / 5) * 70
    return read(spark, sf_dir, "nation").select(k.cast("int").alias("scene"), *(c.cast("double").alias(n) for n, c in (("minx", x), ("miny", y), ("maxx", x + 80), ("maxy", y + 80))))


def dirty_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    text = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(".0"))).when(k == 2, F.concat(F.lit(" "), s, F.lit(".0"))).otherwise(F.concat(s, F.lit("\t")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("raw_id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("parcel_id"), (F.col("s_suppkey") % 4).cast("int").alias("label"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel_id, mse)"""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("parcel_id"), (F.exp(F.col("c_acctbal").cast("double") / 4000) / 10).alias("mse"))


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel_id, p0, p1, p2)"""
    k = F.col("c_custkey")
    a, b, c = 1 + k % 7, 1 + (k * 3) % 11, 1 + (k * 5) % 13
    total = (a + b + c).cast("double")
    return read(spark, sf_dir, "customer").select(k.cast("string").alias("parcel_id"), *((x / total).alias(f"p{i}") for i, x in enumerate((a, b, c))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
