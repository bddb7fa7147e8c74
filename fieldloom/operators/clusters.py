"""Clusters of parcels: distances, cores, profiles, names; fitted models by Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_by

#: Names that the rules give, in order of precedence.
BARE, ORCHARD, CASH, WEAK = "撂荒与裸地", "果树与林地", "经济作物", "长势衰弱主粮"


def centroids(points: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, center): means of each component."""
    cells = points.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"])
    return cells.groupBy(cluster).agg(ordered.alias("center"))


def distances(points: DataFrame, centers: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Adds the distance to the centre of each point's cluster."""
    square = F.zip_with(vector, "center", lambda a, b: (a - b) * (a - b))
    return points.join(centers, cluster).withColumn("distance", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))).drop("center")


def cores(measured: DataFrame, cluster: str, share: float = 0.3) -> DataFrame:
    """Adds is_core: 1 up to the cluster's `share` quantile of distance."""
    cut = quantile_by(measured, cluster, "distance", share, "cut")
    return measured.join(cut, cluster).withColumn("is_core", (F.col("distance") <= F.col("cut")).cast("int")).drop("cut")


def profiles(panel: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature by cluster and month, and the cluster's rows."""
    return panel.groupBy("cluster", "month").agg(*(F.avg(f).alias(f) for f in features), F.count("*").alias("n"))


def name_clusters(profile: DataFrame, all_texture: DataFrame) -> DataFrame:
    """(cluster, label): rules on a cluster's mean curve (cluster, month, ndvi, glcm); later clusters of one name get a
    number. all_texture: one row (all_tex)."""
    per = profile.groupBy("cluster").agg(F.max(F.when(F.col("month").between(5, 9), F.col("ndvi"))).alias("peak"), F.max(F.when(F.col("month") == 4, F.col("ndvi"))).alias("spring"), F.stddev_pop("ndvi").alias("sd"), F.avg("glcm").alias("tex"))
    one = per.crossJoin(F.broadcast(all_texture))
    name = (
        F.when(F.col("peak") < 0.55, BARE).when((F.col("spring") >= 0.18) & (F.col("sd") < 0.20) & (F.col("tex") > F.col("all_tex")), ORCHARD)
        .when((F.col("peak") >= 0.60) & (F.col("tex") < F.col("all_tex")), CASH).otherwise(WEAK)
    )
    n = F.row_number().over(W.partitionBy("name").orderBy("cluster")) - 1
    return one.select("cluster", name.alias("name")).withColumn("n", n).select("cluster", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_亚种"), F.col("n").cast("string"))).alias("label"))


def standardised(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) with each component less its mean, over its population deviation; deviation 0 divides by 1."""
    cells = points.select(key, F.posexplode(vector).alias("i", "x"))
    stats = cells.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scaled = cells.join(F.broadcast(stats), "i").select(key, "i", ((F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("x"))
    return scaled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias(vector))


def kmeans(points: DataFrame, vector: str, k: int = 4, seed: int = 42, starts: int = 10) -> DataFrame:
    """Adds cluster by the cheapest of `starts` runs."""
    rows = points.withColumn("features", array_to_vector(vector))
    models = (KMeans(k=k, seed=seed + i).fit(rows) for i in range(starts))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).withColumnRenamed("prediction", "cluster").drop("features")
