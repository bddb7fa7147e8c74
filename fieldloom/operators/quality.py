"""A quality score for each parcel and month."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip_quality, month_weight

#: Indices whose presence and spread count.
MEANS = ("NDVI", "EVI", "GCVI", "SAVI", "NDWI")


def quality(stats: DataFrame, months: tuple[int, ...], weights: Mapping[int, float], least: float = 0.05) -> DataFrame:
    """(parcel_id, month, quality) of zonal statistics on a full spine of months, in order.

    Half is the share of valid pixels, a quarter each completeness and low spread; inner months are weighed down where
    NDVI leaves its neighbours' mean. Missing components count as 1."""
    def mean_of(cells):
        have = F.filter(F.array(*cells), lambda x: x.isNotNull())
        return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have))

    def median_of(cells):
        s = F.array_sort(F.filter(F.array(*cells), lambda x: x.isNotNull()))
        n = F.size(s)
        return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)

    clip = lambda c: clip_quality(c, least)
    valid = mean_of([F.col(c) for c in stats.columns if c.endswith("_valid_ratio")])
    missing = sum((F.col(f"{k}_mean").isNull().cast("double") for k in MEANS), F.lit(0.0)) / len(MEANS)
    spread = median_of([F.col(f"{k}_cv") for k in MEANS])
    spread = 1 / (1 + F.when(spread.isNotNull(), F.least(F.greatest(spread, F.lit(0.0)), F.lit(3.0))))
    base = clip(month_weight(F.col("month"), weights) * (0.5 * clip(valid) + 0.25 * clip(1 - missing) + 0.25 * clip(spread)))
    w = W.partitionBy("parcel_id").orderBy("month")
    near = mean_of([F.lag("NDVI_mean").over(w), F.lead("NDVI_mean").over(w)])
    inner = F.col("month").isin(*months[1:-1])
    placed = stats.withColumn("_near", near)
    jump = F.abs(F.col("NDVI_mean") - F.col("_near"))
    smooth = F.when(jump.isNull(), 1.0).otherwise(1 / (1 + F.least(jump / 0.25, F.lit(4.0))))
    return placed.select("parcel_id", "month", clip(F.when(inner, base * clip(smooth)).otherwise(base)).alias("quality"))
