"""Exact ranks and quantiles of a whole column without one task that holds it.

An approximate percentile brackets the value; only the distinct values inside the bracket, a fixed small share of the
rows, are ordered in one task (by key: in one task a key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The bracket reaches MARGIN of all rows and RANKS rows to both sides, more than the approximation can miss.
ACCURACY, MARGIN, RANKS = 100_000, 5e-5, 4


def _band(df: DataFrame, value: str, q: float) -> DataFrame:
    """(v, n, upto, total): distinct values around quantile q, their rows, and the rows up to and with them."""
    x = F.col(value)
    margin = MARGIN + RANKS / max(1, df.where(x.isNotNull()).count())
    edges = df.agg(*(F.percentile_approx(x, F.lit(min(1.0, max(0.0, q + s * margin))), F.lit(ACCURACY)).alias(n) for s, n in ((-1, "lo"), (1, "hi"))))
    one = df.where(x.isNotNull()).select(x.alias("v")).crossJoin(F.broadcast(edges))  # a single row
    at = F.when(F.col("v") < F.col("lo"), None).when(F.col("v") > F.col("hi"), None).otherwise(F.col("v"))
    # The nearest values outside are kept too, since a rank may fall between two values.
    counts = one.agg(F.count("*").alias("total"), F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"), F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("prev"), F.min(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("next"))
    inside = one.select(at.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ends = counts.select(F.explode(F.array(F.struct(F.col("prev").alias("v"), F.lit(0).cast("long").alias("n")), F.struct(F.col("next").alias("v"), F.lit(1).cast("long").alias("n")))).alias("e")).select("e.*").where("v is not null")
    upto = F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return inside.unionByName(ends).crossJoin(F.broadcast(counts)).select("v", "n", (upto + F.coalesce("below", F.lit(0))).alias("upto"), "total")


def quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    """One row with the quantile, linear between the two nearest ranks; null without values."""
    rank = F.lit(q) * (F.col("total") - 1)
    band = _band(df, value, q)
    low = F.min(F.when(F.col("upto") > F.floor(rank), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v")))
    part = F.max(rank - F.floor(rank))
    return band.agg((low + part * (high - low)).alias(out))


def cut_at_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (cut, rest): values below cut come first, and `rest` rows at cut complete int(share * rows)."""
    keep = F.floor(F.col("total") * share)
    band = _band(df, value, share).withColumn("keep", keep)
    hit = F.min(F.when(F.col("upto") >= F.col("keep"), F.struct("v", (F.col("keep") - (F.col("upto") - F.col("n"))).alias("rest"))))
    return band.agg(hit.alias("c")).select(F.col("c.v").alias("cut"), F.col("c.rest").alias("rest"))


def quantile_by(df: DataFrame, key: str, value: str, q: float, out: str) -> DataFrame:
    """(key, out): the quantile of each key's values, linear between the two nearest ranks; keys without values get none.

    A key may hold most rows: only the distinct values inside its bracket are ordered together."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    n = rows.groupBy("k").agg(F.count("*").alias("total"), F.percentile_approx("v", F.array(*(F.lit(min(1.0, max(0.0, q + s * MARGIN))) for s in (-1, 1))), F.lit(ACCURACY)).alias("edges"))
    # Few rows are all inside; of many, the bracket takes in RANKS rows more than the approximation can miss.
    lo, hi = (F.when(F.col("total") * MARGIN >= RANKS, F.get("edges", F.lit(i))) for i in (0, 1))
    edges = n.select("k", "total", lo.alias("lo"), hi.alias("hi"))
    placed = rows.join(edges, "k").withColumn("side", F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0))
    outside = placed.groupBy("k", "total").agg(F.sum((F.col("side") < 0).cast("long")).alias("below"), F.max(F.when(F.col("side") < 0, F.col("v"))).alias("prev"), F.min(F.when(F.col("side") > 0, F.col("v"))).alias("next"))
    inside = placed.where("side = 0").groupBy("k", "v").agg(F.count("*").alias("n"))
    ends = outside.select("k", F.explode(F.array(F.struct(F.col("prev").alias("v"), F.lit(0).cast("long").alias("n")), F.struct(F.col("next").alias("v"), F.lit(1).cast("long").alias("n")))).alias("e")).select("k", "e.*").where("v is not null")
    upto = F.sum("n").over(W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    band = inside.unionByName(ends).join(outside.select("k", "total", "below"), "k").select("k", "v", "total", (upto + F.col("below")).alias("upto"))
    rank = F.lit(q) * (F.col("total") - 1)
    found = band.groupBy("k").agg(F.min(F.when(F.col("upto") > F.floor(rank), F.col("v"))).alias("low"), F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v"))).alias("high"), F.max(rank - F.floor(rank)).alias("part"))
    return found.select(F.col("k").alias(key), (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias(out))
