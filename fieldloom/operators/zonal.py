"""Zonal statistics per parcel and month, composites, and panel assembly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import RANGES, VEGETATION
from ..functions.quantiles import quantile_by

#: Fewer valid pixels than this have no statistics.
SUPPORT = 3
INDICES = tuple(RANGES)


#: Pixels of a group whose percentiles are one task's map of values; larger groups are spread over tasks.
LARGE = 1_000_000


def _grouped(indexed: DataFrame, indices: list[str], quantiles: dict[str, tuple[float, ...]], moments: bool) -> DataFrame:
    """(parcel_id, month, total, and for each index n_, mean_, sd_, skew_ and kurt_ if moments, q_: array of its quantiles). One shuffle
    by (parcel_id, month), unless groups of more than LARGE pixels exist: their quantiles, equally exact, come from brackets of values
    that many tasks count."""
    key = ["parcel_id", "month"]

    def basic(k: str) -> list[Column]:
        c = F.col(k)
        more = [F.skewness(c).alias(f"skew_{k}"), F.kurtosis(c).alias(f"kurt_{k}")] if moments else []
        return [F.count(c).alias(f"n_{k}"), F.avg(c).alias(f"mean_{k}"), F.stddev_pop(c).alias(f"sd_{k}"), *more]

    at_once = lambda k: F.percentile(F.col(k), F.array(*map(F.lit, quantiles[k]))).alias(f"q_{k}")
    plain = [c for k in indices for c in basic(k)]
    large = indexed.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select(*key)
    whole = lambda df: df.groupBy(*key).agg(F.count("*").alias("total"), *plain, *map(at_once, indices))
    if large.isEmpty():
        return whole(indexed)
    spread = indexed.join(large, key, "left_semi")
    cells = spread.select(F.to_json(F.struct(*key)).alias("group"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in indices))).alias("c")).select(F.concat_ws("|", "c.k", "group").alias("cell"), "c.v")
    found = None
    for q in sorted({q for k in indices for q in quantiles[k]}):
        one = quantile_by(cells, "cell", "v", q, f"q{q}")
        found = one if found is None else found.join(one, "cell")
    parts = F.split("cell", r"\|", 2)
    named = found.withColumn("k", parts[0]).withColumn("g", F.from_json(parts[1], indexed.select(*key).schema))
    lists = named.groupBy("g.parcel_id", "g.month").agg(*(F.max(F.when(F.col("k") == k, F.array(*(F.col(f"`q{q}`") for q in quantiles[k])))).alias(f"q_{k}") for k in indices))
    counted = spread.groupBy(*key).agg(F.count("*").alias("total"), *plain).join(lists, key, "left")
    rest = whole(indexed.join(large, key, "left_anti"))
    return rest.unionByName(counted.select(*rest.columns))


def _cv(k: str, signed: bool) -> Column:
    mean = F.col(f"mean_{k}")
    return F.when(F.abs(mean) <= 1e-6, 0.0).otherwise(F.col(f"sd_{k}") / (mean if signed else F.abs(mean)))


def zonal_stats(indexed: DataFrame, indices: Iterable[str] = INDICES) -> DataFrame:
    """Nine statistics of each index; null below SUPPORT valid pixels."""
    indices = list(indices)
    raw = _grouped(indexed, indices, dict.fromkeys(indices, (0.25, 0.5, 0.75)), moments=True)
    out = []
    for k in indices:
        n, q = F.col(f"n_{k}"), F.col(f"q_{k}")
        stats = {"mean": F.col(f"mean_{k}"), "median": F.get(q, F.lit(1)), "cv": _cv(k, False), "skew": F.coalesce(f"skew_{k}", F.lit(0.0)), "kurt": F.coalesce(f"kurt_{k}", F.lit(0.0)), "q25": F.get(q, F.lit(0)), "q75": F.get(q, F.lit(2))}
        out += [F.when(n >= SUPPORT, v).alias(f"{k}_{s}") for s, v in stats.items()]
        out += [n.alias(f"{k}_valid_count"), F.coalesce(F.try_divide(n.cast("double"), F.col("total")), F.lit(0.0)).alias(f"{k}_valid_ratio")]
    return raw.select("parcel_id", "month", *out)


def tail_stats(indexed: DataFrame) -> DataFrame:
    """Mean, median, signed cv and two tail quantiles of raw indices; 0 below SUPPORT valid pixels."""
    tails = {k: (0.05, 0.10) if k in VEGETATION else (0.90, 0.95) for k in INDICES}
    raw = _grouped(indexed, list(INDICES), {k: (*t, 0.5) for k, t in tails.items()}, moments=False)
    out = []
    for k in INDICES:
        q = lambda i, k=k: F.get(F.col(f"q_{k}"), F.lit(i))
        stats = {"mean": F.col(f"mean_{k}"), "median": q(2), "cv": _cv(k, True), **{f"q{round(100 * t):02d}": q(i) for i, t in enumerate(tails[k])}}
        out += [F.when(F.col(f"n_{k}") >= SUPPORT, v).otherwise(0.0).alias(f"{k}_{s}") for s, v in stats.items()]
    return raw.select("parcel_id", "month", *out)


def composite(scenes: DataFrame, bands: Iterable[str] = INDICES) -> DataFrame:
    """The highest value of each band among overlapping scenes."""
    return scenes.groupBy("month", "y", "x").agg(*(F.max(b).alias(b) for b in bands))


def spine(df: DataFrame, months: Iterable[int]) -> DataFrame:
    """Each parcel in each month; months that a parcel lacks are null. A join with the parcels' ids: columns that nobody asks for are
    still left out of df, which packing its rows by parcel would prevent (measured: twice the time for `m24_w04_quality`)."""
    keys = df.select("parcel_id").distinct().withColumn("month", F.explode(F.array(*map(F.lit, months))))
    return keys.join(df, ["parcel_id", "month"], "left")


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The first row of each key, by order."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def wide(df: DataFrame, features: Iterable[str], months: Iterable[int]) -> DataFrame:
    """One row for each parcel, columns {feature}_M{month}."""
    return df.groupBy("parcel_id").agg(*(F.max(F.when(F.col("month") == m, F.col(f))).alias(f"{f}_M{m}") for m in months for f in features))


def long(df: DataFrame, features: Iterable[str], months: Iterable[int]) -> DataFrame:
    """The reverse of wide; absent cells are 0."""
    cells = F.array(*(F.struct(F.lit(m).alias("month"), *(F.coalesce(F.col(f"{f}_M{m}"), F.lit(0.0)).alias(f) for f in features)) for m in months))
    return df.select("parcel_id", F.explode(cells).alias("c")).select("parcel_id", "c.*")


def delta_calendar(df: DataFrame, value: str, months: Iterable[int], out: str = "delta_NDVI") -> DataFrame:
    """Value less that of the calendar month before: 0 if no parcel has that month, null if this parcel lacks it."""
    loaded = F.array(*map(F.lit, months))
    w = W.partitionBy("parcel_id").orderBy("month")
    before = F.when(F.lag("month").over(w) == F.col("month") - 1, F.lag(value).over(w))
    return df.withColumn(out, F.when(F.array_contains(loaded, F.col("month") - 1), F.col(value) - before).otherwise(0.0))


def impute_median(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Nulls become the month's median of the feature, 0 if it has none. The medians are one row for each month."""
    features = list(features)
    cells = df.select(F.explode(F.array(*(F.struct(F.concat_ws(" ", F.lit(i), "month").alias("cell"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)))).alias("c")).select("c.*")
    med = quantile_by(cells, "cell", "v", 0.5, "median").withColumns({"_i": F.split("cell", " ")[0].cast("int"), "month": F.split("cell", " ")[1].cast("int")})
    by_month = med.groupBy("month").agg(*(F.max(F.when(F.col("_i") == i, F.col("median"))).alias(f"_{f}") for i, f in enumerate(features)))
    return df.join(F.broadcast(by_month), "month", "left").select("parcel_id", "month", *(F.coalesce(f, f"_{f}", F.lit(0.0)).alias(f) for f in features))


def zscores(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Standard scores over all rows with population deviations; a deviation of 0 counts as 1e-8."""
    features = list(features)
    stats = df.agg(*(s for f in features for s in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))))
    one = df.crossJoin(F.broadcast(stats))  # a single row
    return one.select("parcel_id", "month", *(((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1e-8).otherwise(F.col(f"_s_{f}"))).alias(f) for f in features))


def tensor(df: DataFrame, features: Iterable[str], months: Iterable[int]) -> DataFrame:
    """(parcel_id, t): arrays of features in order, by month in order; absent months are 0."""
    features = list(features)
    row = F.array(*(F.coalesce(F.col(f), F.lit(0.0)) for f in features))
    by_month = [F.coalesce(F.max(F.when(F.col("month") == m, row)), F.array(*[F.lit(0.0)] * len(features))) for m in months]
    return df.groupBy("parcel_id").agg(F.array(*by_month).alias("t"))


def mutation(df: DataFrame, values: Iterable[str], months: Iterable[int]) -> DataFrame:
    """Change of each value since the month before in `months`, on a spine where absent months are 0."""
    values = list(values)
    w = W.partitionBy("parcel_id").orderBy("month")
    filled = spine(df, months).fillna(0.0, values)
    return filled.select("parcel_id", "month", *(c for v in values for c in (F.col(v), (F.col(v) - F.lag(v).over(w)).alias(f"delta_{v}"))))


def extremes(changed: DataFrame) -> DataFrame:
    return changed.groupBy("parcel_id").agg(F.max("delta_UBI_q95").alias("MAX_JUMP_UBI"), F.max("delta_NDWI_q95").alias("MAX_JUMP_NDWI"), F.min("delta_NDVI_q05").alias("MAX_DROP_NDVI"))
