"""Scores and routing of parcels: reconstruction error, threshold, confidence, physical veto, reasons, ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import round4
from ..functions.quantiles import cut_at_rank, quantile


@dataclass(frozen=True)
class Routing:
    safe_floor: float = 0.80
    veto_confidence: float = 0.65
    peak_max: float = 0.55
    spring_min: float = 0.18
    std_max: float = 0.20
    texture_ratio: float = 1.0


def weighted_mse(errors: DataFrame, n_features: int) -> DataFrame:
    """errors: (parcel_id, month, quality, sq): squared errors summed over features. Quality-weighted mean per parcel."""
    return errors.groupBy("parcel_id").agg((F.sum(F.col("quality") * F.col("sq")) / (F.sum("quality") * n_features + 1e-8)).alias("mse"))


def kernel_density(scores: DataFrame, points: int = 500) -> DataFrame:
    """Gaussian density of mse strictly below its 98th percentile, on an even grid: (k, x, density).

    Each value adds to each grid point within its own task; only a task's `points` sums are shuffled, so the density is exact at all
    sizes and its cost grows with the values."""
    top = quantile(scores, "mse", 0.98, "p98")
    below = scores.crossJoin(F.broadcast(top)).where("mse < p98").select("mse")
    stats = below.agg(F.min("mse").alias("lo"), F.max("mse").alias("hi"), F.stddev_samp("mse").alias("sd"), F.count("*").alias("n")).where("n > 0")
    step = (F.col("hi") - F.col("lo"))
    grid = below.crossJoin(F.broadcast(stats)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # stats: a single row
    x = F.col("lo") + step * F.col("k") / (points - 1)
    width = F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd")
    u = (x - F.col("mse")) / width
    return grid.groupBy("k").agg(F.first(x).alias("x"), (F.sum(F.exp(-0.5 * u * u)) / F.first(width * F.col("n")) / 2.5066282746310002).alias("density"))


def histogram(scores: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, lo, hi, n) of mse up to its 98th percentile, in even bins between the least and the greatest; the last one holds its upper
    edge. If all values are equal they are in the first."""
    kept = scores.crossJoin(F.broadcast(quantile(scores, "mse", 0.98, "p98"))).where("mse <= p98").select("mse")
    ends = kept.agg(F.min("mse").alias("a"), F.max("mse").alias("b")).where("a is not null")  # a single row
    cell = F.coalesce(F.least(F.floor((F.col("mse") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = kept.crossJoin(F.broadcast(ends)).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))
    edges = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins
    return edges.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def knee(density: DataFrame) -> DataFrame:
    """(threshold): after the peak, the grid point farthest from the chord to the last point; the first if tied. The grid, which has a
    fixed number of points, becomes one row, so the density is computed once."""
    one = density.agg(F.array_sort(F.collect_list(F.struct("k", "x", "density"))).alias("g"))
    peak = F.array_min(F.transform("g", lambda p: F.struct((-p["density"]).alias("d"), p["k"].alias("k"))))["k"]
    tail = one.withColumn("pk", peak).withColumn("t", F.filter("g", lambda p: p["k"] >= F.col("pk")))
    first, last = F.get("t", F.lit(0)), F.element_at("t", -1)
    ends = tail.where(F.size("t") > 0).withColumns({"x1": first["x"], "y1": first["density"], "x2": last["x"], "y2": last["density"]})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    far = lambda p: F.abs(dx * (p["density"] - F.col("y1")) - dy * (p["x"] - F.col("x1"))) / (F.sqrt(dx * dx + dy * dy) + 1e-8)
    best = F.array_min(F.transform("t", lambda p: F.struct((-F.round(far(p), 9)).alias("f"), p["k"].alias("k"), p["x"].alias("x"))))["x"]
    return ends.select(best.alias("threshold"))


def confidence(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """Adds threshold and p, the sigmoid confidence that a parcel is anomalous."""
    one = scores.crossJoin(F.broadcast(threshold))
    stats = one.agg(F.min("mse").alias("lo"), F.stddev_pop(F.when(F.col("mse") > F.col("threshold"), F.col("mse"))).alias("sd"))
    below = F.when(F.col("threshold") - F.col("lo") < 1e-6, 10.0).otherwise(F.log(F.lit(99.0)) / F.nullif(F.col("threshold") - F.col("lo"), F.lit(0.0)))
    steep = F.when(F.col("mse") <= F.col("threshold"), below).otherwise(3.0 / (F.coalesce("sd", F.lit(0.0)) + 1e-8))
    return one.crossJoin(F.broadcast(stats)).withColumn("p", round4(1 / (1 + F.exp(-steep * (F.col("mse") - F.col("threshold")))))).drop("lo", "sd")


def agronomy(panel: DataFrame, rules: Routing = Routing()) -> DataFrame:
    """From (parcel_id, month, ndvi, glcm): peak, spring, deviation and texture, and what they veto."""
    ndvi = F.coalesce("ndvi", F.lit(0.0))
    per = panel.groupBy("parcel_id").agg(F.max(F.when(F.col("month").between(5, 9), ndvi)).alias("peak"), F.max(F.when(F.col("month") == 4, ndvi)).alias("spring"), F.stddev_pop(ndvi).alias("sd"), F.avg(F.coalesce("glcm", F.lit(0.0))).alias("tex"))
    one = per.crossJoin(F.broadcast(per.agg(F.avg("tex").alias("all_tex"))))
    abandoned = F.coalesce(F.col("peak") < rules.peak_max, F.lit(False))
    orchard = F.coalesce((F.col("spring") >= rules.spring_min) & (F.col("sd") < rules.std_max) & (F.col("tex") > rules.texture_ratio * F.col("all_tex")), F.lit(False))
    reason = F.when(abandoned & orchard, "physical_veto_abandoned_and_orchard").when(abandoned, "physical_veto_abandoned").when(orchard, "physical_veto_orchard")
    return one.select("parcel_id", "peak", "spring", "sd", "tex", abandoned.alias("abandoned"), orchard.alias("orchard"), reason.alias("veto_reason"))


def route(scored: DataFrame, rules: Routing = Routing()) -> DataFrame:
    """scored: confidence() joined with agronomy(). Adds pool (safe or anomaly), reason and confidence."""
    over, veto = F.col("mse") > F.col("threshold"), F.coalesce(F.col("abandoned") | F.col("orchard"), F.lit(False))
    grain = round4(1 - F.col("p"))
    doubtful = ~over & (grain < rules.safe_floor)
    anomaly = over | veto | doubtful
    reason = F.when(over & veto, "mse_anomaly_and_physical_veto").when(veto, F.col("veto_reason")).when(doubtful, "low_confidence_safe_review").when(over, "mse_anomaly").otherwise("strict_safe_grain")
    routed = scored.withColumn("pool", F.when(anomaly, "anomaly").otherwise("safe")).withColumn("reason", reason)
    own = F.when(~anomaly, grain).otherwise(F.when(F.contains("reason", F.lit("physical")), F.greatest("p", F.lit(rules.veto_confidence))).otherwise(F.col("p")))
    return routed.withColumn("confidence", own)


def top_two(p: list[str]) -> tuple[Column, Column, Column]:
    """Best class (the lowest if tied), its probability, and the margin to the second."""
    cells = F.array(*(F.struct((-F.col(c)).alias("s"), F.lit(i).alias("i")) for i, c in enumerate(p)))
    order = F.array_sort(cells)
    return order[0]["i"], -order[0]["s"], order[1]["s"] - order[0]["s"]


def classify(posteriors: DataFrame, floor: float = 0.60) -> DataFrame:
    """Adds class, confidence and margin; below the floor the class is 0 and the confidence its own probability."""
    best, most, margin = top_two(["p0", "p1", "p2"])
    low = F.col("_most") < floor
    rows = posteriors.withColumns({"_best": best, "_most": most, "margin": margin})
    return rows.select("parcel_id", "p0", "p1", "p2", F.when(low, 0).otherwise(F.col("_best")).alias("class"), F.when(low, F.col("p0")).otherwise(F.col("_most")).alias("class_confidence"), low.alias("floored"), "margin")


def review_batch(classified: DataFrame, known: DataFrame, size: int = 20) -> DataFrame:
    """The least certain unlabelled parcels of classes 1 and 2: half each, the odd one to class 2; true_label is -9999."""
    pool = classified.where(F.col("class").isin(1, 2)).join(known.select("parcel_id"), "parcel_id", "left_anti")
    rank = F.row_number().over(W.partitionBy("class").orderBy("margin", "parcel_id"))
    quota = F.when(F.col("class") == 1, size // 2).otherwise(size - size // 2)
    return pool.withColumn("rank", rank).where(F.col("rank") <= quota).withColumn("true_label", F.lit(-9999))


def small_loss(losses: DataFrame, loss: str, forget: float) -> DataFrame:
    """The int((1 - forget) * n) rows of least loss."""
    one = losses.select("parcel_id", loss).crossJoin(F.broadcast(cut_at_rank(losses, loss, 1 - forget)))
    below = one.where(F.col(loss) < F.col("cut"))
    # Rows of exactly the last loss: the first by id. The window holds these ties alone.
    ties = one.where(F.col(loss) == F.col("cut")).withColumn("_r", F.row_number().over(W.partitionBy(loss).orderBy("parcel_id"))).where("_r <= rest").drop("_r")
    return below.unionByName(ties).select("parcel_id", loss)


def forget_rate(epoch: int, most: float = 0.35, ramp: int = 30) -> float:
    return most * min(1.0, epoch / ramp)


def co_teaching(losses: DataFrame, forget: float) -> DataFrame:
    """(loss_a, loss_b): each net's mean loss over what the other one finds easy. losses: (parcel_id, a, b)."""
    easy_a, easy_b = (small_loss(losses, c, forget).select("parcel_id") for c in "ab")
    a = losses.join(easy_b, "parcel_id", "left_semi").agg(F.avg("a").alias("loss_a"))
    b = losses.join(easy_a, "parcel_id", "left_semi").agg(F.avg("b").alias("loss_b"))
    return a.crossJoin(b)  # a row each


#: The names of the interpretable features, macro and quality.
MACRO = ("Peak_NDVI_盛夏峰值", "Spring_NDVI_开春绿度", "NDVI_Std_生命周期波动", "Mean_GLCM_平均空间纹理")
QUALITY = ("Mean_Quality_平均影像质量", "Low_Quality_Months_低质量月份数")


def interpretable(panel: DataFrame, months: tuple[int, ...], low_quality: float = 0.5) -> DataFrame:
    """(parcel_id, 20 features) of (parcel_id, month, ndvi, texture, quality), in one aggregation: 4 macro and 14 monthly
    features, 2 of quality. A month that a parcel lacks counts as 0, and so do nulls."""
    at = lambda c, m: F.coalesce(F.max(F.when(F.col("month") == m, F.col(c))), F.lit(0.0))
    wide = panel.where(F.col("month").isin(*months)).groupBy("parcel_id").agg(*(at(c, m).alias(f"{c}_{m}") for m in months for c in ("ndvi", "texture", "quality")))
    of = lambda c: [F.col(f"{c}_{m}") for m in months]
    mean = lambda c: sum(of(c)[1:], of(c)[0]) / len(months)
    square = sum(((x - mean("ndvi")) ** 2 for x in of("ndvi")), F.lit(0.0)) / len(months)
    macro = (F.greatest(*(F.col(f"ndvi_{m}") for m in months if 5 <= m <= 9)), F.col(f"ndvi_{months[0]}"), F.sqrt(square), mean("texture"))
    monthly = (F.col(f"{c}_{m}").alias(f"{name}_{m}月") for m in months for c, name in (("ndvi", "NDVI"), ("texture", "GLCM")))
    low = sum((F.when(x < low_quality, 1).otherwise(0) for x in of("quality")), F.lit(0))
    return wide.select("parcel_id", *(x.alias(n) for x, n in zip(macro, MACRO, strict=True)), *monthly, mean("quality").alias(QUALITY[0]), low.alias(QUALITY[1]))


def scan_report(losses: DataFrame, qualities: DataFrame, low_quality: float = 0.5) -> DataFrame:
    """(parcel_id, mse, mean_quality, low_quality_months) of (parcel_id, mse) and (parcel_id, month, quality); a parcel
    without a quality has mean null and no low month."""
    per = qualities.groupBy("parcel_id").agg(F.avg("quality").alias("mean_quality"), F.sum((F.col("quality") < low_quality).cast("long")).alias("low"))
    return losses.join(per, "parcel_id", "left").select("parcel_id", "mse", "mean_quality", F.coalesce("low", F.lit(0)).alias("low_quality_months"))
