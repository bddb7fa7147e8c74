"""Texture of a parcel's raster: grey-level co-occurrence and local binary patterns, over rows of the raster as arrays.

A row of pixels meets the row above and below by one shuffle on (parcel, month, y), so a large parcel is spread over tasks by its
rows. Each row adds whole numbers (counts, sums, sums of products) to its parcel's, so results don't depend on the order of rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer valid pixels than this have no texture, and zeros instead.
SUPPORT = 9
OFFSETS = ((0, 1), (1, 1), (1, 0), (1, -1))


def levels(grid: DataFrame, value: str = "NIR") -> DataFrame:
    """(parcel_id, month, y, x, level, valid): values between the 2nd and 98th percentile as 0 to 255. Missing pixels and
    those of the bounding box that the parcel lacks are level 0."""
    key = ["parcel_id", "month"]
    q = F.percentile(value, F.array(F.lit(0.02), F.lit(0.98)))
    zone = grid.groupBy(*key).agg(q.alias("q"), F.count(value).alias("n"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    cells = zone.where(F.col("n") >= SUPPORT).select(*key, "q", F.explode(F.sequence(F.lit(0), "y1")).alias("y"), "x1").select(*key, "q", "y", F.explode(F.sequence(F.lit(0), "x1")).alias("x"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    scaled = F.floor((F.least(F.greatest(F.col(value), lo), hi) - lo) / (hi - lo) * 255)
    level = F.when((hi - lo >= 1e-5) & F.col(value).isNotNull(), scaled).otherwise(0)
    return cells.join(grid.select(*key, "y", "x", value), [*key, "y", "x"], "left").select(*key, "y", "x", F.coalesce(level, F.lit(0)).cast("int").alias("level"), F.col(value).isNotNull().alias("valid"))


def _rows(leveled: DataFrame) -> DataFrame:
    """(parcel_id, month, y, c, v, up, down): a row's levels by x, which of its pixels are valid, and its neighbours' levels, null
    beyond the raster. Rows come whole, as `levels` makes them."""
    key = ["parcel_id", "month", "y"]
    cells = F.array_sort(F.collect_list(F.struct("x", "level", "valid")))
    own = leveled.groupBy(*key).agg(cells.alias("cells")).select(*key, F.col("cells.level").alias("c"), F.col("cells.valid").alias("v"))
    sent = own.select("parcel_id", "month", "y", "c", "v", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    to = lambda d, a: F.max(F.when(F.col("d") == d, F.col(a)))
    near = sent.groupBy("parcel_id", "month", (F.col("y") + F.col("d")).alias("y")).agg(to(0, "c").alias("c"), to(0, "v").alias("v"), to(1, "c").alias("up"), to(-1, "c").alias("down"))
    return near.where(F.col("c").isNotNull())


def cooccurrence(leveled: DataFrame) -> DataFrame:
    """GLCM contrast and correlation at distance 1, each the mean over four angles of symmetric pairs."""
    sums = []
    for dy, dx in OFFSETS:
        other = "c" if dy == 0 else "down"
        pair = f"zip_with(slice(c, {1 + max(-dx, 0)}, greatest(size(c) - {abs(dx)}, 0)), slice({other}, {1 + max(dx, 0)}, greatest(size(c) - {abs(dx)}, 0)), (i, j) -> named_struct('i', cast(i as bigint), 'j', cast(j as bigint)))"
        total = lambda e, pair=pair: f"coalesce(aggregate({pair}, 0L, (s, p) -> s + {e}), 0L)"
        sums.append(f"named_struct('n', {total('1')}, 'd', {total('(p.i - p.j) * (p.i - p.j)')}, 'm', {total('p.i + p.j')}, 's', {total('p.i * p.i + p.j * p.j')}, 'c', {total('p.i * p.j')})")
    each = _rows(leveled).select("parcel_id", "month", F.posexplode(F.expr(f"array({', '.join(sums)})")).alias("k", "p"))
    per = each.groupBy("parcel_id", "month", "k").agg(*(F.sum(f"p.{n}").alias(n) for n in "ndmsc")).where("n > 0")
    mean, square, product = (F.col(a) / F.col("n") / b for a, b in (("m", 2.0), ("s", 2.0), ("c", 1.0)))
    var = square - mean * mean
    rho = F.when(var < 1e-15, 1.0).otherwise((product - mean * mean) / var)
    return per.select("parcel_id", "month", (F.col("d") / F.col("n")).alias("contrast"), rho.alias("rho")).groupBy("parcel_id", "month").agg(F.avg("contrast").alias("GLCM_Contrast"), F.avg("rho").alias("GLCM_Correlation"))


def pattern_points() -> list[list[tuple[float, int, int]]]:
    """The eight points of a pattern at radius 1, counter-clockwise from the right: weights of cells (dy, dx) between which each
    lies, in pairs of one row."""
    out = []
    for k in range(8):
        dy, dx = round(-math.sin(math.pi * k / 4), 5), round(math.cos(math.pi * k / 4), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        out.append([(a * b, y0 + i, x0 + j) for i, a in ((0, 1 - fy), (1, fy)) for j, b in ((0, 1 - fx), (1, fx)) if a * b])
    return out


def pattern_sql(cell: Callable[[int, int], str]) -> str:
    """SQL for a pixel's uniform pattern: how many of the eight points reach the centre, 9 if they change more than twice around."""
    bits = [f"case when {' + '.join(f'{w:.17e} * {cell(y, x)}' for w, y, x in point)} >= {cell(0, 0)} then 1 else 0 end" for point in pattern_points()]
    changes = " + ".join(f"abs({bits[k]} - {bits[k - 1]})" for k in range(8))
    return f"case when {changes} <= 2 then {' + '.join(bits)} else 9 end"


def binary_patterns(leveled: DataFrame) -> DataFrame:
    """LBP variance for each parcel and month over valid pixels; zeros lie beyond the edge."""
    row = {-1: "up", 0: "c", 1: "down"}
    cell = lambda y, x: f"cast(coalesce(get({row[y]}, x + {x}), 0) as double)"
    patterns = _rows(leveled).select("parcel_id", "month", F.expr(f"filter(transform(c, (level, x) -> if(get(v, x), {pattern_sql(cell)}, null)), p -> p is not null)").alias("p"))
    total = lambda e: F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + e(p)))
    n, s, q = total(lambda p: F.lit(1)), total(lambda p: p), total(lambda p: p * p)
    return patterns.groupBy("parcel_id", "month").agg(n.alias("n"), s.alias("s"), q.alias("q")).where("n > 0").select("parcel_id", "month", ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.col("n")).alias("LBP_Variance"))
