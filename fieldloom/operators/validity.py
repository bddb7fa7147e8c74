"""Validity of polygons, by their segments.

Each polygon is taken apart into segments once. Segments of one polygon meet where they share a cell of a grid whose cells are about
as many as the polygon's segments, so a long outline is spread over tasks and no polygon's segments all meet. Orientation tests tell
crossings, touches and overlaps; rays from two corners of each ring tell which rings lie in which.

A polygon is valid if its rings are closed, finite, of four points or more and of some area; no ring crosses, touches or folds back
on itself; rings of one polygon don't cross or share a piece of edge (they may touch in a point); holes lie in their shell and not in
each other; parts of a multipolygon don't lie in each other. Repeated points in a row count as one. Null geometries are empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import stored
from .spatial import polygons_of

#: What is wrong, in order of precedence.
REASONS = ("malformed", "empty", "not finite", "open ring", "too few points", "no area", "self-intersection", "crossing rings", "hole outside shell", "nested holes", "nested parts")
_FIELDS = (("part", T.IntegerType()), ("ring", T.IntegerType()), ("s", T.LongType()), ("i", T.LongType()), ("n", T.LongType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("corner", T.BooleanType()), ("cell", T.DoubleType()), ("flaw", T.IntegerType()))


def _taken_apart(wkb: bytes | None) -> tuple[list[tuple], int | None]:
    """Rings as (part, ring, points without repeats), and the first flaw that a ring shows by itself."""
    if wkb is None:
        return [], REASONS.index("empty")
    try:
        parts = polygons_of(wkb)
    except (ValueError, struct.error, IndexError):
        return [], REASONS.index("malformed")
    rings, flaw = [(p, k, r) for p, part in enumerate(parts) for k, r in enumerate(part)], None
    if not rings or not all(map(len, parts)):
        return [], REASONS.index("empty")
    out = []
    for p, k, r in rings:
        found = None
        if not np.isfinite(r).all():
            found = "not finite"
        elif not len(r) or (r[0] != r[-1]).any():
            found = "open ring"
        elif len(r) < 4:
            found = "too few points"
        else:
            r = r[np.append(True, (np.diff(r, axis=0) != 0).any(1))]
            if len(r) < 4 or not np.dot(r[:-1, 0], r[1:, 1]) - np.dot(r[1:, 0], r[:-1, 1]):
                # a figure of eight has no signed area, but its crossing is found below
                found = "no area" if len(r) < 5 else None
        if found:
            flaw = min(flaw if flaw is not None else 99, REASONS.index(found))
        out.append((p, k, r))
    return ([], flaw) if flaw is not None else (out, None)


def segments(df: DataFrame, key: str = "parcel_id", geometry: str = "geometry") -> DataFrame:
    """(key, part, ring, s, i, n, x0, y0, x1, y1, corner, cell, flaw): s numbers a polygon's segments, i those of a ring of n; corner
    marks a ring's two outermost points. A polygon with a flaw by itself has one row with that flaw."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(n, t) for n, t in _FIELDS)])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, wkb in enumerate(b.column("g").to_pylist()):
                rings, flaw = _taken_apart(wkb)
                if flaw is not None:
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(at, 1), *(pa.array([flaw if n == "flaw" else None], pa.int32() if n in ("part", "ring", "flaw") else pa.bool_() if n == "corner" else pa.int64() if n in "sin" else pa.float64()) for n, _ in _FIELDS)], schema.names)
                    continue
                xy = np.concatenate([r for *_, r in rings])
                n_all, s = len(xy) - len(rings), 0
                cell = max(float(np.ptp(xy, axis=0).max()) / np.ceil(np.sqrt(n_all)), 1e-300)
                for p, k, r in rings:
                    n = len(r) - 1
                    corner = np.zeros(n, bool)
                    order = np.lexsort((r[:-1, 1], r[:-1, 0]))
                    corner[[order[0], order[-1]]] = True
                    numbers = [np.full(n, p, np.int32), np.full(n, k, np.int32), np.arange(s, s + n), np.arange(n), np.full(n, n), r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1], corner, np.full(n, cell)]
                    s += n
                    rows = pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.full(n, at))), *map(pa.array, numbers), pa.nulls(n, pa.int32())], schema.names)
                    for lo in range(0, n, 8192):
                        yield rows.slice(lo, 8192)

    return df.select(F.col(key).alias("key"), F.col(geometry).alias("g")).mapInArrow(apart, schema)


def _side(a: str, b: str, c: str) -> Column:
    """On which side of the line from a to b c lies, for points named by their columns."""
    x, y = (lambda p: F.col(f"{p[0]}.x{p[1]}")), (lambda p: F.col(f"{p[0]}.y{p[1]}"))
    return F.signum((x(b) - x(a)) * (y(c) - y(a)) - (y(b) - y(a)) * (x(c) - x(a)))


def _cells(axis: str) -> Column:
    lo, hi = F.least(f"{axis}0", f"{axis}1"), F.greatest(f"{axis}0", f"{axis}1")
    return F.sequence(F.floor(lo / F.col("cell")), F.floor(hi / F.col("cell")))


def crossings(seg: DataFrame) -> DataFrame:
    """(key, flaw) of segments that meet where they must not; a pair that shares several cells may come more than once."""
    own = ("key", "part", "ring", "s", "i", "n", "x0", "y0", "x1", "y1")
    placed = seg.select(*own, "cell", F.explode(_cells("x")).alias("cx")).withColumn("cy", F.explode(_cells("y"))).drop("cell")
    pair = placed.alias("a").join(placed.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "cx", "cy")] + [F.col("a.s") < F.col("b.s")])
    b0, b1, a0, a1 = _side("a0", "a1", "b0"), _side("a0", "a1", "b1"), _side("b0", "b1", "a0"), _side("b0", "b1", "a1")
    span = lambda s, axis: (F.least(f"{s}.{axis}0", f"{s}.{axis}1"), F.greatest(f"{s}.{axis}0", f"{s}.{axis}1"))
    (ax0, ax1), (bx0, bx1), (ay0, ay1), (by0, by1) = span("a", "x"), span("b", "x"), span("a", "y"), span("b", "y")
    boxes = (F.greatest(ax0, bx0) <= F.least(ax1, bx1)) & (F.greatest(ay0, by0) <= F.least(ay1, by1))
    line = (F.col("b0") == 0) & (F.col("b1") == 0)
    overlap = line & boxes & ((F.greatest(ax0, bx0) < F.least(ax1, bx1)) | (F.greatest(ay0, by0) < F.least(ay1, by1)))
    proper = (F.col("b0") * F.col("b1") < 0) & (F.col("a0") * F.col("a1") < 0)
    meet = boxes & (F.col("b0") * F.col("b1") <= 0) & (F.col("a0") * F.col("a1") <= 0)
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.ring") == F.col("b.ring"))
    beside = (F.col("b.i") == F.col("a.i") + 1) | ((F.col("a.i") == 0) & (F.col("b.i") == F.col("a.n") - 1))
    flaw = F.when(same & F.when(beside, overlap).otherwise(meet), REASONS.index("self-intersection")).when(~same & (proper | overlap), REASONS.index("crossing rings"))
    return pair.withColumns({"b0": b0, "b1": b1, "a0": a0, "a1": a1}).select(F.col("a.key").alias("key"), flaw.alias("flaw")).where("flaw is not null")


def nestings(seg: DataFrame) -> DataFrame:
    """(key, flaw) of rings that lie where they must not."""
    rows = seg.select("key", "part", "ring", "x0", "y0", "x1", "y1", F.explode(_cells("y")).alias("cy"))
    corner = seg.where("corner").select("key", F.col("part").alias("p"), F.col("ring").alias("r"), "s", F.col("x0").alias("px"), F.col("y0").alias("py"), F.floor(F.col("y0") / F.col("cell")).alias("cy"))
    ray = corner.join(rows, ["key", "cy"]).where((F.col("p") != F.col("part")) | (F.col("r") != F.col("ring")))
    cross = ((F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))) & (F.col("px") < F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))
    turn = (F.col("x1") - F.col("x0")) * (F.col("py") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("px") - F.col("x0"))
    on = (turn == 0) & F.col("px").between(F.least("x0", "x1"), F.greatest("x0", "x1")) & F.col("py").between(F.least("y0", "y1"), F.greatest("y0", "y1"))
    seen = ray.groupBy("key", "p", "r", "s", "part", "ring").agg((F.sum(F.coalesce(cross, F.lit(False)).cast("int")) % 2 == 1).alias("odd"), F.max(on).alias("on"))
    inside = F.col("odd") & ~F.col("on")
    # holes and their own shell: a corner in it, and none outside
    shell = seen.where("p = part and ring = 0")
    holes = corner.where("r > 0").select("key", "p", "r", "s").join(shell.select("key", "p", "r", "s", inside.alias("in"), "on"), ["key", "p", "r", "s"], "left")
    out = holes.groupBy("key", "p", "r").agg(F.max(F.coalesce("in", F.lit(False))).alias("some"), F.max(~F.coalesce(F.col("in") | F.col("on"), F.lit(False))).alias("beyond")).where("beyond or not some")
    nested = seen.where(inside & F.expr("p = part and r > 0 and ring > 0"))
    # a shell's corner in the interior of another part
    parts = seen.where("r = 0 and p != part").groupBy("key", "p", "s", "part").agg(F.sum(F.col("odd").cast("int")).alias("n"), F.max("on").alias("on")).where("n % 2 = 1 and not on")
    flaw = lambda df, name: df.select("key", F.lit(REASONS.index(name)).alias("flaw"))
    return flaw(out, "hole outside shell").unionByName(flaw(nested, "nested holes")).unionByName(flaw(parts, "nested parts"))


def validity(df: DataFrame, key: str = "parcel_id", geometry: str = "geometry") -> DataFrame:
    """(key, valid, reason) of polygons and multipolygons; keys tell rows apart. reason is null for valid ones."""
    seg = stored(segments(df, key, geometry))
    whole = seg.where("flaw is null")
    flaws = seg.where("flaw is not null").select("key", "flaw").unionByName(crossings(whole)).unionByName(nestings(whole))
    worst = flaws.groupBy("key").agg(F.min("flaw").alias("flaw"))
    name = F.element_at(F.array(*map(F.lit, REASONS)), F.col("flaw") + 1)
    keys = df.select(F.col(key).alias("key"))
    return keys.join(worst, "key", "left").select(F.col("key").alias(key), F.col("flaw").isNull().alias("valid"), F.when(F.col("flaw").isNotNull(), name).alias("reason"))


def valid_only(df: DataFrame, key: str = "parcel_id", geometry: str = "geometry") -> DataFrame:
    """df's rows with a valid geometry."""
    return df.join(validity(df, key, geometry).where("valid").select(key), key, "left_semi")
