"""Spatial joins on a grid of cells: boxes with boxes, points with polygons."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64.0


def _cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return df.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy")))


def box_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float = CELL) -> DataFrame:
    """Pairs of boxes that overlap; touching edges don't count. An equi-join on cells; a pair is kept in the cell of its
    least corner, so no pair comes twice and none needs a shuffle to be told apart."""
    box = ("minx", "miny", "maxx", "maxy")
    a = _cells(left.select(left_id, *box), cell)
    b = _cells(right.select(F.col(right_id), *(F.col(c).alias(f"r_{c}") for c in box)).withColumns({c: F.col(f"r_{c}") for c in box}), cell).drop(*box)
    joined = a.join(b, ["_cx", "_cy"])
    overlap = (F.col("minx") < F.col("r_maxx")) & (F.col("maxx") > F.col("r_minx")) & (F.col("miny") < F.col("r_maxy")) & (F.col("maxy") > F.col("r_miny"))
    corner = (F.col("_cx") == F.floor(F.greatest("minx", "r_minx") / cell)) & (F.col("_cy") == F.floor(F.greatest("miny", "r_miny") / cell))
    return joined.where(overlap & corner).select(left_id, right_id)


def multipolygon_wkb(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(polygon_wkb, polygons))


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


def polygons_of(wkb: bytes) -> list[list[np.ndarray]]:
    """Polygons, as lists of rings, of a WKB polygon or multipolygon; raises ValueError for other geometries."""
    at = 0

    def take(fmt: str):
        nonlocal at
        v = struct.unpack_from(fmt, wkb, at)
        at += struct.calcsize(fmt)
        return v

    def polygon(e: str) -> list[np.ndarray]:
        nonlocal at
        out = []
        for _ in range(take(e + "I")[0]):
            n = take(e + "I")[0]
            out.append(np.frombuffer(wkb, e + "f8", 2 * n, at).reshape(-1, 2))
            at += 16 * n
        return out

    def one() -> list[list[np.ndarray]]:
        e = "<" if take("B")[0] else ">"
        kind = take(e + "I")[0]
        if kind == 3:
            return [polygon(e)]
        if kind == 6:
            return [p for _ in range(take(e + "I")[0]) for p in one()]
        raise ValueError(f"geometry of type {kind}")

    return one()


def rings_of(wkb: bytes) -> list[np.ndarray]:
    """All rings of a WKB polygon or multipolygon."""
    return [r for rings in polygons_of(wkb) for r in rings]


def contains(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, holes included. Of points on the outline, those on a lower or left edge are inside and those on
    an upper or right edge aren't, so that polygons side by side share none."""
    inside = np.zeros(len(x), bool)
    for r in rings:
        a, b = r[:-1], r[1:]
        cross = (a[:, 1] > y[:, None]) != (b[:, 1] > y[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = a[:, 0] + (y[:, None] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        inside ^= (cross & (x[:, None] < at)).sum(1) % 2 == 1
    return inside


def zonal_join(pixels: DataFrame, parcels: DataFrame, cell: float = CELL) -> DataFrame:
    """Pixels (px, py, ...) with the parcels (parcel_id, geometry, box) whose polygon holds their centre."""
    def inside(x: pd.Series, y: pd.Series, wkb: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for shape, at in pd.Series(np.arange(len(x))).groupby(wkb.to_numpy()):
            i = at.to_numpy()
            out[i] = contains(rings_of(shape), x.to_numpy()[i], y.to_numpy()[i])
        return pd.Series(out)

    placed = pixels.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    near = placed.join(_cells(parcels.select("parcel_id", "geometry", "minx", "miny", "maxx", "maxy"), cell), ["_cx", "_cy"])
    boxed = near.where(F.col("px").between(F.col("minx"), F.col("maxx")) & F.col("py").between(F.col("miny"), F.col("maxy")))
    return boxed.where(F.pandas_udf(inside, "boolean")("px", "py", "geometry")).select("parcel_id", *pixels.columns)


#: Geometry types by their number in well-known binary.
TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def geometry_type(geometry: str = "geometry") -> Column:
    """The type's name, read from the well-known binary; null for null, too short and unknown ones."""
    code = F.hex(F.substring(F.col(geometry), 1, 5))
    low = F.when(F.startswith(code, F.lit("01")), F.substring(code, 3, 2)).when(F.startswith(code, F.lit("00")), F.substring(code, 9, 2))
    return F.coalesce(*(F.when(low == f"{i + 1:02X}", F.lit(name)) for i, name in enumerate(TYPES)))
