"""Polygons: what is wrong with them, against hand-made cases and pairs of segments in plain Python."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import spatial, validity

BOX = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


def box(x, y, w, h=None):
    h = h or w
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def poly(*rings):
    return spatial.polygon_wkb([list(r) for r in rings])


CASES = {
    "box": (poly(BOX), None),
    "reversed": (poly(BOX[::-1]), None),
    "repeated points": (poly([p for p in BOX for _ in (0, 1)]), None),
    "hole": (poly(BOX, box(4, 4, 2)), None),
    "two holes that touch in a point": (poly(BOX, box(2, 2, 2), box(4, 4, 2)), None),
    "hole that touches the shell in a point": (poly(BOX, [(0.0, 5.0), (3.0, 4.0), (3.0, 6.0), (0.0, 5.0)]), None),
    "two parts": (spatial.multipolygon_wkb([[box(0, 0, 3)], [box(5, 5, 3)]]), None),
    "part in another's hole": (spatial.multipolygon_wkb([[BOX, box(2, 2, 6)], [box(4, 4, 2)]]), None),
    "parts that touch in a point": (spatial.multipolygon_wkb([[box(0, 0, 3)], [box(3, 3, 3)]]), None),
    "null": (None, "empty"),
    "no rings": (poly(), "empty"),
    "point": (struct.pack("<BIdd", 1, 1, 0, 0), "malformed"),
    "cut off": (poly(BOX)[:-9], "malformed"),
    "garbage": (b"x", "malformed"),
    "nan": (poly([*BOX[:2], (float("nan"), 1.0), *BOX[2:]]), "not finite"),
    "open": (poly(BOX[:-1]), "open ring"),
    "two points": (poly([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), "too few points"),
    "one point": (poly([(0.0, 0.0)] * 5), "no area"),
    "flat": (poly([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]), "no area"),
    "bow tie": (poly([(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]), "self-intersection"),
    "spike": (poly([(0.0, 0.0), (10.0, 0.0), (15.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]), "self-intersection"),
    "touches itself": (poly([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 0.0), (0.0, 10.0), (0.0, 0.0)]), "self-intersection"),
    "corner on corner": (poly([(0.0, 0.0), (4.0, 0.0), (5.0, 5.0), (8.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0), (0.0, 0.0)]), "self-intersection"),
    "hole across": (poly(BOX, box(8, 4, 4)), "crossing rings"),
    "hole on an edge": (poly(BOX, box(0, 4, 2)), "crossing rings"),
    "hole outside": (poly(BOX, box(20, 20, 2)), "hole outside shell"),
    "hole around the shell": (poly(BOX, box(-5, -5, 30)), "hole outside shell"),
    "hole in a hole": (poly(BOX, box(2, 2, 6), box(4, 4, 2)), "nested holes"),
    "equal holes": (poly(BOX, box(2, 2, 6), box(2, 2, 6)), "crossing rings"),
    "part in a part": (spatial.multipolygon_wkb([[BOX], [box(4, 4, 2)]]), "nested parts"),
    "parts across": (spatial.multipolygon_wkb([[BOX], [box(8, 8, 4)]]), "crossing rings"),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, g) for k, (g, _) in CASES.items()], "parcel_id string, geometry binary").repartition(3)
    return {r["parcel_id"]: r for r in validity.validity(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(found, name):
    assert (found[name]["valid"], found[name]["reason"]) == (CASES[name][1] is None, CASES[name][1])


def star(rng, n):
    at = np.sort(rng.random(n)) * 2 * np.pi
    r = rng.uniform(2, 10, n)
    ring = [(float(a), float(b)) for a, b in zip(np.round(r * np.cos(at), 2), np.round(r * np.sin(at), 2), strict=True)]
    return [*ring, ring[0]]


def plain(ring):
    """Whether a ring of points in general position crosses itself."""
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    s = list(zip(ring, ring[1:], strict=False))
    return any(side(*a, b[0]) * side(*a, b[1]) < 0 and side(*b, a[0]) * side(*b, a[1]) < 0 for a, b in itertools.combinations(s, 2))


def test_long_outlines(spark):
    rng = np.random.default_rng(4)
    rings = [star(rng, 60) for _ in range(12)]
    for k in range(0, 12, 2):  # two corners change places
        i = int(rng.integers(5, 50))
        rings[k][i], rings[k][i + 3] = rings[k][i + 3], rings[k][i]
    df = spark.createDataFrame([(k, spatial.polygon_wkb([r])) for k, r in enumerate(rings)], "parcel_id long, geometry binary")
    got = {r["parcel_id"]: r["valid"] for r in validity.validity(df).collect()}
    assert got == {k: not plain(r) for k, r in enumerate(rings)} and set(got.values()) == {True, False}


def test_valid_only_and_empty(spark):
    df = spark.createDataFrame([(k, g, 1) for k, (g, _) in CASES.items()], "parcel_id string, geometry binary, flaw int")
    kept = validity.valid_only(df)
    assert kept.columns == df.columns and {r["parcel_id"] for r in kept.collect()} == {k for k, (_, why) in CASES.items() if why is None}
    assert validity.validity(df.where("false")).count() == 0
    assert validity.validity(df.where(F.col("parcel_id") == "null")).collect()[0]["reason"] == "empty"
