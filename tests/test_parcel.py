"""Hand-made cases of the parcel operators, and every registered query against its SQL on the smallest tables."""

import inspect
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import columns as C
from fieldloom.functions.indices import with_indices
from fieldloom.operators import clusters, labels, quality, scoring, spatial, texture, zonal
from fieldloom.plans import queries as Q
from fieldloom.sources import files
from fieldloom.sources.config import Config

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.6g}") + 0.0 if math.isfinite(v) else str(v)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [k for k, q in Q.REGISTRY.items() if q.sql])
def test_query_equals_sql(spark, duck, name):
    df, want = Q.queries()[name](spark, SF), duck.sql(Q.oracles()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted(str(tuple(map(_norm, r))) for r in df.select(*names).collect())
    cells = ", ".join(f'"{n}"' for n in names)
    assert got == sorted(str(tuple(map(_norm, r))) for r in duck.sql(f"select {cells} from ({Q.oracles()[name]})").fetchall())


def test_kmeans_takes_all_starts(spark, monkeypatch):
    """The registered query fits as often as the operator and the reference do, on all rows and whole vectors."""
    seen, own = [], inspect.signature(clusters.kmeans)

    def recorded(*args, **named):
        seen.append(own.bind(*args, **named))
        seen[0].apply_defaults()
        return seen[0].arguments["points"].withColumn("cluster", F.lit(0))

    monkeypatch.setattr(clusters, "kmeans", recorded)
    Q.queries()["m02_kmeans"](spark, SF)
    got = seen[0].arguments
    assert (got["k"], got["starts"]) == (4, 10)
    assert tuple(got["points"].agg(F.count("*"), F.min(F.size(got["vector"]))).head()) == (500, 64)


def pixels(spark, rows):
    return with_indices(spark.createDataFrame(rows, "parcel_id string, month int, blue double, green double, red double, nir double"))


def test_index_edges(spark):
    r = pixels(spark, [("a", 4, 0.0, 0.0, 0.0, 0.0), ("b", 4, 2000.0, 0.0, 0.0, 5000.0), ("c", 4, 30000.0, 5000.0, 5000.0, -5000.0)]).orderBy("parcel_id").collect()
    assert r[0]["NDVI"] is None and r[0]["ISI"] is None  # no data
    assert r[1]["EVI"] is None and r[1]["GCVI"] is None  # zero denominators
    assert r[2]["NDVI"] is None and r[2]["ISI"] is None  # n + r = 0, out of range


def test_support_guard_and_constant(spark):
    rows = [("two", 4, 100.0, 200.0, 300.0, 600.0)] * 2 + [("same", 4, 100.0, 200.0, 300.0, 600.0)] * 3
    r = {x["parcel_id"]: x for x in zonal.zonal_stats(pixels(spark, rows)).collect()}
    assert r["two"]["NDVI_mean"] is None and r["two"]["NDVI_valid_count"] == 2
    assert abs(r["same"]["NDVI_cv"]) < 1e-9 and r["same"]["NDVI_kurt"] == pytest.approx(0, abs=4)
    t = {x["parcel_id"]: x for x in zonal.tail_stats(pixels(spark, rows)).collect()}
    assert t["two"]["NDVI_mean"] == 0.0


def test_delta_needs_calendar_month(spark):
    df = spark.createDataFrame([("p", 4, 0.1), ("p", 5, 0.3), ("p", 7, 0.2), ("q", 5, 0.4)], "parcel_id string, month int, v double")
    got = {(r["parcel_id"], r["month"]): r["d"] for r in zonal.delta_calendar(df, "v", [4, 5, 7], "d").collect()}
    assert got[("p", 4)] == 0.0 and got[("p", 5)] == pytest.approx(0.2) and got[("p", 7)] == 0.0 and got[("q", 5)] is None


def test_quality_of_missing_is_one_part(spark):
    stats = zonal.zonal_stats(pixels(spark, [("a", 4, 100.0, 200.0, 300.0, 600.0)]))
    q = quality.quality(zonal.spine(stats, [4, 5, 6]), (4, 5, 6), {4: 1.0, 5: 0.0}).orderBy("month").collect()
    assert q[1]["quality"] == pytest.approx(0.05) and 0.05 <= q[0]["quality"] <= 1


def test_threshold_is_on_the_safe_side(spark):
    s = spark.createDataFrame([("a", 0.1), ("b", 0.4), ("c", 0.9)], "parcel_id string, mse double")
    got = {r["parcel_id"]: r for r in scoring.confidence(s, spark.createDataFrame([(0.4,)], "threshold double")).collect()}
    assert got["b"]["p"] == 0.5 and got["a"]["p"] == pytest.approx(0.01, abs=1e-3)
    veto = scoring.confidence(s, spark.createDataFrame([(0.4,)], "threshold double")).withColumns({"abandoned": F.lit(False), "orchard": F.lit(False), "veto_reason": F.lit(None).cast("string")})
    assert {r["parcel_id"]: r["reason"] for r in scoring.route(veto).collect()} == {"a": "strict_safe_grain", "b": "low_confidence_safe_review", "c": "mse_anomaly"}


def test_labels_merge(spark):
    gold = labels.true_labels(spark.createDataFrame([("a", 2), ("b", -9999), ("c", None), ("e", 0)], "parcel_id string, ture_label int"))
    got = {r["parcel_id"]: (r["label"], r["weight"]) for r in labels.merge(gold, spark.createDataFrame([("a", 1), ("d", 1)], "parcel_id string, label int")).collect()}
    assert got == {"a": (2, 10.0), "e": (0, 10.0), "d": (1, 0.1)}


def test_names_and_keys():
    assert C.short_names(["a" * 12, "a" * 11, "b"]) == {"a" * 12: "a" * 10, "a" * 11: "a" * 9 + "1", "b": "b"}
    assert C.key_column(["X", "ID"]) == "ID" and C.key_column(["x", "y"]) == "x"
    assert C.by_prefix(["NDVI_M10", "NDVI_M4", "EVI_M4"], "NDVI") == ["NDVI_M4", "NDVI_M10"]


def test_texture_of_flat_and_checkerboard(spark):
    flat = [("f", 4, y, x, 5.0) for y in range(4) for x in range(4)]
    board = [("c", 4, y, x, float((x + y) % 2)) for y in range(8) for x in range(8)]
    lv = texture.levels(spark.createDataFrame(flat + board, "parcel_id string, month int, y int, x int, NIR double"))
    got = {r["parcel_id"]: r for r in texture.cooccurrence(lv).collect()}
    assert got["f"]["GLCM_Contrast"] == 0 and got["f"]["GLCM_Correlation"] == 1
    assert got["c"]["GLCM_Contrast"] == pytest.approx(255**2 / 2) and got["c"]["GLCM_Correlation"] == pytest.approx(0)
    assert {r["parcel_id"]: r["LBP_Variance"] for r in texture.binary_patterns(lv).collect()}["c"] > 0


def test_boxes_that_touch_do_not_overlap(spark):
    box = "k string, minx double, miny double, maxx double, maxy double"
    a = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0)], box)
    b = spark.createDataFrame([("t", 10.0, 0.0, 20.0, 10.0), ("o", 9.0, 9.0, 200.0, 200.0)], box.replace("k ", "m "))
    assert [tuple(r) for r in spatial.box_join(a, b, "k", "m").collect()] == [("a", "o")]


def test_polygons(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    wkb = spatial.polygon_wkb([ring, hole])
    assert spatial.contains(spatial.rings_of(wkb), np.array([5.0, 1.0, 11.0]), np.array([5.0, 1.0, 1.0])).tolist() == [False, True, False]


def test_ledgers(spark, tmp_path):
    files.write_ledger(spark.createDataFrame([("007", "12.0")], "parcel_id string, v string"), str(tmp_path / "l"))
    assert tuple(files.read_ledger(spark, str(tmp_path / "l")).head()) == ("007", "12.0")
    assert files.missing_months(spark, str(tmp_path / "none"), [4, 5]) == [4, 5]


def test_monthly_ingest(spark, tmp_path):
    from fieldloom.streaming.arrivals import ingest

    schema = "parcel_id string, month int, blue double, green double, red double, nir double"
    spark.createDataFrame([("a", 4, 100.0, 200.0, 300.0, 600.0)] * 3, schema).write.parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).where("NDVI_valid_count = 3").count() == 1
    # without its checkpoint the stream begins anew, as after a failure: the batch counts once
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "again")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).where("NDVI_valid_count = 3").count() == 1
    assert files.missing_months(spark, str(tmp_path / "s"), [4, 5]) == [5]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[paths]\nout = "o"\n[quality.month_weights]\n"4" = 0.5\n')
    c = Config.load(str(tmp_path / "c.toml"))
    assert c.path("paths", "out") == tmp_path / "o" and c.month_weights == {4: 0.5} and c.get("x", "y", 3) == 3
    with pytest.raises(KeyError):
        c.path("paths", "none")


def test_quantile_by(spark):
    import random

    from fieldloom.functions.quantiles import quantile_by

    rng = random.Random(3)
    rows = [(rng.choice("abc"), float(rng.randrange(40)) if rng.random() < 0.9 else None) for _ in range(500)] + [("d", None), ("e", 2.0), ("f", 1.0), ("f", 4.0)]
    got = {r["k"]: r["m"] for r in quantile_by(spark.createDataFrame(rows, "k string, x double"), "k", "x", 0.3, "m").collect()}
    for k in "abcef":
        v = sorted(x for a, x in rows if a == k and x is not None)
        at = 0.3 * (len(v) - 1)
        assert got[k] == pytest.approx(v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]))
    assert "d" not in got


def test_geometry_types(spark):
    from fieldloom.operators import spatial

    rows = [(bytes.fromhex("0103000000"),), (bytes.fromhex("0000000001"),), (b"\x01",), (None,), (bytes.fromhex("0109000000"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "geometry binary").select(spatial.geometry_type()).collect()]
    assert got == ["Polygon", "Point", None, None, None]


def test_interpretable_fills_absent_months(spark):
    from fieldloom.operators import scoring

    df = spark.createDataFrame([("a", 4, 0.2, 1.0, 0.4), ("a", 6, 0.9, None, 0.8)], "parcel_id string, month int, ndvi double, texture double, quality double")
    r = scoring.interpretable(df, (4, 5, 6, 7, 8, 9, 10)).head().asDict()
    assert len(r) == 21 and r[scoring.MACRO[0]] == 0.9 and r[scoring.MACRO[1]] == 0.2 and r["GLCM_6月"] == 0.0
    assert r[scoring.QUALITY[1]] == 6 and r[scoring.QUALITY[0]] == pytest.approx(1.2 / 7)


def test_large_groups_are_spread(spark, monkeypatch):
    """Groups on both sides of the bound get the same statistics as without it."""
    rng = np.random.default_rng(6)
    rows = [(str(p), m, *map(float, rng.integers(0, 4000, 4))) for p, n in (("a|b", 200), ("7", 3), ("c", 60), ("d", 2)) for m in (4, 5) for _ in range(n)] + [("z", 4, 0.0, 0.0, 0.0, 0.0)] * 80
    df = pixels(spark, rows)
    show = lambda d: sorted(str(tuple(map(_norm, r))) for r in d.collect())
    plain = show(zonal.zonal_stats(df)), show(zonal.tail_stats(df))
    monkeypatch.setattr(zonal, "LARGE", 50)
    assert (show(zonal.zonal_stats(df)), show(zonal.tail_stats(df))) == plain
