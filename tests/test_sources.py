"""Data sources: round trips over many tasks, odd files, pruned windows, failed files."""

import datetime
import struct

import numpy as np
import pytest

from fieldloom.operators import spatial
from fieldloom.sources import raster, shapefile, storage

RING = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (0.0, 0.0)]


@pytest.fixture(scope="module")
def shp(spark):
    shapefile.register(spark)
    return spark


def square(k):
    return [(k, 0.0), (k, 1.0), (k + 1, 1.0), (k + 1, 0.0), (k, 0.0)]


def test_polygons_over_many_tasks(shp, tmp_path):
    hole = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2)]
    rows = []
    for k in range(100):
        parts = [[square(float(k))]] if k % 3 else [[square(float(k)), [(k + x, y) for x, y in hole]], [square(k + 500.0)]]
        rows.append((k, f"果树{k}" if k % 4 else None, k / 8 if k % 5 else None, k % 2 == 0, datetime.date(2020, 1, 1 + k % 28), None if k == 7 else spatial.multipolygon_wkb(parts) if len(parts) > 1 else spatial.polygon_wkb(parts[0])))
    df = shp.createDataFrame(rows, "parcel_id long, crop string, area double, seen boolean, day date, geometry binary")
    path = str(tmp_path / "out")
    df.repartition(4).write.format("shapefile").mode("append").option("path", path).option("records", 9).save()
    assert len(storage.listed(path, ".shp")) >= 12 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    back = shp.read.format("shapefile").option("records", 4).load(path)
    assert dict(back.dtypes) == dict(df.dtypes) and back.rdd.getNumPartitions() >= 25
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert back.select("area").where("area > 10").count() == df.where("area > 10").count()


def test_points_lines_and_failures(shp, tmp_path):
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 3, 4)
    lines = struct.pack("<BII", 1, 5, 2) + line + line
    point = struct.pack("<BIdd", 1, 1, 5, 6)
    for name, values in (("line", [line, lines]), ("point", [point, None])):
        df = shp.createDataFrame(list(enumerate(values)), "id int, geometry binary")
        df.coalesce(1).write.format("shapefile").mode("append").save(str(tmp_path / name))
        assert sorted((r["id"], r["geometry"]) for r in shp.read.format("shapefile").load(str(tmp_path / name)).collect()) == list(enumerate(values))
    with pytest.raises(Exception, match="shapes of one type"):
        shp.createDataFrame([(1, line), (2, point)], "id int, geometry binary").coalesce(1).write.format("shapefile").mode("append").save(str(tmp_path / "mixed"))
    assert list((tmp_path / "mixed").iterdir()) == []  # nothing is published, nothing is left
    with pytest.raises(Exception, match="more than 10 characters"):
        shp.createDataFrame([(1, point)], "a_long_name_ int, geometry binary").write.format("shapefile").mode("append").save(str(tmp_path / "long"))
    with pytest.raises(Exception, match="missing columns: geometry"):
        shp.createDataFrame([(1,)], "id int").write.format("shapefile").mode("append").save(str(tmp_path / "none"))


def test_overwrite_replaces_all(shp, tmp_path):
    path, point = str(tmp_path / "o"), struct.pack("<BIdd", 1, 1, 5, 6)
    for n in (5, 2):
        shp.createDataFrame([(i, point) for i in range(n)], "id long, geometry binary").write.format("shapefile").mode("overwrite").save(path)
        assert shp.read.format("shapefile").load(path).count() == n


def test_deleted_records_and_encodings(shp, tmp_path):
    path = str(tmp_path / "d")
    shp.createDataFrame([(i, "é", struct.pack("<BIdd", 1, 1, i, 0)) for i in range(3)], "id long, t string, geometry binary").coalesce(1).write.format("shapefile").mode("append").save(path)
    dbf, cpg = (next((tmp_path / "d").glob(f"*.{s}")) for s in ("dbf", "cpg"))
    head, size, _ = shapefile.table_head(str(dbf))
    raw = bytearray(dbf.read_bytes().replace("é".encode(), b"\xe9 "))
    raw[head + size] = ord("*")
    dbf.write_bytes(raw)
    cpg.write_text("1252")
    assert sorted((r["id"], r["t"]) for r in shp.read.format("shapefile").load(path).collect()) == [(0, "é"), (2, "é")]
    assert {r["t"] for r in shp.read.format("shapefile").option("encoding", "cp1251").load(path).collect()} == {"й"}


def test_shells_and_their_holes():
    rings = [np.array(square(0.0)), np.array(square(5.0)), np.array([(5.2, 0.2), (5.4, 0.2), (5.4, 0.4), (5.2, 0.2)])]
    parts = spatial.polygons_of(shapefile._polygon(rings))
    assert [len(p) for p in parts] == [1, 2]


def test_files_are_found(tmp_path):
    for name in ("a/x.shp", "b/y.SHP", "_temporary/z.shp", "a/x.dbf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    names = lambda p: [f[len(str(tmp_path)) + 1 :] for f, _ in storage.listed(p, ".shp")]
    assert names(str(tmp_path)) == ["a/x.shp", "b/y.SHP"] and names(f"{tmp_path}/*/x*") == ["a/x.shp"] and names(f"{tmp_path}/a/x.shp") == ["a/x.shp"]
    assert storage.listed(f"file://{tmp_path}/a", ".shp")[0][0] == f"file://{tmp_path}/a/x.shp"
    with pytest.raises(FileNotFoundError):
        storage.listed(f"{tmp_path}/none", ".shp")


# --- scenes and tiles
@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    raster.register(spark)
    top = tmp_path_factory.mktemp("scenes")
    rng, cubes = np.random.default_rng(1), {}
    for m in (4, 10):
        cube = rng.integers(0, 5000, (4, 37, 11)).astype("<u2")
        cube[:, 3, 4] = 0
        (top / f"out_{m}").mkdir()
        cube.tofile(top / f"out_{m}" / "s.dat")
        cubes[m] = cube
    return str(top), cubes


def test_scenes_by_windows(spark, scenes):
    path, cubes = scenes
    df = spark.read.format("scene").option("width", 11).option("rows", 10).load(path)
    assert df.rdd.getNumPartitions() == 8
    for m, cube in cubes.items():
        rows = df.where(f"month = {m}").orderBy("y", "x").collect()
        assert len(rows) == 37 * 11 and all((r["blue"], r["nir"]) == ((None, None) if (r["y"], r["x"]) == (3, 4) else (float(cube[0, r["y"], r["x"]]), float(cube[3, r["y"], r["x"]]))) for r in rows)
    assert spark.read.format("scene").option("width", 11).option("masked", "false").load(path).where("blue is null").count() == 0


@pytest.mark.parametrize(("where", "windows", "rows"), [("month = 4", 4, 407), ("month in (4, 5)", 4, 407), ("month > 4", 4, 407), ("y >= 30", 2, 154), ("month = 10 and y = 12", 1, 11), ("y in (1, 35) and month < 5", 2, 22), ("month = 1", 1, 0), ("month <> 4", 8, 407)])
def test_windows_are_pruned(spark, scenes, where, windows, rows):
    df = spark.read.format("scene").option("width", 11).option("rows", 10).load(scenes[0]).where(where)
    assert df.rdd.getNumPartitions() == windows and df.count() == rows


def test_scene_of_another_width_is_an_error(spark, scenes):
    with pytest.raises(Exception, match="no rows of 4 bands"):
        spark.read.format("scene").option("width", 13).load(scenes[0]).count()


def test_month_of_a_path():
    assert [raster.month_of(p) for p in ("/a/out_1/x.dat", "/a/out_10/x.dat", "/out_4/b/out_7.dat", "/a/layout_3/x", "/a/b")] == [1, 10, 7, None, None]


def test_tiles_round_trip_and_failures(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = [(m, y, x, float(np.float32(rng.normal())), None if (x + y) % 7 == 0 else float(np.float32(rng.normal()))) for m in (4, 5, 6) for y in range(45) for x in range(23) if (y, x) != (3, 3) and not (m == 5 and y < 20)]
    df = spark.createDataFrame(cells, "month int, y int, x int, NDVI double, EVI double").repartition(5)
    (tmp_path / "m6.tif").mkdir()  # a folder in the way of one file
    (tmp_path / "m6.tif" / "x").write_bytes(b"")
    said = {r["path"].rsplit("/")[-1]: (r["ok"], r["error"]) for r in raster.write_tiles(df, "month", ["NDVI", "EVI"], str(tmp_path), "m{}.tif", tile=16).collect()}
    assert said["m4.tif"] == said["m5.tif"] == (True, None) and said["m6.tif"][0] is False and said["m6.tif"][1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m4.tif", "m5.tif", "m6.tif"]
    (tmp_path / "m6.tif" / "x").unlink()
    (tmp_path / "m6.tif").rmdir()
    got = {(r["path"][-6:-4], r["y"], r["x"]): (r["NDVI"], r["EVI"]) for r in raster.read_tiles(spark, str(tmp_path), ["NDVI", "EVI"]).collect()}
    assert got == {(f"m{m}", y, x): (a, b) for m, y, x, a, b in cells if m != 6}
    tags = raster.read_directory(str(tmp_path / "m4.tif"))
    assert (tags[256][0], tags[257][0], len(tags[324])) == (23, 45, 12)


# --- ledgers
def test_months_and_types(spark, tmp_path):
    from fieldloom.sources import files

    texts = {"out_4": "parcel_id,a,b,c,d,e\n007,1,true,x,1.5,\n12.0,,FALSE,2,3,\n", "out_10": "parcel_id,a,f,b\n9,99999999999999999999,1e3,\n8,3, 4 ,true\n", "out_5": "", "out_x": "parcel_id\n1\n", "out_7": "parcel_id,a\n"}
    for m, text in texts.items():
        (tmp_path / f"F_{m}.csv").write_text(text)
    found = files.find_months(spark, str(tmp_path), "F_out_").collect()
    assert [r["month"] for r in found] == [4, 7, 10]
    df = files.read_months(spark, str(tmp_path), "F_out_")
    assert dict(df.dtypes) == {"month": "int", "parcel_id": "string", "a": "double", "b": "boolean", "c": "string", "d": "double", "e": "string", "f": "double"}
    rows = {r["parcel_id"]: r for r in df.collect()}
    assert rows.keys() == {"007", "12.0", "9", "8"} and rows["8"]["f"] == 4.0 and rows["12.0"]["a"] is None and rows["12.0"]["b"] is False and rows["9"]["month"] == 10
    four = files.read_typed(spark, str(tmp_path / "F_out_4.csv"))
    assert dict(four.dtypes)["a"] == "bigint" and four.columns == ["parcel_id", "a", "b", "c", "d", "e"]
    with pytest.raises(FileNotFoundError):
        files.read_months(spark, str(tmp_path), "F_none_")


def test_export_join_and_fill(spark):
    from fieldloom.functions import columns as C

    layer = spark.createDataFrame([(1, "old", " 7.0", b"g"), (2, "old", "8", None)], "area int, Reason string, DKM string, geometry binary")
    ledger = spark.createDataFrame([("7", "r", float("nan")), ("8.0", None, 0.5), ("9", "z", 1.0)], "parcel_id string, REASON string, Margin double")
    out = C.export_join(layer, ledger, {"REASON": "why", "Margin": "margin"}, ["parcel_id", "why", "margin", "geometry"])
    assert sorted(map(tuple, out.collect())) == [("7", "r", -9999.0, b"g"), ("8", "", 0.5, None)]
    with pytest.raises(ValueError):
        C.export_join(layer, ledger.drop("parcel_id"), {}, ["parcel_id"])


def test_config_paths(tmp_path):
    from fieldloom.sources.config import Config

    (tmp_path / "c.toml").write_text('[paths]\ndate_out_dir = "o"\nparcel_shp = "/abs/p.shp"\ndate_out_non_agri_dir = "n"\n')
    c = Config.load(str(tmp_path / "c.toml"))
    assert c.split_report("r.csv") == tmp_path / "o/split_reports/r.csv" and str(c.parcel_shp) == "/abs/p.shp" and c.date_out_non_agri("a", "b") == tmp_path / "n/a/b"
    with pytest.raises(AttributeError):
        c.agri_parcels_shp  # noqa: B018
