"""Rasters in and out: windows of raw scenes as a data source, and tiled float rasters written by tasks.

Scenes: spark.read.format("scene") with the options width, bands (4), rows (of one window) and masked. A file holds its bands one after
the other, as little-endian 16-bit numbers. Each window of rows of a file is a partition that reads only its own bytes of each band,
so a file may be larger than a task's memory. The month comes from the path (`out_7/`). Filters on month and y that compare with a
literal are taken over by the source (with spark.sql.python.filterPushdown.enabled) and leave out windows before they are read.

Tiles: `write_tiles` packs 256 x 256 tiles of each raster in tasks, sums their sizes to offsets, lets tasks write them to their places,
and writes each file's directory last, so a file is whole or isn't published. Files are TIFF (float32, Deflate, one plane for each
band, nodata NaN). The result has a row (path, ok, error) for each file.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.shared import stored
from .storage import listed, opened, read_at

BANDS = ("blue", "green", "red", "nir")
TILE = 256


def month_of(path: str) -> int | None:
    """The number of the last folder or file named out_{number}: out_1 isn't found in out_10."""
    found = re.findall(r"(?<![A-Za-z0-9])out_(\d+)(?!\d)", path)
    return int(found[-1]) if found else None


# --- scenes in --------------------------------------------------------------------------------------------------------
@dataclass
class Window(InputPartition):
    path: str
    month: int | None
    top: int
    bottom: int
    height: int


def _between(filters: Sequence[Filter], column: str) -> tuple[float, float, set | None]:
    """The least and most value, and the listed ones, that filters leave of a column."""
    lo, hi, some = -math.inf, math.inf, None
    for f in filters:
        if f.attribute != (column,):
            continue
        match f:
            case EqualTo():
                lo, hi = max(lo, f.value), min(hi, f.value)
            case GreaterThan():
                lo = max(lo, math.nextafter(f.value, math.inf))
            case GreaterThanOrEqual():
                lo = max(lo, f.value)
            case LessThan():
                hi = min(hi, math.nextafter(f.value, -math.inf))
            case LessThanOrEqual():
                hi = min(hi, f.value)
            case In():
                some = set(f.value) if some is None else some & set(f.value)
    return lo, hi, some


class SceneReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.fields, self.path = schema, options["path"]
        self.width, self.bands, self.rows = int(options["width"]), int(options.get("bands", 4)), int(options.get("rows", 512))
        self.masked = options.get("masked", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute in (("month",), ("y",))
            if known and all(isinstance(v, int) for v in (f.value if isinstance(f, In) else [f.value])):
                self.filters.append(f)
            if not known or f.attribute == ("y",):  # of y only whole windows are left out
                yield f

    def partitions(self) -> list[Window]:
        m_lo, m_hi, months = _between(self.filters, "month")
        y_lo, y_hi, ys = _between(self.filters, "y")
        out = []
        for path, size in listed(self.path, ".dat"):
            month = month_of(path)
            line = 2 * self.bands * self.width
            if size % line:
                raise ValueError(f"{path}: {size} bytes are no rows of {self.bands} bands of {self.width} pixels")
            chosen = month is not None and m_lo <= month <= m_hi and (months is None or month in months)
            if not chosen and any(f.attribute == ("month",) for f in self.filters):
                continue
            height = size // line
            for top in range(0, height, self.rows):
                bottom = min(top + self.rows, height)
                if bottom - 1 >= y_lo and top <= y_hi and (ys is None or any(top <= y < bottom for y in ys)):
                    out.append(Window(path, month, top, bottom, height))
        return out or [Window("", None, 0, 0, 0)]

    def read(self, w: Window) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        step = max(1, 65_536 // self.width)
        for top in range(w.top, w.bottom, step):
            n = min(step, w.bottom - top)
            cube = np.stack([np.frombuffer(read_at(w.path, 2 * self.width * (b * w.height + top), 2 * self.width * n), "<u2") for b in range(self.bands)])
            none = (cube == 0).all(0) if self.masked else np.zeros(cube.shape[1], bool)
            y, x = np.divmod(np.arange(n * self.width), self.width)
            made = {"path": pa.array([w.path] * len(x)), "month": pa.array([w.month] * len(x), pa.int32()), "y": pa.array((y + top).astype(np.int32)), "x": pa.array(x.astype(np.int32))}
            made |= {b: pa.array(cube[i].astype(float), mask=none) for i, b in enumerate(BANDS[: self.bands])}
            yield pa.RecordBatch.from_arrays([made[c] for c in schema.names], schema=schema)


class Scene(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene"

    def schema(self) -> str:
        bands = BANDS[: int(self.options.get("bands", 4))]
        return "path string, month int, y int, x int, " + ", ".join(f"{b} double" for b in bands)

    def reader(self, schema: T.StructType) -> SceneReader:
        return SceneReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Scene)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- tiles out --------------------------------------------------------------------------------------------------------


def packed_tiles(cells: DataFrame, key: str, bands: Sequence[str], tile: int = TILE) -> DataFrame:
    """(key, band, ty, tx, bytes): cells (key, y, x, bands) as compressed tiles. A tile's cells meet in one task, never a raster's; the
    last cell wins where one comes twice."""
    schema = T.StructType([cells.schema[key], *(T.StructField(n, T.IntegerType()) for n in ("band", "ty", "tx")), T.StructField("bytes", T.BinaryType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        y, x = group["y"].to_numpy() % tile, group["x"].to_numpy() % tile
        out = []
        for i, band in enumerate(bands):
            values = np.full((tile, tile), np.nan, "<f4")
            values[y, x] = group[band].to_numpy(float)
            out.append((group[key].iloc[0], i, group["ty"].iloc[0], group["tx"].iloc[0], zlib.compress(values.tobytes(), 6)))
        return pd.DataFrame(out, columns=[key, "band", "ty", "tx", "bytes"])

    placed = cells.select(key, "y", "x", *bands, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    return placed.groupBy(key, "ty", "tx").applyInPandas(pack, schema)


def directory(width: int, height: int, bands: int, tile: int, offsets: np.ndarray, sizes: np.ndarray, at: int) -> bytes:
    """The TIFF directory that begins at byte `at`, for tiles in order of band, row and column; 64-bit offsets."""
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [32] * bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [bands]), (284, 3, [2]), (322, 4, [tile]), (323, 4, [tile]), (324, 16, offsets), (325, 16, sizes), (338, 3, [0] * (bands - 1)), (339, 3, [3] * bands), (42113, 2, b"nan\0")]
    tags = [t for t in tags if len(t[2])]
    head, tail = struct.pack("<Q", len(tags)), b""
    rest = at + 8 + 20 * len(tags) + 8
    for tag, kind, values in tags:
        raw = values if isinstance(values, bytes) else np.asarray(values, {3: "<u2", 4: "<u4", 16: "<u8"}[kind]).tobytes()
        head += struct.pack("<HHQ", tag, kind, len(values)) + (raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", rest + len(tail)))
        tail += b"" if len(raw) <= 8 else raw + b"\0" * (-len(raw) % 8)
    return head + struct.pack("<Q", 0) + tail


def write_tiles(cells: DataFrame, key: str, bands: Sequence[str], path: str, name: str = "{}.tif", tile: int = TILE) -> DataFrame:
    """Writes a raster for each key under path, a folder that all tasks can write to at given places, and gives (path, ok, error).
    A file that fails is a row with its error and isn't published; one that exists already is replaced."""
    spark = cells.sparkSession
    extent = cells.groupBy(key).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    tiles = stored(packed_tiles(cells, key, bands, tile))
    order = W.partitionBy(key).orderBy("band", "ty", "tx").rowsBetween(W.unboundedPreceding, -1)
    sized = tiles.select(key, "band", "ty", "tx", F.length("bytes").cast("long").alias("size"))
    placed = stored(sized.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)) + 16))
    run, n_bands = uuid.uuid4().hex, len(bands)
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError("tiles are written at given places, which needs a mounted path")
    temporary = lambda k: f"{folder}/.{run}-{name.format(k)}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            keys, said = b.column(key).to_pylist(), []
            for k, offset, raw in zip(keys, b.column("offset").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                try:
                    f = os.open(temporary(k), os.O_WRONLY | os.O_CREAT, 0o644)
                    try:
                        os.pwrite(f, raw, offset)
                    finally:
                        os.close(f)
                    said.append(None)
                except OSError as e:
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(said, pa.string())], [key, "error"])

    put_schema = T.StructType([cells.schema[key], T.StructField("error", T.StringType())])
    done = stored(tiles.join(placed, [key, "band", "ty", "tx"]).select(key, "offset", "bytes").mapInArrow(put, put_schema))
    errors = done.groupBy(key).agg(F.max("error").alias("error"))
    lists = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("band", "ty", "tx", "offset", "size"))).alias("tiles"))  # places and sizes alone

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k, target = getattr(r, key), f"{folder}/{name.format(getattr(r, key))}"
                error = r.error
                try:
                    if error is None:
                        across, down = -(-r.width // tile), -(-r.height // tile)
                        offsets, sizes = np.zeros((2, n_bands * down * across), np.int64)
                        end = 16
                        for t in r.tiles:
                            i = (t["band"] * down + t["ty"]) * across + t["tx"]
                            offsets[i], sizes[i], end = t["offset"], t["size"], max(end, t["offset"] + t["size"])
                        at = -(-end // 8) * 8
                        with open(temporary(k), "r+b") as f:
                            f.seek(at)
                            f.write(directory(r.width, r.height, n_bands, tile, offsets, sizes, at))
                            f.seek(0)
                            f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at))
                        os.replace(temporary(k), target)
                except OSError as e:
                    error = str(e)
                if error is not None and os.path.exists(temporary(k)):
                    os.remove(temporary(k))
                out.append((target, error is None, error))
            yield pd.DataFrame(out, columns=["path", "ok", "error"])

    whole = extent.join(errors, key).join(lists, key).select(F.col(key), F.col("height").cast("long"), F.col("width").cast("long"), "error", "tiles")
    return stored(whole.mapInPandas(finish, "path string, ok boolean, error string"))


# --- tiles in ---------------------------------------------------------------------------------------------------------
def read_directory(path: str) -> dict[int, np.ndarray]:
    """The tags of a TIFF that `write_tiles` has made."""
    mark, version, _, _, at = struct.unpack("<2sHHHQ", read_at(path, 0, 16))
    if (mark, version) != (b"II", 43):
        raise ValueError(f"{path} is no little-endian TIFF with 64-bit offsets")
    n = struct.unpack("<Q", read_at(path, at, 8))[0]
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack("<HHQ", (raw := read_at(path, at + 8 + 20 * i, 20))[:12])
        size = {2: 1, 3: 2, 4: 4, 16: 8}[kind] * count
        data = raw[12 : 12 + size] if size <= 8 else read_at(path, struct.unpack("<Q", raw[12:])[0], size)
        out[tag] = np.frombuffer(data, {2: "S1", 3: "<u2", 4: "<u4", 16: "<u8"}[kind])
    return out


def read_tiles(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    """(path, y, x, bands) of the rasters under path, read tile by tile in tasks; cells without a value in any band aren't rows."""
    work = []
    for p, _ in listed(path, ".tif"):
        tags = read_directory(p)
        work += [(p, i) for i in range(-(-int(tags[256][0]) // int(tags[322][0])) * -(-int(tags[257][0]) // int(tags[323][0])))]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, part in b.groupby("path"):
                tags = read_directory(p)
                width, tile = int(tags[256][0]), int(tags[322][0])
                across, each = -(-width // tile), len(tags[324]) // len(bands)
                for i in part["tile"]:
                    planes = [np.frombuffer(zlib.decompress(read_at(p, int(tags[324][k * each + i]), int(n))), "<f4") if (n := tags[325][k * each + i]) else np.full(tile * tile, np.nan, "<f4") for k in range(len(bands))]
                    y, x = np.divmod(np.arange(tile * tile), tile)
                    rows = pd.DataFrame({"path": p, "y": (y + i // across * tile).astype(np.int32), "x": (x + i % across * tile).astype(np.int32), **dict(zip(bands, planes, strict=True))})
                    yield rows[~np.isnan(np.stack(planes)).all(0)]

    frame = spark.createDataFrame(work, "path string, tile int").repartition("path", "tile")
    return frame.mapInPandas(cells, "path string, y int, x int, " + ", ".join(f"{b} float" for b in bands))
