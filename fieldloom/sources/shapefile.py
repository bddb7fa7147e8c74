"""Shapefiles as a data source: spark.read.format("shapefile") and df.write.format("shapefile").

Reading: the driver takes field names and types from the header of the first .dbf and counts records by the size of each .shx; tasks
read ranges of records by their offsets there, so one large file is read by many tasks and nobody holds it whole. Geometry comes as
WKB (points, lines, polygons and multipoints; z and m are dropped), attributes typed: text, whole numbers, doubles, dates, booleans.
Deleted records are left out. Options: records (of one task), encoding (else what a .cpg says, else UTF-8).

Writing: each task writes shapefiles of its own, of at most `records` rows, under a temporary folder; the commit publishes all of them
under the target at once, or none. Fields are as wide as their longest value, and names have at most ten characters.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.spatial import contains, multipolygon_wkb, polygon_wkb, polygons_of
from .storage import listed, opened, read_at, size_of

#: Records decoded at a time.
BATCH = 1_024


# --- attributes -------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    width: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind == "N" and not self.decimals and self.width <= 18:
            return T.LongType()
        return {"N": T.DoubleType(), "F": T.DoubleType(), "D": T.DateType(), "L": T.BooleanType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0")
        try:
            match self.type:
                case T.LongType():
                    return int(text)
                case T.DoubleType():
                    return float(text)
                case T.DateType():
                    return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
                case T.BooleanType():
                    return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        except ValueError:  # blank or stars
            return None
        return text or None


def table_head(path: str) -> tuple[int, int, list[Field]]:
    """(bytes of the header, bytes of a record, fields)."""
    _, head, size = struct.unpack_from("<IHH", read_at(path, 0, 32), 4)
    raw, fields, at = read_at(path, 0, head), [], 32
    while at < head and raw[at] != 0x0D:
        fields.append(Field(raw[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return head, size, fields


# --- shapes -----------------------------------------------------------------------------------------------------------
def _line(xy: np.ndarray) -> bytes:
    return struct.pack("<BII", 1, 2, len(xy)) + xy.astype("<f8").tobytes()


def _area(r: np.ndarray) -> float:
    return float(np.dot(r[:-1, 0], r[1:, 1]) - np.dot(r[1:, 0], r[:-1, 1]))


def _polygon(rings: list[np.ndarray]) -> bytes:
    """Shells run clockwise; a hole belongs to the first shell that holds one of its corners."""
    shells = [[r] for r in rings if _area(r) <= 0] or [[rings[0]]]
    for r in rings:
        if _area(r) > 0 and r is not shells[0][0]:
            home = next((s for s in shells if contains([s[0]], r[:, 0], r[:, 1]).any()), shells[0])
            home.append(r)
    plain = [[list(map(tuple, r.tolist())) for r in s] for s in shells]
    return polygon_wkb(plain[0]) if len(plain) == 1 else multipolygon_wkb(plain)


def shape_wkb(body: bytes) -> bytes | None:
    """WKB of one record's content; null for null shapes, ValueError for unknown types."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return None
    match kind % 10:
        case 1:
            return struct.pack("<BI", 1, 1) + body[4:20]
        case 8:
            n = struct.unpack_from("<i", body, 36)[0]
            return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI", 1, 1) + body[40 + 16 * i : 56 + 16 * i] for i in range(n))
        case 3 | 5:
            parts, points = struct.unpack_from("<ii", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind % 10 == 5:
                return _polygon(rings) if rings else None
            return _line(rings[0]) if len(rings) == 1 else struct.pack("<BII", 1, 5, len(rings)) + b"".join(map(_line, rings))
    raise ValueError(f"shape of type {kind}")


def shape_body(wkb: bytes | None) -> tuple[int, bytes, tuple[float, float, float, float] | None]:
    """(type, record content, box) of a point, line or polygon; ValueError for others."""
    if wkb is None:
        return 0, struct.pack("<i", 0), None
    e = "<" if wkb[0] else ">"
    kind = struct.unpack_from(e + "I", wkb, 1)[0]
    if kind == 1:
        x, y = struct.unpack_from(e + "dd", wkb, 5)
        return 1, struct.pack("<idd", 1, x, y), (x, y, x, y)
    if kind == 2:
        n = struct.unpack_from(e + "I", wkb, 5)[0]
        code, parts = 3, [np.frombuffer(wkb, e + "f8", 2 * n, 9).reshape(-1, 2)]
    elif kind == 5:
        code, parts, at = 3, [], 9
        for _ in range(struct.unpack_from(e + "I", wkb, 5)[0]):
            f = "<" if wkb[at] else ">"
            n = struct.unpack_from(f + "I", wkb, at + 5)[0]
            parts.append(np.frombuffer(wkb, f + "f8", 2 * n, at + 9).reshape(-1, 2))
            at += 9 + 16 * n
    else:  # shells clockwise, holes the other way
        code, parts = 5, [r if (_area(r) <= 0) == (k == 0) else r[::-1] for rings in polygons_of(wkb) for k, r in enumerate(rings)]
    if not parts:
        return 0, struct.pack("<i", 0), None
    xy = np.concatenate(parts)
    box = (*xy.min(0).tolist(), *xy.max(0).tolist())
    starts = np.cumsum([0, *(len(r) for r in parts[:-1])]).astype("<i4").tobytes()
    return code, struct.pack("<i4dii", code, *box, len(parts), len(xy)) + starts + xy.astype("<f8").tobytes(), box


# --- reading ----------------------------------------------------------------------------------------------------------
@dataclass
class Records(InputPartition):
    stem: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.fields, self.path = schema, options["path"]
        self.records, self.encoding = int(options.get("records", 50_000)), options.get("encoding")

    def partitions(self) -> list[Records]:
        out = []
        for shp, _ in listed(self.path, ".shp"):
            n = (size_of(shp[:-4] + ".shx") - 100) // 8
            out += [Records(shp[:-4], lo, min(lo + self.records, n)) for lo in range(0, n, self.records)]
        return out or [Records("", 0, 0)]

    def _encoding(self, stem: str) -> str:
        if self.encoding:
            return self.encoding
        try:
            name = read_at(stem + ".cpg", 0, 64).decode("ascii", "ignore").strip()
            return f"cp{name}" if name.isdigit() else name or "utf-8"
        except FileNotFoundError:
            return "utf-8"

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        if partition.first == partition.last:
            return
        stem, encoding = partition.stem, self._encoding(partition.stem)
        head, size, fields = table_head(stem + ".dbf")
        at, where = 1, {}
        for f in fields:
            where[f.name] = (f, at)
            at += f.width
        system, place = opened(stem)
        with system.open_input_file(place + ".shp") as shp, system.open_input_file(place + ".shx") as shx, system.open_input_file(place + ".dbf") as dbf:
            for lo in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - lo)
                index = np.frombuffer(shx.read_at(8 * n, 100 + 8 * lo), ">i4").reshape(-1, 2).astype(np.int64) * 2
                rows = dbf.read_at(size * n, head + size * lo)
                kept = [i for i in range(n) if rows[i * size : i * size + 1] != b"*"]
                columns = []
                for field in schema:
                    if field.name == "geometry":
                        columns.append(pa.array([shape_wkb(shp.read_at(int(index[i, 1]), int(index[i, 0]) + 8)) for i in kept], field.type))
                    elif field.name in where:
                        f, a = where[field.name]
                        columns.append(pa.array([f.value(rows[i * size + a : i * size + a + f.width], encoding) for i in kept], field.type))
                    else:  # a field that this file lacks
                        columns.append(pa.nulls(len(kept), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


# --- writing ----------------------------------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _cell(v, kind: str) -> str:
    if v is None:
        return ""
    if kind == "L":
        return "T" if v else "F"
    return v.strftime("%Y%m%d") if isinstance(v, date) else repr(float(v)) if isinstance(v, Decimal) else str(v)


class Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        if long := [c for c in schema.names if len(c.encode()) > 10]:
            raise ValueError(f"names of more than 10 characters: {', '.join(long)}")
        if "geometry" not in schema.names:
            raise ValueError("missing columns: geometry")
        self.path, self.overwrite, self.records = options["path"].rstrip("/"), overwrite, int(options.get("records", 50_000))
        self.names = [c for c in schema.names if c != "geometry"]
        whole, real = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
        self.kinds = {f.name: "N" if isinstance(f.dataType, whole) else "F" if isinstance(f.dataType, real) else "L" if isinstance(f.dataType, T.BooleanType) else "D" if isinstance(f.dataType, T.DateType) else "C" for f in schema}
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        system, at = opened(self.path)
        info = system.get_file_info(at)
        if info.type != fs.FileType.NotFound and not overwrite and any(f.path.lower().endswith(".shp") for f in system.get_file_info(fs.FileSelector(at))):
            raise FileExistsError(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        system, at = opened(self.temporary)
        system.create_dir(at, recursive=True)
        names, held = [], []
        for row in rows:
            held.append(row)
            if len(held) == self.records:
                names.append(self._file(held))
                held = []
        if held:
            names.append(self._file(held))
        return Written(names)

    def _file(self, rows: list[Row]) -> str:
        name = f"part-{uuid.uuid4().hex}"
        system, at = opened(f"{self.temporary}/{name}")
        shapes = [shape_body(None if r["geometry"] is None else bytes(r["geometry"])) for r in rows]
        codes = {k for k, _, _ in shapes} - {0}
        if len(codes) > 1:
            raise ValueError(f"a shapefile holds shapes of one type, not {sorted(codes)}")
        boxes = np.array([b for _, _, b in shapes if b] or [(0.0,) * 4])
        sizes = np.array([len(b) // 2 for _, b, _ in shapes])
        offsets = 50 + np.cumsum(sizes + 4) - sizes - 4
        head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<ii8d", 1000, max(codes, default=0), *boxes[:, :2].min(0), *boxes[:, 2:].max(0), 0, 0, 0, 0)
        with system.open_output_stream(at + ".shp") as f:
            f.write(head(int(50 + (sizes + 4).sum())))
            for i, (_, body, _) in enumerate(shapes):
                f.write(struct.pack(">ii", i + 1, len(body) // 2) + body)
        with system.open_output_stream(at + ".shx") as f:
            f.write(head(50 + 4 * len(rows)) + np.stack([offsets, sizes], 1).astype(">i4").tobytes())
        cells = {c: [_cell(r[c], self.kinds[c]).encode() for r in rows] for c in self.names}
        if wide := [c for c, vs in cells.items() if max(map(len, vs)) > 254]:
            raise ValueError(f"values of more than 254 bytes: {', '.join(wide)}")
        width = {c: max(8 if self.kinds[c] == "D" else 1, *map(len, vs)) for c, vs in cells.items()}
        with system.open_output_stream(at + ".dbf") as f:
            f.write(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(self.names), 1 + sum(width.values())))
            f.write(b"".join(c.encode().ljust(11, b"\0") + self.kinds[c].encode() + b"\0" * 4 + bytes([width[c], 6 if self.kinds[c] == "F" else 0]) + b"\0" * 14 for c in self.names) + b"\r")
            for i in range(len(rows)):
                f.write(b" " + b"".join(cells[c][i].rjust(width[c]) if self.kinds[c] in "NF" else cells[c][i].ljust(width[c]) for c in self.names))
            f.write(b"\x1a")
        with system.open_output_stream(at + ".cpg") as f:
            f.write(b"UTF-8")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        """Publishes the files of the tasks that ended well; only their names are here."""
        system, at = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and posixpath.splitext(f.path)[1].lower() in (".shp", ".shx", ".dbf", ".cpg"):
                    system.delete_file(f.path)
        _, temporary = opened(self.temporary)
        for m in messages:
            for name in m.names if m else []:
                for suffix in (".cpg", ".dbf", ".shx", ".shp"):  # the .shp last, by which readers find it
                    system.move(f"{temporary}/{name}{suffix}", f"{at}/{name}{suffix}")
        self._clear(system, temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, temporary = opened(self.temporary)
        self._clear(system, temporary)

    @staticmethod
    def _clear(system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        first = listed(self.options["path"], ".shp")[0][0]
        _, _, fields = table_head(first[:-4] + ".dbf")
        return T.StructType([*(T.StructField(f.name, f.type) for f in fields), T.StructField("geometry", T.BinaryType())])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shapefile)
