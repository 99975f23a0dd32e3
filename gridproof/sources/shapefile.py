"""Shapefiles: polygons by byte ranges of the .shp file, with columns of the .dbf file.

A Python data source.  The index (.shx) tells where each record starts, so records
are dealt to tasks in runs of about ``partbytes``, and a task reads its own run of
both files alone.  Only asked columns are parsed, a box filter skips records by
the box in their header before any point is read, and ``rows`` keeps a range of record numbers.
Files are opened by pyarrow, so the path is one that it knows.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridproof.functions import geometry, overlay
from gridproof.sources.geoparquet import _opened

#: Polygon kinds (plain, with Z, with M), and sizes of headers.
POLYGONS = (5, 15, 25)
HEADER, RECORD = 100, 8
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_GEOMETRY = "record long, part int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"
_GEOMETRY_ARROW = [("record", pa.int64()), ("part", pa.int32()), ("ring", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))] + [(k, pa.float64()) for k in geometry.BOX]
_KINDS = {"C": ("string", pa.string()), "D": ("date", pa.date32()), "L": ("boolean", pa.bool_())}


def _read(path: str, start: int = 0, size: int | None = None) -> bytes:
    fs, name = _opened(path)
    with fs.open_input_file(name) as f:
        if size is None:
            size = f.size() - start
        f.seek(start)
        return f.read(size)


def index(path: str) -> np.ndarray:
    """Start and size in bytes of each record's content, after its header."""
    data = np.frombuffer(_read(f"{path}.shx", HEADER), ">i4").reshape(-1, 2).astype(np.int64)
    return np.stack([2 * data[:, 0] + RECORD, 2 * data[:, 1]], 1)


def columns(path: str) -> tuple[int, int, list[tuple[str, str, int, int, int]]]:
    """(header bytes, record bytes, columns as name, kind, place, width, decimals) of the .dbf file."""
    head = _read(f"{path}.dbf", 0, 32)
    size, width = struct.unpack_from("<HH", head, 8)
    fields, at, data = [], 1, _read(f"{path}.dbf", 32, size - 32)
    for k in range(0, len(data) - 31, 32):
        if data[k] == 0x0D:
            break
        name, kind, n, decimals = data[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(data[k + 11]), data[k + 16], data[k + 17]
        fields.append((name, kind, at, n, decimals))
        at += n
    return size, width, fields


def _kind(field: tuple[str, str, int, int, int]) -> tuple[str, pa.DataType]:
    _, kind, _, width, decimals = field
    if kind in "NF":
        return ("long", pa.int64()) if kind == "N" and not decimals and width < 19 else ("double", pa.float64())
    return _KINDS.get(kind, _KINDS["C"])


def _value(raw: bytes, kind: pa.DataType, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if kind == pa.string():
        return text or None
    if not text or text.strip("*") == "" or text == "?":
        return None
    if kind == pa.bool_():
        return text in "YyTt"
    try:
        if kind == pa.date32():
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        return int(text) if kind == pa.int64() else float(text)
    except ValueError:
        return None


def polygons_of(content: bytes) -> list[list[np.ndarray]]:
    """Polygons [outer ring, *holes] of a record; in this format outer rings run clockwise."""
    parts, points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", parts, 44)
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts)
    z = xy[::2] + 1j * xy[1::2]
    rings = [r for r in np.split(z, starts[1:]) if len(r) >= 4 and np.isfinite(r).all()]
    shells = [[r] for r in rings if overlay.signed_area(r[:-1]) < 0]
    for hole in (r for r in rings if overlay.signed_area(r[:-1]) > 0):
        size, inside = overlay.signed_area(hole[:-1]), overlay.inner_point(hole[:-1])
        around = [s for s in shells if -overlay.signed_area(s[0][:-1]) > size and overlay.holds(s[0][:-1], inside)]
        home = min(around, key=lambda s: -overlay.signed_area(s[0][:-1]), default=None)
        # a hole outside of all is a ring drawn the wrong way
        if home is None:
            shells.append([hole])
        else:
            home.append(hole)
    return shells


class _Run(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"].removesuffix(".shp")
        self.part_bytes, self.encoding = int(options.get("partbytes", 16 << 20)), options.get("encoding", "utf-8")
        self.box = [float(v) for v in options["bounds"].split(",")] if options.get("bounds") else None
        self.names = [f.name for f in schema.fields][len(_GEOMETRY_ARROW) :]

    def partitions(self):
        at = index(self.path)
        if not len(at):
            return [_Run(0, 0)]
        run = (np.cumsum(at[:, 1] + RECORD) - 1) // self.part_bytes
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        return [_Run(int(a), int(b)) for a, b in zip(first, [*first[1:], len(at)], strict=True)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        first, last = partition.first, partition.last
        head, width, fields = columns(self.path)
        own = [(f, _kind(f)[1]) for f in fields if f[0] in self.names]
        schema = pa.schema(_GEOMETRY_ARROW + [(f[0], k) for f, k in own])
        if first == last:
            return
        at = index(self.path)[first:last]
        start = int(at[0, 0])
        shapes = memoryview(_read(f"{self.path}.shp", start, int(at[-1].sum()) - start))
        table = memoryview(_read(f"{self.path}.dbf", head + first * width, (last - first) * width)) if own else None
        rows: list[dict] = []
        for k, (offset, size) in enumerate(at.tolist()):
            content = bytes(shapes[offset - start : offset - start + size])
            if len(content) < 44 or int.from_bytes(content[:4], "little") not in POLYGONS:
                continue
            x0, y0, x1, y1 = struct.unpack_from("<4d", content, 4)
            b = self.box
            if b and not (x0 <= b[2] and x1 >= b[0] and y0 <= b[3] and y1 >= b[1]):
                continue
            if table is not None and table[k * width : k * width + 1] == b"*":
                continue
            more = {f[0]: _value(bytes(table[k * width + f[2] : k * width + f[2] + f[3]]), kind, self.encoding) for f, kind in own}
            for part, rings in enumerate(polygons_of(content)):
                points = [[{"x": float(z.real), "y": float(z.imag)} for z in r] for r in rings]
                lo, hi = rings[0], rings[0]
                rows.append({"record": first + k, "part": part, "ring": points[0], "holes": points[1:], "xmin": lo.real.min(), "ymin": lo.imag.min(), "xmax": hi.real.max(), "ymax": hi.imag.max()} | more)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Shapefile(DataSource):
    """``format("shapefile")``: options path, columns (by commas), bounds (xmin,ymin,xmax,ymax), partbytes, encoding."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = columns(self.options["path"].removesuffix(".shp"))[2]
        asked = self.options.get("columns")
        kept = [f for f in fields if asked is None or f[0] in asked.split(",")]
        return _GEOMETRY + "".join(f", `{f[0]}` {_kind(f)[0]}" for f in kept)

    def reader(self, schema):
        return _Reader(self.options, schema)


def read_shapefile(spark: SparkSession, path: str, names: list[str] | None = None, bounds: tuple[float, float, float, float] | None = None, part_bytes: int = 16 << 20, encoding: str = "utf-8") -> DataFrame:
    """record, part, ring, holes, box and the asked columns: a row for each polygon of a shapefile.

    Deleted and null records and other kinds than polygons go; Z and M are left
    out.  With ``bounds`` only polygons whose box meets them are kept.  Values
    that can't be read are null.
    """
    spark.dataSource.register(Shapefile)
    options = {"path": path, "partbytes": part_bytes, "encoding": encoding} | ({"columns": ",".join(names)} if names is not None else {}) | ({"bounds": ",".join(map(repr, bounds))} if bounds else {})
    df = spark.read.format("shapefile").options(**options).load()
    if bounds:
        x0, y0, x1, y1 = bounds
        df = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    return df

