"""GeoParquet: footprints as WKB with a covering box, both ways.

Reading is Spark's own parquet scan, so columns, partitions and row groups are
pruned by it; the covering box is an ordinary struct column.  WKB is decoded
batch by batch, simple polygons all at once.  Spark's writer can't put the
``geo`` entry into footers, so writing is a Python data source: each task writes
its own file beside the table, and only files of tasks that succeeded are moved in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridproof.functions import geometry, polygons
from gridproof.operators.extract import bbox_filter

RING = "array<struct<x:double,y:double>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_RING, _HOLES = pa.list_(_POINT), pa.list_(pa.list_(_POINT))
_COVER = pa.struct([(k, pa.float64()) for k in geometry.BOX])
#: Kinds of WKB by number.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
#: Rows of a group, whose boxes decide whether it is read.
GROUP_ROWS = 10_000


def _rings_of(xy: np.ndarray, counts: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], fields=list(_POINT))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), points)


def _simple(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are little-endian plane polygons of one ring and of the right length."""
    size = np.diff(offsets)
    out = known & (size >= 13)
    head = np.zeros((len(size), 13), np.uint8)
    head[out] = data[offsets[:-1][out][:, None] + np.arange(13)]
    words = np.ascontiguousarray(head[:, 1:]).view("<u4")
    return out & (head[:, 0] == 1) & (words[:, 0] == 3) & (words[:, 1] == 1) & (size == 13 + 16 * words[:, 2].astype(np.int64)) & (words[:, 2] >= 4)


def _problem(data: bytes | None) -> str:
    if data is None:
        return "null"
    if len(data) < 5:
        return "broken"
    kind = int.from_bytes(data[1:5], "little" if data[0] == 1 else "big")
    name = KINDS.get((kind & 0xFFFF) % 1000)
    return f"kind {name}" if name not in (None, "Polygon", "MultiPolygon") else "broken"


def decode(df: DataFrame, column: str = "geometry") -> DataFrame:
    """df without the WKB column, with part (number of the polygon in its row), ring, holes and problem, a row for each polygon.

    Z and M are left out.  Null, broken and empty values and other kinds
    keep their row with a ``problem`` that says so, and null ring and holes.
    """
    at = df.columns.index(column)
    names = [c for c in df.columns if c not in (column, "part", "ring", "holes", "problem")]
    places = [df.columns.index(c) for c in names]

    def out(batch: pa.RecordBatch, source, part, ring: pa.Array, holes: pa.Array, problem) -> pa.RecordBatch:
        rows = batch.take(pa.array(source, pa.int64()))
        return pa.RecordBatch.from_arrays([*[rows.column(k) for k in places], pa.array(part, pa.int32()), ring, holes, pa.array(problem, pa.string())], [*names, "part", "ring", "holes", "problem"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wkb = batch.column(at).cast(pa.large_binary())
            offsets = np.frombuffer(wkb.buffers()[1], np.int64)[wkb.offset : wkb.offset + len(wkb) + 1]
            data = np.frombuffer(wkb.buffers()[2] or b"", np.uint8)
            simple = _simple(data, offsets, ~wkb.is_null().to_numpy(zero_copy_only=False)) if len(wkb) else np.zeros(0, bool)
            own = np.flatnonzero(simple)
            if len(own):
                size = np.diff(offsets)[own]
                each = np.repeat(offsets[:-1][own] + 13, size - 13)
                within = np.arange(len(each)) - np.repeat(np.cumsum(size - 13) - (size - 13), size - 13)
                xy = data[each + within].view("<f8").reshape(-1, 2)
                fine = np.bincount(np.repeat(np.arange(len(own)), (size - 13) // 16), ~np.isfinite(xy).all(1), len(own)) == 0
                ring = _rings_of(xy, (size - 13) // 16)
                none = pa.array([[]] * len(own), _HOLES)
                good = out(batch, own, np.zeros(len(own), np.int32), ring, none, [None] * len(own))
                yield good if fine.all() else good.filter(pa.array(fine))
                if not fine.all():
                    bad = own[~fine]
                    yield out(batch, bad, [0] * len(bad), pa.nulls(len(bad), _RING), pa.nulls(len(bad), _HOLES), ["not finite"] * len(bad))
            source, part, ring, holes, problem = [], [], [], [], []
            for k in np.flatnonzero(~simple).tolist():
                value = wkb[k].as_py()
                found = polygons.from_wkb(value) or []
                rings = [[r for r in p if len(r) >= 4] for p in found]
                rings = [p for p in rings if p]
                finite = all(np.isfinite(r).all() for p in rings for r in p)
                if not rings or not finite:
                    source, part, ring, holes = [*source, k], [*part, 0], [*ring, None], [*holes, None]
                    problem.append("not finite" if rings else "empty" if polygons.from_wkb(value) is not None else _problem(value))
                    continue
                for j, p in enumerate(rings):
                    points = [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]
                    source, part, ring, holes = [*source, k], [*part, j], [*ring, points[0]], [*holes, points[1:]]
                    problem.append(None)
            if source:
                yield out(batch, source, part, pa.array(ring, _RING), pa.array(holes, _HOLES), problem)

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return df.mapInArrow(run, f"{kinds}part int, ring {RING}, holes array<{RING}>, problem string")


def encode(df: DataFrame) -> DataFrame:
    """df with geometry (WKB) and bbox in place of ring, holes and box; rows without a ring of three points have nulls."""
    at = {c: k for k, c in enumerate(df.columns)}
    names = [c for c in df.columns if c not in ("ring", "holes", "geometry", "bbox", *geometry.BOX)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(at["ring"]).to_pylist()
            holes = batch.column(at["holes"]).to_pylist() if "holes" in at else [None] * len(rings)
            wkb, boxes = [], []
            for r, h in zip(rings, holes, strict=True):
                every = [p for p in (polygons.open_ring([(q["x"], q["y"]) for q in x]) for x in (r or [], *(h or []))) if len(p)]
                if not r or not every:
                    wkb.append(None)
                    boxes.append(None)
                    continue
                lo, hi = every[0].min(0), every[0].max(0)
                wkb.append(polygons.to_wkb(every))
                boxes.append({"xmin": lo[0], "ymin": lo[1], "xmax": hi[0], "ymax": hi[1]})
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in names], pa.array(wkb, pa.binary()), pa.array(boxes, _COVER)], [*names, "geometry", "bbox"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return df.mapInArrow(run, f"{kinds}geometry binary, bbox struct<{', '.join(f'{k}:double' for k in geometry.BOX)}>")


def projjson(epsg: int | None) -> dict | None:
    """CRS entry of degrees (None: longitude first) or of a WGS 84 UTM zone (326xx, 327xx)."""
    if epsg is None or epsg == 4326:
        return None
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"only degrees and UTM zones can be written, not EPSG:{epsg}")
    zone, south = epsg % 100, epsg > 32700

    def parameter(name, value, unit):
        return {"name": name, "value": value, "unit": unit}

    def axis(name, short, direction, unit):
        return {"name": name, "abbreviation": short, "direction": direction, "unit": unit}

    degree, ellipsoid = "degree", {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}
    base = {"type": "GeographicCRS", "name": "WGS 84", "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": ellipsoid}, "coordinate_system": {"subtype": "ellipsoidal", "axis": [axis("Geodetic latitude", "Lat", "north", degree), axis("Geodetic longitude", "Lon", "east", degree)]}}
    method = {"name": "Transverse Mercator", "id": {"authority": "EPSG", "code": 9807}}
    values = [("Latitude of natural origin", 0, degree), ("Longitude of natural origin", 6 * zone - 183, degree), ("Scale factor at natural origin", 0.9996, "unity"), ("False easting", 500000, "metre"), ("False northing", 10000000 if south else 0, "metre")]
    name = f"UTM zone {zone}{'S' if south else 'N'}"
    return {"type": "ProjectedCRS", "name": f"WGS 84 / {name}", "base_crs": base, "conversion": {"name": name, "method": method, "parameters": [parameter(*v) for v in values]}, "coordinate_system": {"subtype": "Cartesian", "axis": [axis("Easting", "E", "east", "metre"), axis("Northing", "N", "north", "metre")]}, "id": {"authority": "EPSG", "code": epsg}}


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.rows, self.epsg = int(options.get("grouprows", GROUP_ROWS)), options.get("epsg")
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        fs, root = _opened(self.path)
        column = {"encoding": "WKB", "geometry_types": ["Polygon"], "covering": {"bbox": {k: ["bbox", k] for k in geometry.BOX}}}
        crs = projjson(int(self.epsg) if self.epsg else None)
        geo = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column | ({"crs": crs} if crs else {})}}
        folder, name, out = f"{root}/_temporary-{self.job}", f"part-{uuid.uuid4().hex}.parquet", None
        held, n = [], 0

        def flush():
            out.write_table(pa.Table.from_batches(held), row_group_size=self.rows)

        for batch in iterator:
            if out is None:
                fs.create_dir(folder, recursive=True)
                schema = batch.schema.with_metadata((batch.schema.metadata or {}) | {b"geo": json.dumps(geo).encode()})
                out = pq.ParquetWriter(f"{folder}/{name}", schema, filesystem=fs, compression="zstd")
            held.append(batch.cast(out.schema) if batch.schema != out.schema else batch)
            n += batch.num_rows
            if n >= self.rows:
                flush()
                held, n = [], 0
        if out is None:
            return _Written([])
        if held:
            flush()
        out.close()
        return _Written([name])

    def commit(self, messages):
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File] if self.overwrite else []
        for name in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/_temporary-{self.job}/{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)
        self._clean(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        self._clean(*_opened(self.path))

    def _clean(self, fs, root):
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


class GeoParquetSink(DataSource):
    """``format("geoparquet_sink")``: options path, epsg, grouprows."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet_sink"

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options), overwrite)


def write_geoparquet(df: DataFrame, path: str, epsg: int | None = None, overwrite: bool = False, group_rows: int = GROUP_ROWS, cell: float = 1000.0) -> None:
    """Footprints (ring, perhaps holes, and more) as GeoParquet files in a folder, rows of near places together.

    ``epsg`` is a UTM zone, or None for degrees; ``cell`` is the side of the
    squares, in the same unit, whose rows lie together.  The path is one that
    pyarrow opens.  Without ``overwrite`` files are added to those there.
    """
    df.sparkSession.dataSource.register(GeoParquetSink)
    first = F.get("ring", F.lit(0))
    near = df.sortWithinPartitions(F.floor(first["y"] / cell), F.floor(first["x"] / cell))
    encode(near).write.format("geoparquet_sink").mode("overwrite" if overwrite else "append").options(path=path, grouprows=group_rows, **({"epsg": epsg} if epsg else {})).save()


def geo_entry(spark: SparkSession, path: str) -> dict | None:
    """The ``geo`` entry of one file's footer, read by Spark's own file systems."""
    files = spark.read.parquet(path).inputFiles()
    if not files:
        return None
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(sorted(files)[0])), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(text) if text else None


def epsg_of(geo: dict | None) -> int:
    """EPSG number of the primary column; 4326 for degrees, where nothing is said too."""
    crs = (geo or {}).get("columns", {}).get((geo or {}).get("primary_column", "geometry"), {}).get("crs")
    name = (crs or {}).get("id", {})
    if not crs or name.get("authority") == "OGC" and "84" in str(name.get("code")):
        return 4326
    if name.get("authority") != "EPSG":
        raise ValueError(f"unknown reference system: {crs.get('name')}")
    return int(name["code"])


def read_geoparquet(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(footprints with ring, holes and box, rows with a problem, EPSG number).

    With ``bounds`` only rows whose covering box meets them are read; files
    without a covering are read whole and filtered by the boxes of their rings.
    """
    geo = geo_entry(spark, path)
    column = (geo or {}).get("primary_column", "geometry")
    cover = (geo or {}).get("columns", {}).get(column, {}).get("covering", {}).get("bbox")
    df = spark.read.parquet(path)
    own = cover is not None and {tuple(v) for v in cover.values()} == {(cover["xmin"][0], k) for k in geometry.BOX}
    if bounds is not None and own:
        df = df.where(bbox_filter(bounds, cover["xmin"][0]))
    found = decode(df.drop(cover["xmin"][0]) if own else df, column)
    b = geometry.ring_bounds("ring")
    rows = found.where("problem is null").drop("problem").withColumns({k: b[k] for k in geometry.BOX})
    if bounds is not None and not own:
        rows = rows.where(bbox_filter(bounds, None))
    return rows, found.where("problem is not null").drop("ring", "holes", "part"), epsg_of(geo)
