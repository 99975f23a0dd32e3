"""Shapefiles made byte by byte: parts, holes, columns, deleted rows, pruning and partitions."""

import datetime
import struct

import pytest

from gridproof.operators import extract
from gridproof.sources import shapefile

RING = "array<struct<x:double,y:double>>"


def square(x, y, s, clockwise=True):
    p = [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    return p if clockwise else p[::-1]


def content(rings, kind=5):
    points = [p for r in rings for p in r]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
    body = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    if kind == 15:
        body += struct.pack("<2d", 0, 1) + struct.pack(f"<{len(points)}d", *[0.5] * len(points))
    return body


def write(path, records, fields, rows, kind=5):
    shp, shx, at = b"", b"", 50
    for k, body in enumerate(records):
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head(len(shp)) + shp)
    path.with_suffix(".shx").write_bytes(head(len(shx)) + shx)
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    for name, kind_, n, decimals in fields:
        dbf += name.encode().ljust(11, b"\0") + kind_.encode() + bytes(4) + bytes([n, decimals]) + bytes(14)
    dbf += b"\r"
    for deleted, *values in rows:
        dbf += (b"*" if deleted else b" ") + b"".join(str(v).encode()[: f[2]].ljust(f[2]) for v, f in zip(values, fields, strict=True))
    path.with_suffix(".dbf").write_bytes(dbf + b"\x1a")
    return str(path.with_suffix(".shp"))


FIELDS = [("gridID", "N", 9, 0), ("name", "C", 10, 0), ("height", "N", 8, 2), ("day", "D", 8, 0), ("ok", "L", 1, 0)]


@pytest.fixture
def grid(tmp_path):
    records = [content([square(k % 20, k // 20, 0.9)]) for k in range(400)]
    rows = [(k == 7, k, f"näme {k}", k / 4, f"2024{1 + k % 12:02d}05", "T" if k % 2 else "F") for k in range(400)]
    return write(tmp_path / "grid", records, FIELDS, rows)


def test_all_columns(spark, grid):
    df = shapefile.read_shapefile(spark, grid)
    assert dict(df.dtypes)["gridID"] == "bigint"
    rows = {r.record: r for r in df.collect()}
    assert set(rows) == set(range(400)) - {7}
    r = rows[123]
    assert (r.gridID, r.name, r.height, r.day, r.ok, r.part, r.holes) == (123, "näme 123", 30.75, datetime.date(2024, 4, 5), True, 0, [])
    assert (r.xmin, r.ymin, r.xmax, r.ymax) == (3.0, 6.0, 3.9, 6.9)


def test_asked_columns_bounds_and_partitions(spark, grid):
    df = shapefile.read_shapefile(spark, grid, ["name"], (4.95, 3.0, 6.5, 4.5), part_bytes=5000)
    assert df.columns == ["record", "part", "ring", "holes", "xmin", "ymin", "xmax", "ymax", "name"]
    assert df.rdd.getNumPartitions() > 5
    assert sorted(r.record for r in df.collect()) == sorted(x + 20 * y for x in (5, 6) for y in (3, 4))
    assert shapefile.read_shapefile(spark, grid, []).columns[-1] == "ymax"
    assert shapefile.read_shapefile(spark, grid, part_bytes=5000).count() == 399


def test_parts_holes_and_other_kinds(spark, tmp_path):
    nested = [square(0, 0, 10), square(2, 2, 6, False), square(4, 4, 2), square(20, 0, 5), square(21, 1, 1, False)]
    records = [content(nested), content([square(0, 0, 1)], 15), struct.pack("<i", 0), content([square(0, 0, 2, False)])]
    path = write(tmp_path / "x", records, [("a", "C", 3, 0), ("f", "F", 9, 3)], [(False, "p", "1.5"), (False, "", "***"), (False, "n", "2"), (False, "w", "x")])
    got = {(r.record, r.part): r for r in shapefile.read_shapefile(spark, path).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (1, 0), (3, 0)}
    assert [len(got[0, k].holes) for k in range(3)] == [1, 0, 1]
    assert {(r.a, r.f) for r in got.values()} == {("p", 1.5), (None, None), ("w", None)}
    none = write(tmp_path / "none", [], [("a", "C", 3, 0)], [])
    assert shapefile.read_shapefile(spark, none).count() == 0


def test_numbers_of_touched_grid_cells(spark, grid):
    cells = shapefile.read_shapefile(spark, grid, ["gridID"])
    areas = spark.createDataFrame([("b", [(0.5, 0.5), (2.5, 0.5), (0.5, 2.5)]), ("b", [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]), ("a", [(18.95, 18.95), (18.97, 18.95), (18.97, 18.97)]), ("a", [(19.5, 19.5), (19.6, 19.5), (19.6, 19.6)])], f"city string, ring {RING}")
    assert [tuple(r) for r in extract.grid_ids(cells, areas).collect()] == [("a", 399), ("b", 0), ("b", 1), ("b", 2), ("b", 20), ("b", 21), ("b", 22), ("b", 40), ("b", 41)]
    with pytest.raises(ValueError, match="a grid needs"):
        extract.grid_ids(cells.drop("gridID"), areas)
