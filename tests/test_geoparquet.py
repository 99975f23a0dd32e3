"""GeoParquet both ways, WKB of all kinds, and rows that can't be read."""

import json
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridproof.functions import polygons
from gridproof.sources import geoparquet as gp

SCHEMA = f"id long, name string, ring {gp.RING}, holes array<{gp.RING}>"


def square(x, y, s):
    return [(float(a), float(b)) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]


def rings(row):
    return [[(p.x, p.y) for p in r] for r in (row.ring, *row.holes)]


def opened(rs):
    return [list(map(tuple, polygons.open_ring(r))) for r in rs]


def test_there_and_back(spark, tmp_path):
    rows = [(k, f"n{k}", square(500_000 + 30 * (k % 100), 5_000_000 + 30 * (k // 100), 20), [square(500_005 + 30 * (k % 100), 5_000_005 + 30 * (k // 100), 5)] if k % 3 == 0 else None) for k in range(2000)] + [(9999, "none", None, None)]
    path = str(tmp_path / "t")
    gp.write_geoparquet(spark.createDataFrame(rows, SCHEMA).repartition(3), path, epsg=32632, group_rows=100)
    got, bad, epsg = gp.read_geoparquet(spark, path)
    assert epsg == 32632
    assert {r.id: opened(rings(r)) for r in got.collect()} == {i: opened([r, *(h or [])]) for i, _, r, h in rows if r}
    assert [(r.id, r.name, r.problem) for r in bad.collect()] == [(9999, "none", "null")]
    files = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    geo = json.loads(files[0].schema_arrow.metadata[b"geo"])
    assert geo["columns"]["geometry"]["crs"]["conversion"]["parameters"][1]["value"] == 9
    assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 100
    # written again, the table holds the new rows alone
    gp.write_geoparquet(spark.createDataFrame(rows[:5], SCHEMA), path, epsg=32632, overwrite=True)
    assert gp.read_geoparquet(spark, path)[0].count() == 5
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_temporary")]


def test_bounds_prune_row_groups(spark, tmp_path):
    rows = [(k, "n", square(100 * (k % 50), 100 * (k // 50), 20), None) for k in range(2500)]
    path = str(tmp_path / "t")
    gp.write_geoparquet(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, group_rows=100, cell=500.0)
    got, _, epsg = gp.read_geoparquet(spark, path, (1000.0, 1000.0, 1210.0, 1119.0))
    assert epsg == 4326
    assert sorted(r.id for r in got.collect()) == [500 + 10 + i + 50 * j for j in range(2) for i in range(3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan
    assert "bbox.xmin" in plan
    f = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet")))
    names = [f.metadata.row_group(0).column(k).path_in_schema for k in range(f.metadata.row_group(0).num_columns)]

    def span(group, name):
        found = f.metadata.row_group(group).column(names.index(name)).statistics
        return found.min, found.max

    met = [k for k in range(f.num_row_groups) if span(k, "bbox.xmin")[0] <= 1210 and span(k, "bbox.xmax")[1] >= 1000 and span(k, "bbox.ymin")[0] <= 1119 and span(k, "bbox.ymax")[1] >= 1000]
    assert len(met) <= f.num_row_groups / 5


def wkb(kind, body, order="<"):
    return struct.pack(order + "BI", order == "<", kind) + body


def polygon(points, order="<", width=2):
    flat = [float(v) for p in points for v in (*p, 7.0, 8.0)[:width]]
    return struct.pack(order + "II", 1, len(points)) + struct.pack(f"{order}{len(flat)}d", *flat)


def test_kinds_and_broken_rows(spark):
    closed = [(0, 0), (4, 0), (4, 4), (0, 0)]
    data = {
        "plain": wkb(3, polygon(closed)), "big-endian": wkb(3, polygon(closed, ">"), ">"), "z": wkb(1003, polygon(closed, width=3)), "zm": wkb(3003, polygon(closed, width=4)), "ewkb z": wkb(0x80000003, polygon(closed, width=3)),
        "multi": wkb(6, struct.pack("<I", 2) + wkb(3, polygon(closed)) + wkb(3, polygon(closed))), "point": wkb(1, struct.pack("<dd", 1, 2)), "line": wkb(2, struct.pack("<I", 0)), "collection": wkb(7, struct.pack("<I", 0)),
        "cut": wkb(3, polygon(closed))[:-3], "short": b"\x01", "empty": wkb(3, struct.pack("<I", 0)), "none": None, "nan": wkb(3, polygon([(0, 0), (math.nan, 0), (4, 4), (0, 0)])), "two points": wkb(3, polygon([(0, 0), (1, 1)])),
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v), 5) for k, v in data.items()], "name string, geometry binary, part int")
    got = gp.decode(df).collect()
    assert {(r.name, r.problem) for r in got if r.problem} == {("point", "kind Point"), ("line", "kind LineString"), ("collection", "kind GeometryCollection"), ("cut", "broken"), ("short", "broken"), ("empty", "empty"), ("none", "null"), ("nan", "not finite"), ("two points", "empty")}
    fine = [r for r in got if not r.problem]
    assert sorted((r.name, r.part) for r in fine) == [("big-endian", 0), ("ewkb z", 0), ("multi", 0), ("multi", 1), ("plain", 0), ("z", 0), ("zm", 0)]
    assert all(rings(r) == [[tuple(map(float, p)) for p in closed]] for r in fine)
    assert gp.decode(df.limit(0)).count() == 0


def test_files_of_others(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = [polygons.to_wkb([np.array(square(*rng.uniform(0, 9, 2), 1))]) for _ in range(50)]
    pq.write_table(pa.table({"id": list(range(50)), "shape": values}), str(tmp_path / "x.parquet"))
    table = pq.read_table(str(tmp_path / "x.parquet"))
    geo = {"version": "1.0.0", "primary_column": "shape", "columns": {"shape": {"encoding": "WKB", "geometry_types": [], "crs": {"id": {"authority": "EPSG", "code": 32719}}}}}
    pq.write_table(table.replace_schema_metadata({b"geo": json.dumps(geo).encode()}), str(tmp_path / "x.parquet"))
    got, bad, epsg = gp.read_geoparquet(spark, str(tmp_path / "x.parquet"), (0.0, 0.0, 3.0, 3.0))
    assert epsg == 32719
    assert bad.count() == 0
    want = {k for k, v in enumerate(values) if (polygons.from_wkb(v)[0][0].min(0) <= 3).all()}
    assert {r.id for r in got.collect()} == want
    with pytest.raises(ValueError, match="unknown"):
        gp.epsg_of({"primary_column": "g", "columns": {"g": {"crs": {"name": "local", "id": {"authority": "X", "code": 1}}}}})
    assert gp.projjson(32719)["conversion"]["parameters"][4]["value"] == 10_000_000
    with pytest.raises(ValueError, match="only"):
        gp.projjson(2154)
    assert got.where(F.col("xmin") > 3).count() == 0
