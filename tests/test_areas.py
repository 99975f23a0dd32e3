"""Outlines against the polygon kernel: meeting, distance, areas with holes, tags and masks of cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridproof.functions import geometry, polygons
from gridproof.operators import extract, raster

RING = "array<struct<x:double,y:double>>"
L = [(0, 0), (8, 0), (8, 3), (3, 3), (3, 8), (0, 8)]
HOLED = [(0, 0), (30, 0), (30, 30), (0, 30)]
HOLE = [(10, 10), (20, 10), (20, 20), (10, 20)]


def floats(x):
    return tuple(float(v) for v in x) if isinstance(x, tuple) and len(x) == 2 and all(isinstance(v, int) for v in x) else [floats(v) for v in x] if isinstance(x, list) else x


def rows(spark, data, schema):
    return spark.createDataFrame([tuple(floats(x) for x in r) for r in data], schema)


def square(x, y, w=2.0, h=2.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def star(rng, x, y):
    n = rng.randrange(3, 9)
    return [(x + rng.uniform(1, 5) * math.cos(2 * math.pi * k / n), y + rng.uniform(1, 5) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_rings_meet_as_in_the_kernel(spark):
    rng = random.Random(5)
    data = [(k, star(rng, 0, 0), star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9))) for k in range(300)]
    data += [(300, L, square(5, 5)), (301, L, square(3, 3)), (302, L, square(1, 1, 0.5, 0.5)), (303, square(1, 1, 0.5, 0.5), L), (304, L, square(8, 0)), (305, L, square(8, 3)), (306, L, [])]
    df = rows(spark, data, f"k int, a {RING}, b {RING}")
    met = geometry.edges_intersect(geometry.polygon_edges("a"), geometry.polygon_edges("b"))
    got = {r.k: r.met for r in df.select("k", met.alias("met")).collect()}
    assert got == {k: polygons.intersects(a, b) for k, a, b in data}
    assert got[301] and got[304] and got[305] and not got[300] and not got[306]


@pytest.mark.parametrize(("x", "y", "expected"), [(12, 12, False), (9, 12, True), (1, 1, True), (31, 0, False), (30, 5, True)])
def test_footprint_in_a_hole_goes(spark, x, y, expected):
    area = rows(spark, [("c", HOLED, [HOLE], 0.0, 0.0, 30.0, 30.0)], f"city string, ring {RING}, holes array<{RING}>, xmin double, ymin double, xmax double, ymax double")
    box = rows(spark, [("c", 1, float(x), float(y), x + 2.0, y + 2.0)], "city string, bld_id int, xmin double, ymin double, xmax double, ymax double")
    assert (extract.extract(box, area).count() == 1) is expected


def test_buffer_is_round(spark):
    area = rows(spark, [("c", square(0, 0, 10, 10), 0.0, 0.0, 10.0, 10.0)], f"city string, ring {RING}, xmin double, ymin double, xmax double, ymax double")
    at = [(1, 13.0, 14.0), (2, 13.1, 14.0), (3, 15.0, 3.0), (4, 15.01, 3.0), (5, 4.0, 4.0)]
    box = rows(spark, [("c", k, x, y, x + 1, y + 1) for k, x, y in at], "city string, bld_id int, xmin double, ymin double, xmax double, ymax double")
    assert sorted(r.bld_id for r in extract.extract(box, area, 5.0).collect()) == [1, 3, 5]


def test_tags_by_outline_and_clean_columns(spark):
    part = rows(spark, [("c", "l", L, 0.0, 0.0, 8.0, 8.0), ("c", "s", square(4, 4, 4, 4), 4.0, 4.0, 8.0, 8.0)], f"city string, sub_aoi_id string, ring {RING}, xmin double, ymin double, xmax double, ymax double")
    data = [("c", 1, "x", square(1, 1), 1.0, 1.0, 3.0, 3.0), ("c", 2, "x", square(5, 5), 5.0, 5.0, 7.0, 7.0), ("c", 3, "x", square(2.5, 2.5), 2.5, 2.5, 4.5, 4.5), ("d", 4, "x", square(1, 1), 1.0, 1.0, 3.0, 3.0), ("c", 5, "x", None, 1.0, 1.0, 3.0, 3.0)]
    df = rows(spark, data, f"city string, bld_id int, sub_aoi_id_left string, ring {RING}, xmin double, ymin double, xmax double, ymax double")
    got = extract.tag_sub_areas(df, part)
    assert got.columns == ["city", "bld_id", "ring", "xmin", "ymin", "xmax", "ymax", "sub_aoi_id"]
    assert sorted((r.bld_id, r.sub_aoi_id) for r in got.collect()) == [(1, "l"), (2, "s"), (3, "l"), (3, "s")]
    assert extract.tag_sub_areas(df.limit(0), part).count() == 0


def test_load_areas_projects_a_city_to_one_zone(spark):
    part = [[(5.9, 50.0), (5.91, 50.0), (5.91, 50.01), (5.9, 50.01)], [(6.05, 50.0), (6.06, 50.0), (6.06, 50.01), (6.05, 50.01)]]
    df = rows(spark, [("c", r, None) for r in part] + [("c", None, None), ("c", [(1.0, 1.0)], None)], f"city string, ring {RING}, holes array<{RING}>")
    got = extract.load_areas(df).collect()
    assert [r.zone for r in got] == [31, 31]
    for r in got:
        assert abs(r.area_m2 / (polygons.area([(p.x, p.y) for p in r.ring])) - 1) < 1e-9
        assert abs(r.area_m2 / (716.9 * 1112.3) - 1) < 0.01
        assert r.xmin == min(p.x for p in r.ring)


def test_mask_of_cells(spark):
    tiles = rows(spark, [("c", 0, 0.0, 0.0, 40.0, 40.0), ("c", 1, 40.0, 0.0, 80.0, 40.0)], "city string, tile_id int, x0 double, y0 double, x1 double, y1 double")
    area = rows(spark, [("c", HOLED, [HOLE], 0.0, 0.0, 30.0, 30.0), ("c", [(33, 33), (34, 33), (34, 34)], None, 33.0, 33.0, 34.0, 34.0)], f"city string, ring {RING}, holes array<{RING}>, xmin double, ymin double, xmax double, ymax double")
    cells = {(r.gx, r.gy): r.in_area for r in raster.tile_cells(tiles, 10.0, area).collect()}
    assert len(cells) == 32
    assert {k for k, v in cells.items() if v} == {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    touched = {(r.gx, r.gy): r.in_area for r in raster.tile_cells(tiles, 10.0, area, all_touched=True).collect()}
    assert touched[(3, 3)] and touched[(1, 1)] and not touched[(6, 1)]


def test_reference_fraction_of_rings(spark):
    ring = [(1.0, 1.0), (17.0, 1.0), (1.0, 17.0)]
    df = rows(spark, [("c", ring, 1.0, 1.0, 17.0, 17.0)], f"city string, ring {RING}, xmin double, ymin double, xmax double, ymax double")
    got = {(r.gx, r.gy): r.ref_share for r in raster.reference_fraction(df, 10.0, 4).collect()}
    for gx in range(2):
        for gy in range(2):
            mine = [polygons.contains(ring, (gx * 10 + (i + 0.5) * 2.5, gy * 10 + (j + 0.5) * 2.5)) for i in range(4) for j in range(4)]
            assert got.get((gx, gy), 0.0) == sum(mine) / 16
    boxes = df.drop("ring").withColumns({"xmin": F.lit(2.0), "ymin": F.lit(2.0)})
    few, all_ = (sum(r.ref_share for r in raster.reference_fraction(boxes, 10.0, 4, t).collect()) for t in (False, True))
    assert (few, all_) == (36 / 16, 49 / 16)


def test_mercator(spark):
    p = spark.range(1).select(geometry.web_mercator(F.lit(180.0), F.lit(0.0)).alias("a"), geometry.web_mercator(F.lit(0.0), F.lit(45.0)).alias("b")).first()
    assert abs(p.a.x - 20037508.342789) < 1e-5
    assert abs(p.a.y) < 1e-6
    assert abs(p.b.y - 5621521.486192) < 1e-5
