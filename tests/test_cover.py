"""Cells of outlines against tests of single cells, and meeting outlines against the polygon kernel."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridproof.functions import geometry, polygons
from gridproof.operators import cover, extract, raster

RING = "array<struct<x:double,y:double>>"
BOXES = "xmin double, ymin double, xmax double, ymax double"


def star(rng, x, y, most=6.0, points=9):
    n = rng.randrange(3, points)
    return [(x + rng.uniform(1, most) * math.cos(2 * math.pi * k / n), y + rng.uniform(1, most) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def shapes(seed, n=12):
    rng = random.Random(seed)
    out = [(k, star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), 14.0), None) for k in range(n)]
    out.append((n, [(-6.0, -6.0), (12.0, -6.0), (12.0, 12.0), (-6.0, 12.0)], [[(-3.0, -3.0), (3.0, -3.0), (3.0, 6.0), (-3.0, 6.0)]]))
    out.append((n + 1, [(-9.0, 3.0), (15.0, 3.0), (15.0, 3.5), (-9.0, 3.5)], None))
    return out


@pytest.mark.parametrize("size", [3.0, 1.3])
def test_cells_as_by_single_tests(spark, size):
    rows = shapes(int(size * 10), 7)
    df = spark.createDataFrame(rows, f"k int, ring {RING}, holes array<{RING}>")
    cells = spark.range(-int(40 / size), int(40 / size)).selectExpr("id as cx").crossJoin(spark.range(-int(40 / size), int(40 / size)).selectExpr("id as cy"))
    e = geometry.polygon_edges("ring", "holes")
    x, y = F.col("cx") * size, F.col("cy") * size
    square = geometry.polygon_edges(geometry.box_ring({"xmin": x, "ymin": y, "xmax": x + size, "ymax": y + size}))
    every = df.crossJoin(cells)
    for touched, test in ((False, geometry.point_in_edges(x + size / 2, y + size / 2, e)), (True, geometry.edges_intersect(square, e))):
        want = {tuple(r) for r in every.where(test).select("k", "cx", "cy").collect()}
        assert {tuple(r) for r in cover.covered_cells(df, ["k"], size, touched).collect()} == want


@pytest.mark.parametrize(("size", "seed"), [(100.0, 1), (2.5, 2)])
def test_meeting_as_in_the_kernel(spark, size, seed):
    rng = random.Random(seed)
    areas = [("c", *s) for s in shapes(seed)] + [("d", 99, star(rng, 0, 0), None)]
    mine = [("c", k, star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), 3.0)) for k in range(120)] + [("c", 500, [(-90.0, -90.0), (90.0, -90.0), (90.0, 90.0), (-90.0, 90.0)]), ("c", 501, None), ("c", 502, [])]
    a = spark.createDataFrame(areas, f"city string, _area int, ring {RING}, holes array<{RING}>")
    f = spark.createDataFrame(mine, f"city string, _id int, ring {RING}")
    got = {tuple(r) for r in cover.meeting(f, a, size).select("_id", "_area").collect()}
    want = set()
    for _, i, r in mine:
        for c, k, s, h in areas:
            # a hole keeps what lies wholly in it
            if c == "c" and r and polygons.intersects(r, s) and not (h and all(polygons.contains(h[0], p) for p in r) and not polygons._edges_meet(np.array(r), np.array(h[0]))):
                want.add((i, k))
    assert got == want


def test_distance(spark):
    rng = random.Random(4)
    areas = [("c", k, s, None) for k, s, _ in shapes(4)[:5]]
    mine = [("c", k, star(rng, rng.uniform(-40, 40), rng.uniform(-40, 40), 3.0)) for k in range(80)]
    a, f = spark.createDataFrame(areas, f"city string, _area int, ring {RING}, holes array<{RING}>"), spark.createDataFrame(mine, f"city string, _id int, ring {RING}")
    got = {tuple(r) for r in cover.meeting(f, a, 4.0, 2.5).select("_id", "_area").collect()}
    both = f.join(a.select("_area", F.col("ring").alias("b")), F.lit(True))
    want = {tuple(r) for r in both.where(geometry.edges_within(geometry.polygon_edges("ring"), geometry.polygon_edges("b"), 2.5)).select("_id", "_area").collect()}
    assert got == want
    assert len(want) > len({tuple(r) for r in cover.meeting(f, a, 4.0).select("_id", "_area").collect()})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_join_by_city_alone(spark):
    areas = spark.createDataFrame([("c", "p", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], 0.0, 0.0, 9.0, 9.0)], f"city string, sub_aoi_id string, ring {RING}, {BOXES}")
    boxes = spark.createDataFrame([("c", 1, 1.0, 1.0, 2.0, 2.0)], f"city string, bld_id int, {BOXES}")
    tiles = spark.createDataFrame([("c", 1, 0.0, 0.0, 50.0, 50.0)], "city string, tile_id int, x0 double, y0 double, x1 double, y1 double")
    for df in (extract.extract(boxes, areas), extract.extract(boxes, areas.drop("ring")), extract.extract(boxes, areas, 3.0), extract.tag_sub_areas(boxes, areas), extract.tag_sub_areas(boxes, areas.drop("ring")), raster.tile_cells(tiles, 10.0, areas)):
        joins = re.findall(r"Join \w+, (.*)", plan(df))
        assert joins
        assert all("_id" in j or "_area" in j or "cx" in j or "cy" in j or "gx" in j for j in joins)
        assert all(df.collect())


def test_repeated_rows_stay(spark):
    areas = spark.createDataFrame([("c", "p", 0.0, 0.0, 2500.0, 2500.0), ("c", "q", 900.0, 900.0, 1100.0, 1100.0)], f"city string, sub_aoi_id string, {BOXES}")
    boxes = spark.createDataFrame([("c", 1, 950.0, 950.0, 1050.0, 1050.0)] * 2 + [("c", 2, 2500.0, 2500.0, 2501.0, 2501.0), ("c", 3, 2500.5, 0.0, 2501.0, 1.0)], f"city string, bld_id int, {BOXES}")
    assert sorted(r.bld_id for r in extract.extract(boxes, areas).collect()) == [1, 1, 2]
    assert sorted((r.bld_id, r.sub_aoi_id) for r in extract.tag_sub_areas(boxes, areas).collect()) == [(1, "p"), (1, "p"), (1, "q"), (1, "q"), (2, "p")]


def test_outline_of_many_points(spark):
    n = 100_000
    ring = [(5000 + (4000 + 900 * math.sin(40 * t)) * math.cos(t), 5000 + (4000 + 900 * math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * k / n for k in range(n))]
    areas = spark.createDataFrame([("c", ring, 0.0, 0.0, 10_000.0, 10_000.0)], f"city string, ring {RING}, {BOXES}")
    boxes = spark.range(20_000).selectExpr("'c' as city", "id as bld_id", "cast(id * 7919 % 10007 as double) as xmin", "cast(id * 104729 % 10009 as double) as ymin").selectExpr("*", "xmin + 5 as xmax", "ymin + 5 as ymax")
    began = time.time()
    got = {r.bld_id for r in extract.extract(boxes, areas).select("bld_id").collect()}
    assert time.time() - began < 120
    z = np.array(ring)
    for r in boxes.limit(300).collect():
        corners = [(r.xmin, r.ymin), (r.xmax, r.ymin), (r.xmax, r.ymax), (r.xmin, r.ymax)]
        if any(polygons.contains(z, c) for c in corners):
            assert r.bld_id in got
        elif min(np.hypot(*(z - c).T).min() for c in corners) > 10:
            assert r.bld_id not in got


def test_clip_by_outlines(spark):
    cells = spark.range(100).selectExpr("'c' as city", "'d' as dataset", "cast(id % 10 * 20 as double) as x", "cast(id div 10 * 20 as double) as y", "1.0D as value")
    areas = spark.createDataFrame([("c", [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0)], 0.0, 0.0, 100.0, 100.0)], f"city string, ring {RING}, {BOXES}")
    got = {(r.x, r.y) for r in raster.clip_to_areas(cells, areas, 20.0).where("value is not null").collect()}
    assert got == {(x, y) for x in range(0, 200, 20) for y in range(0, 200, 20) if x + y + 20 < 100}
    wide = {(r.x, r.y) for r in raster.clip_to_areas(cells, areas, 20.0, True).where("value is not null").collect()}
    assert wide == {(x, y) for x in range(0, 200, 20) for y in range(0, 200, 20) if x + y <= 100}


def test_sides_at_centres(spark):
    centres = [(2 * k + 1) * 7071 / 10000 for k in range(247_000, 247_500)]
    boxes = spark.createDataFrame([(k, a, a, b, b) for k, (a, b) in enumerate(zip(centres, centres[2:], strict=False))], f"k int, {BOXES}")
    got = {tuple(r) for r in cover.covered_cells(boxes, ["k"], 1.4142).collect()}
    assert got == {(k, 247_000 + k + i, 247_000 + k + j) for k in range(498) for i in (0, 1) for j in (0, 1)}
    got = {tuple(r) for r in cover.interior_cells(boxes, ["k"], 1.4142).collect()}
    assert got == {(k, 247_001 + k, 247_001 + k) for k in range(498)}


def within(ring, x, y):
    """In a ring and on none of its edges, in whole numbers."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay > y) != (by > y):
            odd ^= (side > 0) == (by > ay)
    return odd


def test_interiors_in_whole_numbers(spark):
    rng, rings = random.Random(7), []
    for _ in range(40):
        # corners on centres of cells, on odd numbers of halves
        at = sorted(rng.sample(range(24), rng.randrange(3, 12)))
        rings.append([tuple(2 * round(r * f(math.pi * t / 12) / 2) + 1 for f in (math.cos, math.sin)) for t in at for r in [rng.uniform(4, 24)]])
    rings.append([(-11, -11), (1, -1), (11, -11), (11, 11), (1, 3), (-11, 11)])
    rings.append([(-11, -11), (-3, -11), (-3, -5), (5, -5), (5, -11), (11, -11), (11, 7), (3, 7), (3, 1), (-5, 1), (-5, 7), (-11, 7)])
    holes = [None, [], [[(-5, -3), (3, -3), (3, 5), (-5, 5)]], [[(1, -5), (5, 1), (1, 5), (-3, 1)]], [[(-7, -3), (-1, -3), (-1, 3), (-7, 3)], [(-1, -3), (3, -1), (-1, 3)]]]
    rows = [(n, r, holes[(n + more) % 5]) for n, r in enumerate(rings) for more in range(5)]

    def halves(ring):
        return [(x / 2, y / 2) for x, y in ring]

    df = spark.createDataFrame([(k, n, halves(r), h and [halves(x) for x in h]) for k, (n, r, h) in enumerate(rows)], f"k int, n int, ring {RING}, holes array<{RING}>")
    want = {(k, x // 2, y // 2) for k, (_, r, h) in enumerate(rows) for x in range(-27, 28, 2) for y in range(-27, 28, 2) if within(r, x, y) and not any(within(o, x, y) for o in h or [])}
    got = [tuple(r) for r in cover.interior_cells(df, ["k"], 1.0).collect()]
    assert sorted(got) == sorted(want)
    rows_of = {k: n for k, (n, _, _) in enumerate(rows)}
    assert sorted(tuple(r) for r in cover.interior_cells(df, ["n"], 1.0).collect()) == sorted({(rows_of[k], x, y) for k, x, y in want})
    nothing = spark.createDataFrame([(1, None, None), (2, [], None), (3, [(0.0, 0.0), (9.0, 9.0)], [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]])], f"k int, ring {RING}, holes array<{RING}>")
    assert not cover.interior_cells(nothing, ["k"], 1.0).collect()


def test_diamonds_with_centres_on_their_edges(spark, tmp_path):
    import duckdb

    from gridproof.oracles import ORACLE_SQL
    from gridproof.queries import diamond_cells

    # in each a centre is within a millionth of an edge
    keys = [4352, 7366, 8427, 9099, 10462, 10978, 11347, 13308]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(tuple(r) for r in diamond_cells(spark, str(tmp_path)).collect()) == sorted(con.execute(ORACLE_SQL["diamond_cells"]).fetchall())
