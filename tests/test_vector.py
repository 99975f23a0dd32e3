"""Matching, tiles and footprint metrics: hand-made cases and properties."""

import random

import pytest
from pyspark.sql import functions as F

from gridproof.operators import matching, rollup, tiling, vector_metrics

KEY = ("c", "d", 0)
SCHEMA = "city string, dataset string, tile_id long, ref_id long, cand_id long, iou double, area_ref double, area_cand double"


def pairs(spark, rows):
    return spark.createDataFrame([(*KEY, r, c, i, 10.0, 12.0) for r, c, i in rows], SCHEMA)


def taken(df):
    return {(r.ref_id, r.cand_id) for r in df.collect()}


def test_greedy_takes_the_best_first(spark):
    p = pairs(spark, [(10, 100, 0.9), (10, 101, 0.95), (11, 101, 0.8), (11, 100, 0.6)])
    assert taken(matching.greedy_match(p)) == {(10, 101), (11, 100)}


def test_greedy_accepts_the_threshold_and_breaks_ties_by_id(spark):
    p = pairs(spark, [(1, 9, 0.5), (2, 9, 0.5), (3, 8, 0.49)])
    assert taken(matching.greedy_match(p)) == {(1, 9)}


def test_greedy_is_one_to_one_and_equals_the_rounds(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(30), rng.randrange(30)): rng.randrange(10, 21) / 20 for _ in range(200)}
    p = pairs(spark, [(r, c, i) for (r, c), i in rows.items()])
    got = taken(matching.greedy_match(p.repartition(5)))
    assert len({r for r, _ in got}) == len(got) == len({c for _, c in got})
    assert got == taken(matching.match_by_rounds(p))
    best, used_r, used_c = set(), set(), set()
    for (r, c), _ in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if r not in used_r and c not in used_c:
            best.add((r, c))
            used_r.add(r)
            used_c.add(c)
    assert got == best


BOX = "city string, bld_id long, xmin double, ymin double, xmax double, ymax double, area_m2 double"


def boxes(spark, rows, dataset=None):
    df = spark.createDataFrame([("c", k, float(a), float(b), float(x), float(y), float((x - a) * (y - b))) for k, a, b, x, y in rows], BOX)
    return df if dataset is None else df.withColumn("dataset", F.lit(dataset))


@pytest.fixture(scope="module")
def tiles(spark):
    return tiling.make_tiles(spark.createDataFrame([("c", 0.0, 0.0, 2000.0, 2000.0)], "city string, xmin double, ymin double, xmax double, ymax double"), 1000.0)


def test_edges_on_a_line_belong_to_both_tiles(spark, tiles):
    got = tiling.assign_tiles(boxes(spark, [(1, 990, 10, 1000, 20), (2, 5, 5, 6, 6)]), tiles, 1000.0)
    assert sorted((r.bld_id, r.ix, r.iy) for r in got.collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_points_on_a_line_belong_to_no_tile(spark, tiles):
    p = spark.createDataFrame([("c", 1000.0, 5.0), ("c", 999.5, 5.0)], "city string, x double, y double")
    assert [r.tile_id for r in tiling.point_tiles(p, tiles, 1000.0).collect()] == [0]


def test_snapped_grid_starts_on_a_multiple(spark):
    area = spark.createDataFrame([("c", 130.0, 250.0, 310.0, 290.0)], "city string, xmin double, ymin double, xmax double, ymax double")
    got = tiling.make_tiles(area, 100.0, snap=True)
    assert sorted((r.x0, r.y0) for r in got.collect()) == [(100.0, 200.0), (200.0, 200.0), (300.0, 200.0)]
    assert tiling.make_tiles(area, 100.0, clip=True).agg(F.max("x1")).first()[0] == 310.0


def test_tile_metrics_without_candidates_are_zero(spark, tiles):
    refs = tiling.assign_tiles(boxes(spark, [(1, 10, 10, 20, 20), (2, 1500, 10, 1510, 20)]), tiles, 1000.0)
    cands = tiling.assign_tiles(boxes(spark, [(7, 10, 10, 20, 20)], "a"), tiles, 1000.0)
    m = matching.with_area_error(matching.greedy_match(matching.candidate_pairs(refs, cands)))
    got = {r.tile_id: r for r in vector_metrics.tile_metrics(refs, cands, m).collect()}
    assert (got[0].tp, got[0].f1, got[0].mean_iou) == (1, 1.0, 1.0)
    assert (got[2].tp, got[2].fn, got[2].precision, got[2].f1, got[2].mean_rel_area_error) == (0, 1, 0.0, 0.0, None)


def test_counts_add_up_and_shifting_changes_nothing(spark, tiles):
    rng = random.Random(5)
    ref = [(k, x := rng.randrange(0, 1900), y := rng.randrange(0, 1900), x + rng.randrange(5, 30), y + rng.randrange(5, 30)) for k in range(120)]
    cand = [(k, a + rng.randrange(-2, 3), b + rng.randrange(-2, 3), x, y) for k, a, b, x, y in ref if k % 5]

    def run(r, c):
        refs, cands = tiling.assign_tiles(boxes(spark, r), tiles, 1000.0), tiling.assign_tiles(boxes(spark, c, "a"), tiles, 1000.0)
        m = matching.with_area_error(matching.greedy_match(matching.candidate_pairs(refs, cands)))
        return vector_metrics.tile_metrics(refs, cands, m).orderBy("tile_id").collect()

    got, back = run(ref, cand), run(cand, ref)
    assert all(r.tp + r.fn == r.n_ref and r.tp + r.fp == r.n_cand for r in got)
    assert [(r.precision, r.recall) for r in got] == [(r.recall, r.precision) for r in back]


def test_weighted_means_differ_in_missing_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1.0, 1.0), ("b", 5.0, 0.0), ("c", float("nan"), 2.0), ("c", 3.0, 2.0), (None, 2.0, 1.0)], "g string, v double, w double")
    drop = {r.g: r.v_weighted_mean for r in rollup.weighted(df, ["v"], "w", ["g"]).collect()}
    zero = {r.g: r.v_wavg for r in rollup.weighted(df, ["v"], "w", ["g"], True).collect()}
    assert drop == {"a": 1.0, "b": None, "c": 3.0, None: 2.0}
    assert zero == {"a": 0.5, "b": None, "c": 1.5, None: 2.0}


def test_best_takes_each_columns_first_value(spark):
    df = spark.createDataFrame([("x", "b", 0.9, None), ("x", "a", 0.9, 0.2), ("x", "c", None, 0.7)], "city string, dataset string, f double, p double")
    r = rollup.best_per_group(df, ["city"], "f", "dataset", ["f", "p"]).first()
    assert (r.dataset, r.f, r.p) == ("a", 0.9, 0.2)
    r = rollup.best_per_group(df.where("dataset <> 'a'"), ["city"], "f", "dataset", ["f", "p"]).first()
    assert (r.dataset, r.p) == ("b", 0.7)


def test_size_bins_are_closed_on_the_right(spark):
    from gridproof.functions.exprs import right_closed_bin

    df = spark.createDataFrame([(float(v),) for v in (0, 20, 25, 25.01, 100, 1000, 1001)], "a double")
    assert [r[0] for r in df.select(right_closed_bin("a")).collect()] == ["<25", "<25", "<25", "25-50", "50-100", "500-1000", ">1000"]


def test_tiles_of_an_area_in_plane_metres(spark):
    """Wherever the grid starts, a box is in the tiles that it touches and in no other."""
    rng = random.Random(11)
    x, y = 512_345.678, 5_123_456.789
    area = spark.createDataFrame([("c", x, y, x + 3000, y + 3000)], "city string, xmin double, ymin double, xmax double, ymax double")
    grid = tiling.make_tiles(area, 1000.0)
    some = [(k, a := x + rng.uniform(-50, 3050), b := y + rng.uniform(-50, 3050), a + rng.uniform(1, 1500), b + rng.uniform(1, 40)) for k in range(60)]
    some += [(100 + k, x + 1000 * k, y + 1000 * k, x + 1000 * k + 1000, y + 1000 * k + 1) for k in range(3)]
    sides = [(r.tile_id, r.x0, r.y0, r.x1, r.y1) for r in grid.collect()]
    want = sorted((k, t) for k, a, b, c, d in some for t, x0, y0, x1, y1 in sides if a <= x1 and c >= x0 and b <= y1 and d >= y0)
    got = tiling.assign_tiles(boxes(spark, some), grid, 1000.0)
    assert got.columns == [*boxes(spark, some).columns, "ix", "iy", "tile_id"]
    assert sorted((r.bld_id, r.tile_id) for r in got.collect()) == want
    points = spark.createDataFrame([("c", a, b) for _, a, b, _, _ in some], "city string, x double, y double")
    inside = sorted((a, t) for _, a, b, _, _ in some for t, x0, y0, x1, y1 in sides if x0 < a < x1 and y0 < b < y1)
    assert sorted((r.x, r.tile_id) for r in tiling.point_tiles(points, grid, 1000.0).collect()) == inside


def test_all_density_classes(spark):
    area = spark.createDataFrame([("c", 70.5, 30.5, 2070.5, 2030.5)], "city string, xmin double, ymin double, xmax double, ymax double")
    grid = tiling.make_tiles(area, 1000.0)
    points = [("c", 80 + i * 0.01, 40.0) for i in range(1501)] + [("c", 80 + i * 0.01, 1040.0) for i in range(1500)] + [("c", 1080 + i * 0.01, 40.0) for i in range(99)]
    got = tiling.tile_density(spark.createDataFrame(points, "city string, x double, y double"), grid, 1000.0)
    assert {r.tile_id: (r.n_buildings, r.density_class) for r in got.collect()} == {0: (1501, "high"), 1: (1500, "medium"), 2: (99, "low"), 3: (0, "none")}


def test_areas_keep_their_digits_far_from_the_origin(spark):
    from gridproof.functions import geometry

    ring = [{"x": 500000.1 + a, "y": 5200000.3 + b} for a, b in ((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))]
    r = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>").select(geometry.ring_area("ring").alias("a"), geometry.ring_centroid("ring").alias("c")).first()
    assert r.a == pytest.approx(64, abs=1e-6) and r.c.x - 500000.1 == pytest.approx((40 * 5 + 24 * 2) / 64, abs=1e-6)


def test_dense_tiles_go_by_rounds(spark):
    import random

    from gridproof.operators import matching

    rng = random.Random(6)
    rows = [("c", "d", rng.randrange(3), rng.randrange(30), 100 + rng.randrange(30), round(rng.random(), 1), 9.0, 8.0) for _ in range(400)] + [("c", "d", 7, 1, 2, 0.9, 9.0, 8.0)]
    pairs = spark.createDataFrame(rows, "city string, dataset string, tile_id long, ref_id long, cand_id long, iou double, area_ref double, area_cand double").dropDuplicates(["tile_id", "ref_id", "cand_id"])
    want = sorted(map(tuple, matching.greedy_match(pairs).collect()))
    assert sorted(map(tuple, matching.match(pairs).collect())) == want
    assert sorted(map(tuple, matching.match(pairs, dense=40).collect())) == want
