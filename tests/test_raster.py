"""Pixel tables: methods, regridding, guards and confusion."""

import pytest
from pyspark.sql import functions as F

from gridproof.operators import raster, tiling

CELL = "city string, dataset string, x double, y double, value double"


def cells(spark, rows):
    return spark.createDataFrame([("c", "d", float(x), float(y), v) for x, y, v in rows], CELL)


@pytest.mark.parametrize(
    ("spec", "value", "area", "built"),
    [
        ({"method": "fraction"}, 0.5, 50.0, True),
        ({"method": "fraction", "clamp_max": 0.3}, 0.5, 30.0, True),
        ({"method": "percent"}, 250.0, 100.0, True),
        ({"method": "area_m2"}, 130.0, 100.0, True),
        ({"method": "area_m2", "clamp_to_pixel_area": False}, 130.0, 130.0, True),
        ({"method": "binary", "threshold": 2}, 1.0, 0.0, False),
        ({"method": "nonzero"}, -1.0, 100.0, True),
        ({"method": "value_in", "values": [4]}, 4.0, 100.0, True),
        ({"method": "wsf_tracker", "as_of_code": 5}, 6.0, 0.0, False),
        ({"method": "fraction", "threshold_frac": 0.6}, 0.5, 50.0, False),
        ({"method": "fraction"}, None, None, False),
        ({"method": "fraction", "nodata": 0}, None, 0.0, False),
    ],
)
def test_methods(spark, spec, value, area, built):
    r = raster.native_cells(cells(spark, [(0, 0, value)]), 10, spec, 20.0).first()
    assert (r.area, r.built) == (area, built)


def test_unknown_method():
    with pytest.raises(ValueError):
        raster.predicted_area("v", 1.0, {"method": "other"})


def test_nodata_code_is_invalid_and_nodata_share_is_valid(spark):
    code = raster.native_cells(cells(spark, [(0, 0, None), (10, 0, 3.0)]), 10, {"method": "nonzero", "nodata": 3}, 20.0)
    assert [r.valid for r in code.orderBy("x").collect()] == [False, False]
    assert raster.native_cells(cells(spark, [(0, 0, None)]), 10, {"method": "fraction", "nodata": 0}, 20.0).first().valid


def test_regrid_means_valid_cells_only(spark):
    native = raster.native_cells(cells(spark, [(0, 0, 1.0), (10, 0, 0.0), (0, 10, None), (10, 10, 1.0)]), 10, {"method": "fraction"}, 20.0)
    r = raster.regrid(native, 10, 20).first()
    assert r.built_share == pytest.approx(2 / 3)
    assert r.pred_area == pytest.approx(200 / 3 * 4)


def test_reference_share_counts_overlaps_once(spark):
    boxes = spark.createDataFrame([("c", 0.0, 0.0, 5.0, 10.0), ("c", 2.5, 0.0, 7.5, 10.0)], "city string, xmin double, ymin double, xmax double, ymax double")
    assert raster.reference_fraction(boxes, 10, 4).first().ref_share == 0.75


def test_disagreement(spark):
    q, a = raster.disagreement(F.lit(5), F.lit(3), F.lit(1), F.lit(1))
    assert tuple(spark.range(1).select(q, a).first()) == pytest.approx((0.2, 0.2))


def test_guard(spark):
    grids = spark.createDataFrame([("10m", 10.0), ("100m", 100.0)], "grid string, resolution_m double")
    products = spark.createDataFrame([("coarse", 100.0), ("fine", 4.0), ("unknown", None)], "p string, native_resolution_m double")
    got = {(r.p, r.grid) for r in raster.guard(grids, products, 0.95).collect()}
    assert got == {("coarse", "100m"), ("fine", "10m"), ("fine", "100m"), ("unknown", "10m"), ("unknown", "100m")}
    assert raster.guard(grids, products, 0.95, "warn_only").count() == 6
    with pytest.raises(ValueError):
        raster.guard(grids, products, 0.95, "error")


def test_tile_metrics_of_wrong_cells_have_no_f1(spark):
    area = spark.createDataFrame([("c", 0.0, 0.0, 20.0, 10.0)], "city string, xmin double, ymin double, xmax double, ymax double")
    tiles = tiling.make_tiles(area, 20.0)
    refs = spark.createDataFrame([("c", 1, 0.0, 0.0, 10.0, 10.0, 100.0)], "city string, bld_id long, xmin double, ymin double, xmax double, ymax double, area_m2 double")
    native = raster.native_cells(cells(spark, [(0, 0, 0.0), (10, 0, 1.0)]), 10, {"method": "fraction"}, 20.0)
    r = raster.tile_metrics(tiles, refs, native, 10, 10, "10m", tile_size=20.0).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 1, 1, 0.0, 0.0, None)
    assert (r.quantity_disagreement, r.allocation_disagreement, r.rel_area_error) == (0.0, 1.0, 0.0)


def test_mosaic_takes_the_first_value(spark):
    out = raster.mosaic([cells(spark, [(0, 0, None), (10, 0, 1.0)]), cells(spark, [(0, 0, 2.0), (10, 0, 3.0)])])
    assert [r.value for r in out.orderBy("x").collect()] == [2.0, 1.0]


def test_cells_of_an_area_are_not_gathered_by_the_driver(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 40000D, 'y', 0D), named_struct('x', 0D, 'y', 40000D)) as ring"
    areas = spark.range(1).selectExpr("'c' as city", ring)
    cells = spark.range(1000).selectExpr("'c' as city", "'d' as dataset", "id * 20D as x", "id * 20D as y", "1D as value")
    out = raster.clip_to_areas(cells, areas, 20.0)
    # 2 million cells from three points
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("value is not null").count() == 1000
