"""Projections there and back, target grids, and resampled values against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from gridproof.functions import geometry
from gridproof.operators import warp
from gridproof.operators.warp import Grid


def test_projections_come_back(spark):
    p = spark.range(2000).selectExpr("cast(id * 37 % 359 as double) - 179.5D as lon", "cast(id * 53 % 159 as double) - 79.5D as lat")
    u, m = geometry.utm("lon", "lat"), geometry.web_mercator("lon", "lat")
    p = p.select("lon", "lat", geometry.inverse_utm(u["x"], u["y"], geometry.utm_zone("lon"), F.col("lat") < 0).alias("u"), geometry.inverse_mercator(m["x"], m["y"]).alias("m"))
    far = [F.max(F.greatest(F.abs(F.col(f"{c}.x") - F.col("lon")), F.abs(F.col(f"{c}.y") - F.col("lat")))) for c in "um"]
    assert max(p.agg(*far).first()) < 1e-8


def test_grids_that_do_not_exist():
    for bad in ({"plane": "moon"}, {"plane": "utm"}, {"plane": "utm", "zone": 61}, {"dx": 0.0}):
        with pytest.raises(ValueError, match="no such grid"):
            Grid(**({"x": 0.0, "y": 0.0, "dx": 1.0, "dy": 1.0} | bad))


def test_method_follows_the_kind_of_values():
    assert [warp.resampling({"method": m}) for m in ("fraction", "percent", "area_m2", "binary", "value_in", "wsf_tracker", "nonzero")] == ["bilinear"] * 3 + ["nearest"] * 4


def test_same_plane_by_plain_python(spark):
    source, target = Grid(100.0, 900.0, 10.0, -10.0, "mercator"), Grid(95.0, 912.0, 7.0, -7.0, "mercator")
    values = {(c, r): None if (c * 3 + r) % 7 == 2 else float(c * c + 5 * r) for c in range(9) for r in range(6)}
    cells = spark.createDataFrame([("c", "d", c, r, v) for (c, r), v in values.items()] + [("c", "d", 20, 20, math.nan), ("other", "d", 0, 0, 5.0)], "city string, dataset string, col long, row long, value double")
    targets = warp.warped_cells(cells.where("city = 'c' and col < 20"), source, target)
    found = {m: {(r.gx, r.gy): r.value for r in warp.warp(cells, source, targets, target, m).collect()} for m in ("nearest", "bilinear")}
    assert set(found["nearest"]) == {(x, y) for x in range(0, 14) for y in range(1, 11)}
    for x, y in found["nearest"]:
        u, v = (95 + 7 * (x + 0.5) - 100) / 10, (912 - 7 * (y + 0.5) - 900) / -10
        assert found["nearest"][x, y] == values.get((math.floor(u), math.floor(v)))
        parts = []
        for c in (math.floor(u - 0.5), math.floor(u - 0.5) + 1):
            for r in (math.floor(v - 0.5), math.floor(v - 0.5) + 1):
                if values.get((c, r)) is not None:
                    parts.append(((1 - abs(u - 0.5 - c)) * (1 - abs(v - 0.5 - r)), values[c, r]))
        want = sum(w * z for w, z in parts) / sum(w for w, _ in parts) if sum(w for w, _ in parts) > 0 else None
        assert found["bilinear"][x, y] == (want if want is None else pytest.approx(want))


def test_degrees_to_a_zone_hold_all_cells(spark):
    source, target = Grid(10.0, -0.01, 0.001, 0.001), Grid(500000.0, 0.0, 50.0, 50.0, "utm", 32)
    cells = spark.range(400).selectExpr("'c' as city", "'d' as dataset", "id % 20 as col", "id div 20 as row", "1.0D as value")
    targets = warp.warped_cells(cells, source, target)
    out = warp.warp(cells, source, targets, target)
    # about 20 by 20 cells of 111 m, on both sides of the equator
    assert out.where("value = 1").count() == pytest.approx(2226.4 * 2211.5 / 2500, rel=0.02)
    r = out.where("value = 1").agg(F.min("gy"), F.max("gy")).first()
    assert r[0] < 0 < r[1]
    empty = warp.warp(cells.limit(0), source, targets, target, "bilinear")
    assert empty.where("value is not null").count() == 0 < empty.count()
