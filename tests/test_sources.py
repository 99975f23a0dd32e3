"""Sources, sinks, settings, whole runs and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from gridproof.plans import fixtures as fx
from gridproof.plans.validate import validate_raster, validate_vector
from gridproof.sources import config, readers, sinks

SF = "/root/testdata/sf0.001"


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = readers.read_footprints(spark, str(path))
    assert df.count() == 3
    loaded = readers.load_buildings(df, 10.0)
    assert {r.area_m2 for r in loaded.collect()} == {16.0}
    assert readers.load_buildings(df, 17.0).count() == 0
    assert sinks.write_geojson(loaded, str(tmp_path / "out"))
    assert not sinks.write_geojson(loaded, str(tmp_path / "out"))


def test_holes_are_read_and_written(spark, tmp_path):
    ring, hole = ([[a, a], [b, a], [b, b], [a, b], [a, a]] for a, b in ((0, 10), (4, 6)))
    feature = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring, hole, [[1, 1], [2, 2]]]}}
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    loaded = readers.load_buildings(readers.read_geojson(spark, str(path)), 20.0)
    assert [(r.area_m2, len(r.holes)) for r in loaded.collect()] == [(96.0, 1)]
    sinks.write_geojson(loaded, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert [len(r) for r in line["geometry"]["coordinates"]] == [6, 6] and "holes" not in line["properties"]


def test_footprints_of_degrees(spark):
    d = 1e-4
    ring = [(3.0, 50.0), (3.0 + d, 50.0), (3.0 + d, 50.0 + d), (3.0, 50.0 + d)]
    df = spark.createDataFrame([(1, ring), (2, None), (3, [(3.0, 50.0)])], "bld_id int, ring array<struct<x:double,y:double>>")
    got = readers.load_buildings(df, 20.0, zone=31).collect()
    assert [r.bld_id for r in got] == [1]
    assert abs(got[0].area_m2 - 7.169 * 11.123) < 0.2 and abs(got[0].xmin - 500000) < 1e-6


def test_hive_extract_prunes_and_pushes(spark, tmp_path):
    base = str(tmp_path / "hive")
    df = spark.range(10).select(F.lit("buildings").alias("theme"), F.when(F.col("id") < 5, "building").otherwise("part").alias("type"), F.struct(*[(F.col("id") * 10.0 + d).alias(k) for k, d in (("xmin", 0), ("xmax", 5), ("ymin", 0), ("ymax", 5))]).alias("bbox"))
    df.write.partitionBy("theme", "type").parquet(base)
    got = readers.read_extract(spark, base, (5.0, 5.0, 20.0, 20.0), "buildings", "building")
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(theme" in plan and "bbox.xmin" in plan.split("PushedFilters")[1]


def test_ragged_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b,c\n1\n1,2,3,4\n")
    assert [tuple(r) for r in readers.read_strings(spark, str(path), ["a", "b", "c"]).collect()] == [("1", None, None), ("1", "2", "3")]


def test_city_summaries_take_the_folder(spark, tmp_path):
    for city in ("x", "y"):
        spark.createDataFrame([("wrong", 1)], "city string, v int").write.parquet(str(tmp_path / city / "s.parquet"))
    assert {r.city for r in readers.read_city_summaries(spark, str(tmp_path), "s").collect()} == {"x", "y"}
    assert {r.city for r in readers.read_city_summaries(spark, str(tmp_path), "s", False).collect()} == {"wrong"}
    assert readers.list_files(spark, str(tmp_path), "*.parquet").count() >= 2
    for city in ("x", "z"):
        (tmp_path / city).mkdir(exist_ok=True)
        (tmp_path / city / "s.csv").write_text("city,v\nwrong,7\n")
    assert sorted((r.city, r.v) for r in readers.read_city_summaries(spark, str(tmp_path), "s").collect()) == [("x", 1), ("y", 1), ("z", 7)]
    with pytest.raises(FileNotFoundError):
        readers.read_city_summaries(spark, str(tmp_path), "none")


def test_settings():
    s = config.build(config.Settings, {"vector": {"tile_size_m": 500}, "raster": {"evaluation_grids": [{"resolution": 30}]}})
    assert (s.vector.tile_size_m, s.raster.evaluation_grids[0].name) == (500, "30m")
    with pytest.raises(KeyError):
        config.build(config.Settings, {"vectors": {}})
    with pytest.raises(ValueError):
        config.Grid(0)


def test_whole_run_is_idempotent(spark, tmp_path):
    s = config.Settings(output=config.Output(str(tmp_path)))
    s.raster.products = [config.RasterProduct("share", 20.0), config.RasterProduct("codes", 20.0, binarize={"method": "wsf_tracker"})]
    refs, cands, areas = fx.references(spark, SF), fx.candidates(spark, SF), fx.areas(spark)
    assert all(validate_vector(refs, cands, areas, s).values())
    assert not any(validate_vector(refs, cands, areas, s).values())
    cities = spark.read.parquet(f"{tmp_path}/city_summary")
    assert cities.count() == 12
    small = areas.withColumns({"xmax": F.col("xmin") + 600, "ymax": F.col("ymin") + 600})
    assert all(validate_raster(refs, fx.pixels(spark), small, s).values())
    # 10 m is finer than three quarters of the native 20 m
    assert {r.grid for r in spark.read.parquet(f"{tmp_path}/raster_city_summary").select("grid").distinct().collect()} == {"100m"}


def test_raster_run_inside_an_outline(spark, tmp_path):
    s = config.Settings(output=config.Output(str(tmp_path)))
    s.raster.products = [config.RasterProduct("share", 20.0)]
    s.raster.evaluation_grids = [config.Grid(100.0)]
    corners = (("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax"))
    areas = fx.areas(spark).where("city = 'city_0'").withColumns({"xmax": F.col("xmin") + 1500, "ymax": F.col("ymin") + 1500}).withColumn("ring", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))
    assert all(validate_raster(fx.references(spark, SF), fx.pixels(spark).where("city = 'city_0'"), areas, s).values())
    tiles = spark.read.parquet(f"{tmp_path}/raster_tile_metrics").collect()
    # of the four tiles of 1000 m the one beyond the slope goes
    assert sorted(r.tile_id for r in tiles) == [0, 1, 2]
    valid = sum(r.n_valid for r in tiles)
    assert 0.85 * 112.5 < valid < 1.1 * 112.5
    assert abs(spark.read.parquet(f"{tmp_path}/raster_city_summary").first().aoi_area_km2 - 1.125) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    from gridproof.streaming import updates

    rows = spark.createDataFrame([("c", "d", k % 3, k / 10) for k in range(10)], "city string, dataset string, tile_id long, iou double")
    for k in range(2):
        rows.where(f"tile_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = updates.stream_tables(spark, str(tmp_path / "in" / "*"), rows.schema, 1)
    updates.write_counts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {(r.tile_id, r.tp) for r in updates.latest(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.tile_id, r.tp) for r in updates.tile_counts(rows).collect()}
