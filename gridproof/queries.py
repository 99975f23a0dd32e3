"""Registered queries: each applies one operator to tables derived from the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.functions import exprs, geometry, names
from gridproof.operators import charts, cover, dissolve, extract, inventory, matching, raster, releases, rollup, tiling, vector_metrics, warp
from gridproof.plans import fixtures as fx
from gridproof.sources.scratch import written

TILE = 1000.0
NATIVE, MIN_AREA = 20, 20.0
SPECS = {"share": {"method": "fraction"}, "codes": {"method": "wsf_tracker", "nonbuilt_value": 0, "built_value_min": 1, "as_of_code": 19}}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tiles(spark: SparkSession) -> DataFrame:
    return tiling.make_tiles(fx.areas(spark), TILE)


def areas_km2(spark: SparkSession) -> DataFrame:
    return fx.areas(spark).select("city", (geometry.box_area(geometry.box()) / 1e6).alias("aoi_area_km2"))


def tiled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tiles(spark)
    return tiling.assign_tiles(fx.references(spark, d), t, TILE), tiling.assign_tiles(fx.candidates(spark, d), t, TILE)


def matches(spark: SparkSession, d: str) -> DataFrame:
    refs, cands = tiled(spark, d)
    return matching.with_area_error(matching.match_boxes(refs, cands))


def vector_tiles(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    refs, cands = tiled(spark, d)
    return vector_metrics.tile_metrics(refs, cands, matches(spark, d) if found is None else found)


def vector_cities(spark: SparkSession, d: str) -> DataFrame:
    found = written(matches(spark, d))
    return vector_metrics.city_summary(vector_tiles(spark, d, found), found, areas_km2(spark))


def native(spark: SparkSession, dataset: str) -> DataFrame:
    return raster.native_cells(fx.pixels(spark, NATIVE).where(F.col("dataset") == dataset), NATIVE, SPECS[dataset], MIN_AREA)


def raster_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Both products at 50 and 100 m in tiles of 300 m."""
    grid = tiling.make_tiles(fx.areas(spark), 300.0)
    refs = fx.references(spark, d)
    out = None
    for dataset in SPECS:
        for size in (50, 100):
            part = raster.tile_metrics(grid, refs, native(spark, dataset), NATIVE, size, f"{size}m", MIN_AREA, 4, 300.0)
            out = part if out is None else out.unionByName(part)
    return out


def raster_cities(spark: SparkSession, d: str) -> DataFrame:
    cities = fx.references(spark, d).groupBy("city").agg(F.count("*").alias("n_ref_buildings"), F.avg("area_m2").alias("avg_building_size_m2")).join(areas_km2(spark), "city")
    return raster.city_summary(raster_tiles(spark, d), cities)


def tile_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Footprints of all sources with every tile that they touch."""
    refs, cands = tiled(spark, d)
    keep = ["city", "source", "bld_id", "tile_id"]
    return refs.withColumn("source", F.lit("reference")).select(*keep).unionByName(cands.withColumn("source", F.col("dataset")).select(*keep))


def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid of 700 m, cut at the area and reduced to its first two parts."""
    return tiling.make_tiles(fx.areas(spark), 700.0, fx.sub_areas(spark).where("sub_aoi_id <> 'part_2'"), clip=True).drop("ox", "oy")


def candidate_pairs_iou(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.candidate_pairs(*tiled(spark, d)))


def buffered_pairs_iou(spark: SparkSession, d: str) -> DataFrame:
    """IoU of boxes grown by 2 m with square corners."""
    return rounded(matching.candidate_pairs(*tiled(spark, d), buffer=2.0))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matches(spark, d))


def unmatched_references(spark: SparkSession, d: str) -> DataFrame:
    refs, cands = tiled(spark, d)
    per = refs.crossJoin(spark.createDataFrame([(f"ds_{k}",) for k in range(3)], "dataset string"))
    return matching.unmatched(per.select("city", "dataset", "tile_id", "bld_id"), matches(spark, d), "ref_id")


def tile_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_tiles(spark, d))


def city_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_cities(spark, d))


def size_bin_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_metrics.size_bin_metrics(written(matches(spark, d)), fx.references(spark, d), fx.candidates(spark, d)).drop("mean_boundary_f"))


def density_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_metrics.density_summary(fx.references(spark, d), fx.candidates(spark, d), areas_km2(spark)))


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Part prices with some missing, NaN and infinite values, and weights with NULL and 0."""
    return fx.table(spark, d, "part").selectExpr(
        "p_brand as grp",
        "case when p_partkey % 7 = 0 then null when p_partkey % 11 = 0 then double('NaN') when p_partkey % 13 = 0 then double('Infinity') else p_retailprice end as value",
        "case when p_partkey % 5 = 0 then null when p_partkey % 17 = 0 then 0D else cast(p_size as double) end as weight",
    )


def weighted_mean_skipna(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.weighted(_metric_rows(spark, d), ["value"], "weight", ["grp"]), 4)


def weighted_mean_zero(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.weighted(_metric_rows(spark, d), ["value"], "weight", ["grp"], zero=True), 4)


def vector_global_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.vector_by_dataset(vector_cities(spark, d).drop("n_sub_areas")))


def best_dataset_per_city(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.best_vector_per_city(vector_cities(spark, d)))


def pixel_binarize(spark: SparkSession, d: str) -> DataFrame:
    out = native(spark, "share").unionByName(native(spark, "codes"))
    return rounded(out.select("city", "dataset", "row", "col", "valid", "area", "built"))


#: One spec for each method.
METHODS = (
    {"method": "fraction"}, {"method": "percent"}, {"method": "area_m2"}, {"method": "binary", "threshold": 0.5}, {"method": "nonzero"},
    {"method": "value_in", "values": [3, 5, 8]}, {"method": "wsf_tracker", "as_of_code": 10}, {"method": "wsf_tracker", "as_of_code": 19, "threshold_frac": 0.5},
)


def predicted_area_methods(spark: SparkSession, d: str) -> DataFrame:
    """Built area and bin of every code under each method."""
    cells = fx.pixels(spark, NATIVE).where("dataset = 'codes'")
    out = None
    for k, spec in enumerate(METHODS):
        part = raster.native_cells(cells, NATIVE, spec, MIN_AREA).select(F.lit(k).alias("method"), "city", "row", "col", "area", "built")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def regrid_block_average(spark: SparkSession, d: str) -> DataFrame:
    """Native 20 m cells on 50 m cells: each shares area with several."""
    return rounded(raster.regrid(native(spark, "share"), NATIVE, 50))


def ref_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.reference_fraction(fx.references(spark, d), 10, 4))


def raster_tile_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster_tiles(spark, d))


def raster_city_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster_cities(spark, d))


def qa_disagreement(spark: SparkSession, d: str) -> DataFrame:
    t = raster_tiles(spark, d).groupBy("dataset", "grid").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    q, a = raster.disagreement("tp", "fp", "fn", "tn")
    return rounded(t.select("dataset", "grid", q.alias("quantity"), a.alias("allocation")))


def native_guard(spark: SparkSession, d: str) -> DataFrame:
    grids = spark.createDataFrame([("10m", 10.0), ("100m", 100.0)], "grid string, resolution_m double")
    products = fx.table(spark, d, "supplier").selectExpr("s_suppkey", "if(s_suppkey % 9 = 0, null, cast(s_suppkey % 40 * 4 as double)) as native_resolution_m", "s_suppkey % 10 = 3 as allow_finer_than_native")
    return raster.guard(grids, products, 0.95).select("s_suppkey", "grid")


def raster_mosaic_clip(spark: SparkSession, d: str) -> DataFrame:
    """Two shifted rasters, the first on top, cut to the parts of each city."""
    a = fx.pixels(spark, NATIVE).where("dataset = 'share'").select("city", "dataset", "x", "y", "value")
    b = a.select("city", "dataset", (F.col("x") + 200).alias("x"), "y", (F.col("value") + 1).alias("value"))
    return rounded(raster.clip_to_areas(raster.mosaic([a, b]), fx.sub_areas(spark), NATIVE))


def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.pixels(spark, NATIVE).where("dataset = 'share'")
    points = fx.references(spark, d).select("city", F.lit("share").alias("dataset"), F.col("xmin").alias("px"), F.col("ymin").alias("py")).distinct()
    return rounded(raster.bilinear(cells, points, NATIVE))


def raster_global_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.raster_by_dataset_grid(raster_cities(spark, d)))


def best_raster_per_city_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollup.best_raster_per_city_grid(raster_cities(spark, d)))


def _drive(spark: SparkSession, d: str) -> DataFrame:
    return inventory.file_tree(fx.drive_items(spark, d))


def name_match_scores(spark: SparkSession, d: str) -> DataFrame:
    return inventory.match_candidates(fx.sheet(spark, d), _drive(spark, d))


def best_folder_match(spark: SparkSession, d: str) -> DataFrame:
    return inventory.best_matches(name_match_scores(spark, d))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    drive = _drive(spark, d)
    return inventory.download_summary(fx.sheet(spark, d), drive, inventory.match_candidates(fx.sheet(spark, d), drive))


def download_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)


def unmatched_codes(spark: SparkSession, d: str) -> DataFrame:
    return inventory.unmatched_codes(_summary(spark, d))


def duplicate_codes(spark: SparkSession, d: str) -> DataFrame:
    return inventory.duplicate_codes(_summary(spark, d))


def duplicate_matches(spark: SparkSession, d: str) -> DataFrame:
    return inventory.duplicate_matches(name_match_scores(spark, d), fx.sheet(spark, d))


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    return inventory.file_manifest(_summary(spark, d), _drive(spark, d))


def aoi_ref_listing(spark: SparkSession, d: str) -> DataFrame:
    return inventory.file_listing(_summary(spark, d), _drive(spark, d))


def quality_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.quality_values(fx.sheet(spark, d), 3)


def tracker_explode(spark: SparkSession, d: str) -> DataFrame:
    return inventory.tracked_areas(fx.tracker(spark, d))


def tracker_references(spark: SparkSession, d: str) -> DataFrame:
    r = inventory.tracked_references(fx.tracker(spark, d))
    return r.select("dataset", "slug", F.array_join("ref_paths", "|").alias("ref_paths"), "ref_path")


def validation_areas(spark: SparkSession, d: str) -> DataFrame:
    return inventory.validation_areas(fx.tracker(spark, d))


def tracker_high_quality(spark: SparkSession, d: str) -> DataFrame:
    return inventory.tracked_areas(fx.tracker(spark, d), suitable_only=False, high_quality_only=True)


def quality_flag(spark: SparkSession, d: str) -> DataFrame:
    return fx.tracker(spark, d).select("row_id", "dataset_folder_name", names.quality_flag("suitable").alias("is_high_quality"), names.truthy("has_aoi_file").alias("has_file"), names.slug("dataset_folder_name").alias("slug"), names.title("dataset_folder_name").alias("label"))


def inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = inventory.map_rows(fx.map_listing(spark, d))
    return rounded(rows.withColumns({c: F.array_join(c, " | ") for c in ("aoi_file_paths", "aoi_file_names")}))


def bbox_extract(spark: SparkSession, d: str) -> DataFrame:
    part = fx.sub_areas(spark).where("sub_aoi_id = 'part_1'")
    return extract.extract(fx.candidates(spark, d), part).select("city", "dataset", "bld_id")


def sub_aoi_tagging(spark: SparkSession, d: str) -> DataFrame:
    return extract.tag_sub_areas(fx.references(spark, d), fx.sub_areas(spark)).select("city", "bld_id", "sub_aoi_id")


def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ten ranges of part keys, with gaps."""
    ranges = spark.range(10).selectExpr("id * 173 as lo", "id * 173 + 150 as hi", "900 + id as article_id")
    return extract.range_lookup(fx.table(spark, d, "part").select("p_partkey"), ranges, "p_partkey")


def tracker_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Names of raster tiles parsed into dates and boxes, and those that touch two areas."""
    paths = fx.table(spark, d, "supplier").selectExpr("concat('/tiles/', case when s_suppkey % 6 = 0 then 'other_' else 'WSFtracker_' end, '20160701', if(s_suppkey % 2 = 0, '-', '_'), '20200701_', s_suppkey % 40 - 20, '_', s_suppkey % 30 - 15, '.tif') as path")
    some = spark.createDataFrame([(-3.0, -3.0, 4.0, 5.0), (10.0, 1.0, 11.0, 2.0)], "xmin double, ymin double, xmax double, ymax double")
    index = extract.parse_tracker_tiles(paths)
    return rounded(extract.touching_tiles(index, some).select("name", "start", "end", "lon", "lat", "xmin", "ymax"))


def split_bounds(spark: SparkSession, d: str) -> DataFrame:
    """All reference boxes in pieces."""
    return extract.split_bounds(fx.references(spark, d).select("bld_id", *geometry.BOX), 7.0, 5.0).select("bld_id", "i", "j", "x0", "y0", "x1", "y1")


def split_bounds_all(spark: SparkSession, d: str) -> DataFrame:
    return split_bounds(spark, d)


def select_files(spark: SparkSession, d: str) -> DataFrame:
    """Archives first, then shapefile parts, then any name with the tile number."""
    files = fx.table(spark, d, "part").selectExpr("p_size as tile", "concat('tile_', p_size, case when p_partkey % 5 = 0 then '.zip' when p_partkey % 3 = 0 then '.shp' else '.txt' end, if(p_partkey % 2 = 0, '', '.bak')) as name", "p_partkey")
    return extract.select_files(files, ["tile"], [r"\.zip$", r"\.(shp|dbf|shx|prj)$", "tile_"]).select("tile", "name", "p_partkey")


def first_file(spark: SparkSession, d: str) -> DataFrame:
    files = fx.table(spark, d, "part").selectExpr("p_brand as dataset", "concat(p_brand, '_', p_partkey, '.parquet') as name")
    return extract.first_file(files, ["dataset"], r"\.parquet$")


def work_list(spark: SparkSession, d: str) -> DataFrame:
    return extract.work_list(fx.table(spark, d, "region").select(F.lower("r_name").alias("product")), [2018, 2020, 2025])


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Centres of the reference boxes."""
    return fx.references(spark, d).select("city", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))


def tile_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiling.tile_density(_points(spark, d), tiles(spark), TILE))


def density_class_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiling.density_class_summary(tiling.tile_density(_points(spark, d), tiles(spark), TILE)))


def iou_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = written(matches(spark, d))
    return rounded(charts.iou_histogram(vector_tiles(spark, d, found), found))


def iou_mean(spark: SparkSession, d: str) -> DataFrame:
    found = written(matches(spark, d))
    return rounded(charts.mean_iou(vector_tiles(spark, d, found), found))


def iou_by_size_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.iou_by_class(matches(spark, d)))


def _triangles(spark: SparkSession) -> DataFrame:
    """The lower left half of each area."""
    corners = (("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax"))
    return fx.areas(spark).withColumn("ring", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))


def outline_extract(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that touch a triangle."""
    return extract.extract(fx.candidates(spark, d), _triangles(spark)).select("city", "dataset", "bld_id")


def buffered_extract(spark: SparkSession, d: str) -> DataFrame:
    """Candidates within 25 m of a part."""
    return extract.extract(fx.candidates(spark, d), fx.sub_areas(spark).where("sub_aoi_id = 'part_2'"), 25.0).select("city", "dataset", "bld_id")


def area_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 50 m of all tiles, and whether their centre is in the triangle."""
    return raster.tile_cells(tiles(spark), 50.0, _triangles(spark)).drop("tile_id")


def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.box_plot(vector_tiles(spark, d), ["dataset"], "f1"))


def iou_by_size_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.iou_by_size(matches(spark, d)))


def f1_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.pivot(vector_cities(spark, d), "f1_city", ["ds_0", "ds_1", "ds_2"]))


def tile_f1_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.tile_map(tiles(spark).select("city", "tile_id"), vector_tiles(spark, d).where("dataset = 'ds_1' and f1 > 0.9"), "f1"))


def _hexagons(spark: SparkSession, d: str) -> DataFrame:
    """A six-cornered ring around each reference box's lower left part, with one corner drawn in."""
    r = fx.references(spark, d)
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    corners = ((0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h))
    ring = F.array(*[F.struct((F.col("xmin") + x).cast("double").alias("x"), (F.col("ymin") + y).cast("double").alias("y")) for x, y in corners])
    return r.select("city", "bld_id", "xmin", "ymin", w.alias("w"), h.alias("h"), ring.alias("ring"))


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    c = geometry.ring_centroid("ring")
    return rounded(_hexagons(spark, d).select("bld_id", geometry.ring_area("ring").alias("area"), geometry.ring_length("ring").alias("length"), c["x"].alias("cx"), c["y"].alias("cy")))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("xmin") + F.col("w") * ((F.col("bld_id") % 10) / 10.0), F.col("ymin") + F.col("h") * ((F.col("bld_id") % 7) / 7.0)
    return _hexagons(spark, d).select("bld_id", geometry.point_in_ring(x, y, "ring").alias("inside"))


def size_bins(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").groupBy(exprs.right_closed_bin(F.expr("cast(p_size * p_size as double)")).alias("size_bin")).agg(F.count("*").alias("n"))


def utm_projection(spark: SparkSession, d: str) -> DataFrame:
    """UTM zone, code and plane coordinates of points spread over the globe."""
    p = fx.table(spark, d, "supplier").selectExpr("s_suppkey", "cast((s_suppkey * 37) % 359 as double) - 179.5D as lon", "cast((s_suppkey * 53) % 159 as double) - 79.5D as lat")
    out = p.select("s_suppkey", geometry.utm_epsg("lon", "lat").alias("epsg"), geometry.utm("lon", "lat").alias("p"))
    return rounded(out.select("s_suppkey", "epsg", F.col("p.x").alias("x"), F.col("p.y").alias("y")), 3)


def _pairs_of_rings(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d).select("city", "dataset", "tile_id", "ref_id", "cand_id")
    r = fx.references(spark, d).select(F.col("bld_id").alias("ref_id"), geometry.box_ring(geometry.box()).alias("a"))
    c = fx.candidates(spark, d).select(F.col("bld_id").alias("cand_id"), geometry.box_ring(geometry.box()).alias("b"))
    return m.join(r, "ref_id").join(c, "cand_id")


def polygon_iou_buffered(spark: SparkSession, d: str) -> DataFrame:
    from gridproof.operators import polygon_metrics

    return rounded(polygon_metrics.pair_iou(_pairs_of_rings(spark, d), 2.0).drop("a", "b"))


def boundary_f_pair(spark: SparkSession, d: str) -> DataFrame:
    from gridproof.operators import polygon_metrics

    return rounded(polygon_metrics.pair_boundary_f(_pairs_of_rings(spark, d), 2.0).drop("a", "b"))


def boundary_f_tile(spark: SparkSession, d: str) -> DataFrame:
    from gridproof.operators import polygon_metrics

    return rounded(polygon_metrics.tile_boundary_f(_pairs_of_rings(spark, d), 2.0))


def dissolved_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of the union of each city's overlapping parts."""
    from gridproof.operators import polygon_metrics

    return rounded(polygon_metrics.union_area(fx.sub_areas(spark).select("city", geometry.box_ring(geometry.box()).alias("ring")), ["city"], "ring"))


def _ring_at(x, y, corners) -> F.Column:
    return F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in corners])


def _diamonds(spark: SparkSession, d: str) -> DataFrame:
    """A square on its corner for each order, the larger ones with a hole; they overlap."""
    k = fx.table(spark, d, "orders").selectExpr("concat('city_', o_orderkey % 4) as city", f"(o_orderkey * 7919) % 3001 + {fx.corner(0, 'o_orderkey % 4')} as x", f"(o_orderkey * 104729) % 3001 + {fx.corner(1, 'o_orderkey % 4')} as y", "3 + o_orderkey % 5 as r")

    def diamond(r):
        return _ring_at(F.col("x"), F.col("y"), ((r, 0), (0, r), (-r, 0), (0, -r)))

    return k.select("city", diamond(F.col("r")).alias("ring"), F.when(F.col("r") >= 5, F.array(diamond(F.col("r") - 3))).alias("holes"))


def dissolved_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Area and bounds of the union of each city's diamonds, from its traced rings."""
    parts = dissolve.dissolve(_diamonds(spark, d))
    return rounded(parts.groupBy("city").agg(F.sum("area_m2").alias("area_m2"), *[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]), 3)


def repaired_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Parts and area of a broken ring for each reference: a bow tie, a square with a hole that sticks out, or one with a spike."""
    r = fx.references(spark, d).select("bld_id", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (1 + F.col("bld_id") % 9).alias("a"), (F.col("bld_id") % 3).alias("kind"))
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    tie = _ring_at(x, y, ((0, 0), (2 * a, 2 * a), (2 * a, 0), (0, 2 * a)))
    square = _ring_at(x, y, ((0, 0), (2 * a, 0), (2 * a, 2 * a), (0, 2 * a)))
    hole = _ring_at(x, y, ((a, a / 2), (3 * a, a / 2), (3 * a, 3 * a / 2), (a, 3 * a / 2)))
    spike = _ring_at(x, y, ((0, 0), (2 * a, 0), (4 * a, 0), (2 * a, 0), (2 * a, 2 * a), (0, 2 * a)))
    broken = r.select("bld_id", F.when(F.col("kind") == 0, tie).when(F.col("kind") == 1, square).otherwise(spike).alias("ring"), F.when(F.col("kind") == 1, F.array(hole)).alias("holes"))
    return rounded(dissolve.repair(broken).groupBy("bld_id").agg(F.count("*").alias("n_parts"), F.sum("area_m2").alias("area_m2")), 3)


def buffered_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Area of squares on a grid of 40 m after a round buffer of 6 m, by city."""
    s = fx.table(spark, d, "orders").selectExpr("concat('city_', o_orderkey % 4) as city", "cast(o_orderkey div 4 % 300 * 40 as double) as x", "cast(o_orderkey div 1200 * 40 as double) as y", "cast(4 + o_orderkey % 23 as double) as s")
    side = F.col("s")
    rings = s.select("city", _ring_at(F.col("x"), F.col("y"), ((0, 0), (side, 0), (side, side), (0, side))).alias("ring"))
    return rounded(dissolve.buffered(rings, 6.0).groupBy("city").agg(F.count("*").alias("n_parts"), F.sum("area_m2").alias("area_m2")), 2)


#: A raster in degrees of which each order fills a cell, 120 to a row, and the plane it is brought to.
_DEGREES, _PLANE = warp.Grid(10.0, 50.25, 0.0005, -0.0005), warp.Grid(571300.0, 5566700.0, 40.0, -40.0, "utm", 32)


def _degree_cells(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").selectExpr("'c' as city", "'orders' as dataset", "o_orderkey % 120 as col", "o_orderkey div 120 as row", "if(o_orderkey % 17 = 3, null, cast(o_orderkey * 7919 % 1009 as double)) as value")


def raster_warp(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 40 m in a plane, a row of 110 for each 110 orders, with the nearest and the bilinear value of a raster in degrees."""
    cells = _degree_cells(spark, d)
    targets = fx.table(spark, d, "orders").selectExpr("'c' as city", "'orders' as dataset", "o_orderkey % 110 as gx", "o_orderkey div 110 as gy")
    near, between = (warp.warp(cells, _DEGREES, targets, _PLANE, m).withColumnRenamed("value", m) for m in ("nearest", "bilinear"))
    return rounded(near.join(between, ["city", "dataset", "gx", "gy"]).drop("city", "dataset"), 4)


def _order_pixels(spark: SparkSession, d: str, value: str) -> DataFrame:
    """A cell of 20 m for each order, 100 to a row of its city's raster."""
    k = fx.table(spark, d, "orders").selectExpr("o_orderkey as k", "concat('city_', o_orderkey % 4) as city", "o_orderkey div 4 % 100 as col", "o_orderkey div 400 as row")
    return k.selectExpr("city", "'orders' as dataset", "row", "col", "cast(col * 20 as double) as x", "cast(row * 20 as double) as y", f"if(k % 29 = 0, null, {value}) as value")


def order_area_methods(spark: SparkSession, d: str) -> DataFrame:
    """Built area and bin of each order's code under each method."""
    cells, out = _order_pixels(spark, d, "cast(k % 25 as double)"), None
    for k, spec in enumerate(METHODS):
        part = raster.native_cells(cells, NATIVE, spec, MIN_AREA).select(F.lit(k).alias("method"), "city", "row", "col", "area", "built")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def order_regrid(spark: SparkSession, d: str) -> DataFrame:
    """Shares of orders' cells of 20 m on cells of 50 m."""
    cells = raster.native_cells(_order_pixels(spark, d, "k * 7 % 101 / 100D"), NATIVE, SPECS["share"], MIN_AREA)
    return rounded(raster.regrid(cells, NATIVE, 50))


def order_mosaic_clip(spark: SparkSession, d: str) -> DataFrame:
    """Orders' raster over the same one moved by 200 m, cut by the outline of a triangle as high as the raster."""
    a = _order_pixels(spark, d, "k * 7 % 101 / 100D").select("city", "dataset", "x", "y", "value")
    b = a.select("city", "dataset", (F.col("x") + 200).alias("x"), "y", (F.col("value") + 1).alias("value"))
    high = fx.table(spark, d, "orders").selectExpr("concat('city_', o_orderkey % 4) as city", "o_orderkey div 400 * 20 + 21.0D as h").groupBy("city").agg(F.max("h").alias("h"))
    zero, wide = F.lit(0.0), F.lit(2001.0)
    areas = high.select("city", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (wide, zero), (zero, F.col("h")))]).alias("ring"))
    return rounded(raster.clip_to_areas(raster.mosaic([a, b]), areas, NATIVE))


def diamond_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 1.4142 m whose centre lies in a diamond of their city and outside its hole."""
    return cover.interior_cells(_diamonds(spark, d), ["city"], 1.4142)


def release_as_of(spark: SparkSession, d: str) -> DataFrame:
    """For each order's moment the newest event of its kind that isn't later."""
    asked = fx.table(spark, d, "orders").selectExpr("o_orderkey", "element_at(array('view', 'signup', 'click', 'error', 'purchase'), cast(o_orderkey % 5 + 1 as int)) as event_type", "timestamp_seconds(1704067200 + o_orderkey * 397 % 2592000) as moment")
    found = releases.as_of(asked, fx.table(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], "moment", "ts")
    return found.select("o_orderkey", "event_type", F.col("release.event_id").alias("event_id"))


def temporal_composite(spark: SparkSession, d: str) -> DataFrame:
    """For each day with an event: the newest value, at most 6 days old, of cells that events fill, purchases before clicks before views."""
    e = fx.table(spark, d, "events").selectExpr("user_id % 50 as col", "event_id % 40 as row", "ts", "event_type", "value", "event_id")
    asked = e.select(F.to_date("ts").alias("day")).distinct()
    out = releases.composite(e, asked, ["col", "row"], "ts", "day", 6, "event_type", ("purchase", "click", "view"), F.col("event_id"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("day", "newest")})


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """A tree of customers: each but the first hangs below number div 3."""
    return fx.table(spark, d, "customer").where("c_custkey > 0").selectExpr("c_custkey as id", "if(c_custkey <= 3, null, c_custkey div 3) as parent", "concat('n', c_custkey) as name")


def file_tree(spark: SparkSession, d: str) -> DataFrame:
    """Levels and paths of all customers."""
    return inventory.file_tree(_customers(spark, d)).drop("parent")


def file_tree_all(spark: SparkSession, d: str) -> DataFrame:
    return file_tree(spark, d)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tile_assignment, tile_grid, candidate_pairs_iou, buffered_pairs_iou, greedy_match, unmatched_references, tile_metrics, city_summary, size_bin_metrics, density_summary, weighted_mean_skipna, weighted_mean_zero,
        vector_global_rollup, best_dataset_per_city, pixel_binarize, predicted_area_methods, regrid_block_average, ref_fraction, raster_tile_metrics, raster_city_summary, qa_disagreement, native_guard, raster_mosaic_clip, bilinear_sample,
        raster_global_rollup, best_raster_per_city_grid, name_match_scores, best_folder_match, download_summary, unmatched_codes, duplicate_codes, duplicate_matches, file_manifest, aoi_ref_listing, quality_value_counts, tracker_explode,
        tracker_references, validation_areas, tracker_high_quality, quality_flag, inventory_rows, bbox_extract, sub_aoi_tagging, range_lookup, tracker_tiles, split_bounds, split_bounds_all, select_files, first_file, work_list, tile_density, density_class_summary, iou_histogram, boxplot_stats,
        iou_by_size_quantile, f1_pivot, tile_f1_map, polygon_area, point_in_polygon, size_bins, utm_projection, polygon_iou_buffered, boundary_f_pair, boundary_f_tile, dissolved_area, file_tree, file_tree_all,
        iou_mean, iou_by_size_class, outline_extract, buffered_extract, area_mask, dissolved_outlines, repaired_outlines, buffered_outlines, raster_warp,
        order_area_methods, order_regrid, order_mosaic_clip, diamond_cells, release_as_of, temporal_composite,
    )
}
