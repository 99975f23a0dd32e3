"""Whole validations: all cities, datasets and tiles in one plan, tables written once."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.functions import geometry
from gridproof.operators import charts, dissolve, extract, matching, polygon_metrics, raster, rollup, tiling, vector_metrics
from gridproof.sources.config import Settings
from gridproof.sources.scratch import written
from gridproof.sources.sinks import write_table


def areas_km2(areas: DataFrame) -> DataFrame:
    """Area of the union of each city's areas, as outlines or boxes: what several cover counts once."""
    rings = areas if "ring" in areas.columns else areas.select("city", geometry.box_ring(geometry.box()).alias("ring"))
    return dissolve.dissolve(rings).groupBy("city").agg((F.sum("area_m2") / 1e6).alias("aoi_area_km2"))


def city_tiles(areas: DataFrame, size: float) -> DataFrame:
    """Tiles over the bounds of each city's areas; with several areas or outlines only those that meet one."""
    bounds = areas.groupBy("city").agg(*[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])
    tiles = tiling.make_tiles(bounds, size)
    square = tiles.select("city", "tile_id", *[F.col(a).alias(b) for a, b in (("x0", "xmin"), ("y0", "ymin"), ("x1", "xmax"), ("y1", "ymax"))])
    kept = tiles.join(extract.extract(square, areas).select("city", "tile_id"), ["city", "tile_id"], "left_semi")
    number = F.expr("row_number() over (partition by city order by ix, iy) - 1").cast("long")
    return kept.withColumn("tile_id", number).select(*tiles.columns)


Table = Callable[..., DataFrame]


def vector_tables(refs: DataFrame, cands: DataFrame, areas: DataFrame, settings: Settings, table: Table) -> None:
    """All tables of the cities at hand but the roll-ups; ``table(name, df, csv, by)`` writes one and reads it again."""
    v = settings.vector
    tiles = table("tiles", city_tiles(areas, v.tile_size_m))
    refs, cands = refs.where(F.col("area_m2") >= v.min_area_m2), cands.where(F.col("area_m2") >= v.min_area_m2)
    tiled_refs, tiled_cands = tiling.assign_tiles(refs, tiles, v.tile_size_m), tiling.assign_tiles(cands, tiles, v.tile_size_m)
    rings = "ring" in refs.columns and "ring" in cands.columns
    pairs = matching.candidate_pairs(tiled_refs.drop("ring"), tiled_cands.drop("ring"), v.tau_buffer_m, touching=rings)
    if rings:
        pairs = polygon_metrics.exact_pairs(written(pairs), refs, cands, v.tau_buffer_m)
    found = matching.with_area_error(matching.match(pairs, v.tau_overlap))
    if rings:
        found = polygon_metrics.pair_boundary_f(polygon_metrics.with_rings(found, refs, cands), v.tau_boundary).drop("a", "b")
    matches = table("matches", found, by=("city", "dataset"))
    union = polygon_metrics.tile_boundary_f(polygon_metrics.with_rings(matches, refs, cands), v.tau_boundary) if rings else None
    per_tile = table("tile_metrics", vector_metrics.tile_metrics(tiled_refs, tiled_cands, matches, tau_overlap=v.tau_overlap, tau_buffer=v.tau_buffer_m, boundaries=union, tau_boundary=v.tau_boundary), True)
    km2 = written(areas_km2(areas))
    table("city_summary", vector_metrics.city_summary(per_tile, matches, km2), True)
    table("size_bins", vector_metrics.size_bin_metrics(matches, refs, cands), True)
    table("density", vector_metrics.density_summary(refs, cands, km2), True)


def roll_ups(cities: DataFrame, per_tile: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Tables over all cities, by name."""
    return {"iou_histogram": charts.iou_histogram(per_tile, matches), "global_by_dataset": rollup.vector_by_dataset(cities), "best_per_city": rollup.best_vector_per_city(cities)}


def validate_vector(refs: DataFrame, cands: DataFrame, areas: DataFrame, settings: Settings) -> dict[str, bool]:
    """Writes matches, tile, city, size and density tables and the global roll-up; says which were written.

    Footprints with a ``ring`` are compared as polygons: their boxes find pairs,
    the rings decide, and boundary scores are added.  Others are boxes.

    Later tables read the written earlier ones, so nothing is worked out twice.
    A table that is complete stays unless overwriting is asked for.
    """
    spark, root = refs.sparkSession, settings.output.root_dir.rstrip("/")
    done: dict[str, bool] = {}
    tables: dict[str, DataFrame] = {}

    def table(name: str, df: DataFrame, csv: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
        done[name] = write_table(df, f"{root}/{name}", settings.output.overwrite, by, csv)
        tables[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
        return tables[name]

    vector_tables(refs, cands, areas, settings, table)
    for name, df in roll_ups(tables["city_summary"], tables["tile_metrics"], tables["matches"]).items():
        table(name, df, True)
    return done


def validate_raster(refs: DataFrame, pixels: DataFrame, areas: DataFrame, settings: Settings) -> dict[str, bool]:
    """Writes raster tile and city tables of all enabled products and allowed grids, and the roll-up.

    Where areas have a ``ring``, only cells in an area of the city are valid.
    """
    spark, s, root = refs.sparkSession, settings.raster, settings.output.root_dir.rstrip("/")
    size = settings.vector.tile_size_m
    tiles = written(city_tiles(areas, size))
    outlines = areas if "ring" in areas.columns else None
    guard = s.native_resolution_guard
    out = None
    # what references and areas give is the same for all products of a grid
    shared: dict[tuple, DataFrame] = {}

    def once(name: str, *key, make: Callable[[], DataFrame]) -> DataFrame:
        if (name, *key) not in shared:
            shared[name, *key] = written(make())
        return shared[name, *key]

    built = written(raster.built_counts(refs, tiles, size))
    for product in s.products:
        if not product.enabled:
            continue
        resolution = product.native_resolution_m or 10.0
        native = raster.native_cells(pixels.where(F.col("dataset") == product.name), resolution, product.binarize, product.min_building_m2).withColumn("dataset", F.lit(product.label))
        for grid in s.evaluation_grids:
            finer = guard.enabled and product.native_resolution_m is not None and not product.allow_finer_than_native and grid.resolution < resolution * guard.tolerance_factor
            if finer and guard.mode == "error":
                raise ValueError(f"{grid.name} is finer than {product.name}")
            if finer and guard.mode == "skip_finer":
                continue
            finest, touched = product.oversample_factor or s.oversample_factor, product.all_touched
            fraction = once("fraction", grid.resolution, finest, touched, make=partial(raster.reference_fraction, refs, grid.resolution, finest, touched))
            cells = once("cells", grid.resolution, touched, make=partial(raster.tile_cells, tiles, grid.resolution, outlines, touched))
            part = raster.metrics_of_cells(cells, fraction, built, native, resolution, grid.resolution, grid.name, s.min_building_m2)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return {}
    done = {"raster_tile_metrics": write_table(out, f"{root}/raster_tile_metrics", settings.output.overwrite, csv=True)}
    per_tile = spark.read.schema(out.schema).parquet(f"{root}/raster_tile_metrics")
    cities = refs.groupBy("city").agg(F.count("*").alias("n_ref_buildings"), F.avg("area_m2").alias("avg_building_size_m2")).join(areas_km2(areas), "city")
    for name, df in (("raster_city_summary", c := raster.city_summary(per_tile, cities)), ("raster_global", rollup.raster_by_dataset_grid(c)), ("raster_best", rollup.best_raster_per_city_grid(c))):
        done[name] = write_table(df, f"{root}/{name}", settings.output.overwrite, csv=True)
    return done
