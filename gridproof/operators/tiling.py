"""Tile grids and the assignment of boxes and points to tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.functions.geometry import boxes_touch


def make_tiles(areas: DataFrame, size: float, parts: DataFrame | None = None, clip: bool = False, snap: bool = False) -> DataFrame:
    """Square tiles over each area's bounds: city, ix, iy, tile_id, x0, y0, x1, y1, and the grid's origin ox, oy.

    ``areas`` has city and bounds.  With ``parts`` (boxes of each city) only tiles
    that touch a part stay.  tile_id counts the tiles of a city that stay, by ix,
    then iy.  ``clip`` cuts tiles at the area's bounds; ``snap`` starts the grid at
    a multiple of the size.
    """
    s = F.lit(float(size))
    ox, oy = (F.floor(F.col(c) / s) * s if snap else F.col(c) for c in ("xmin", "ymin"))
    grid = areas.withColumn("ox", ox).withColumn("oy", oy)
    for axis, hi, o in (("ix", "xmax", "ox"), ("iy", "ymax", "oy")):
        n = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(o)) / s)).cast("int")
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), n - 1)))
    x0, y0 = F.col("ox") + F.col("ix") * s, F.col("oy") + F.col("iy") * s
    grid = grid.withColumns({"x0": x0, "y0": y0}).withColumns({"x1": F.col("x0") + s, "y1": F.col("y0") + s})
    if parts is not None:
        tile = {"xmin": F.col("x0"), "ymin": F.col("y0"), "xmax": F.col("x1"), "ymax": F.col("y1")}
        part = parts.select(F.col("city").alias("_c"), *[F.col(k).alias(f"_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])
        grid = grid.join(part, (F.col("city") == F.col("_c")) & boxes_touch(tile, {k: F.col(f"_{k}") for k in tile}), "left_semi")
    if clip:
        grid = grid.withColumns({"x0": F.greatest("x0", "xmin"), "y0": F.greatest("y0", "ymin"), "x1": F.least("x1", "xmax"), "y1": F.least("y1", "ymax")})
    # a city has as many tiles as its area holds
    order = F.expr("row_number() over (partition by city order by ix, iy) - 1").cast("long")
    return grid.withColumn("tile_id", order).select("city", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "tile_id", "x0", "y0", "x1", "y1", "ox", "oy")


#: Slack, in tiles, that rounding may need to number a coordinate's tile; the tile's own sides decide.
_SLACK = 1e-9


def assign_tiles(boxes: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """Boxes with ix, iy and tile_id of every tile whose closed square they touch, so an edge on a line counts twice.

    Boxes outside all tiles go.  Cells are numbered from the origin of each
    city's grid and joined by number; the box is then held against the sides of
    the tile.
    """
    s = F.lit(float(size))
    at = boxes.join(tiles.select("city", "ox", "oy").distinct(), "city")
    for axis, lo, hi, o in (("ix", "xmin", "xmax", "ox"), ("iy", "ymin", "ymax", "oy")):
        first, last = F.ceil((F.col(lo) - F.col(o)) / s - _SLACK) - 1, F.floor((F.col(hi) - F.col(o)) / s + _SLACK)
        at = at.withColumn(axis, F.explode(F.sequence(first, last)))
    tile = tiles.select("city", "ox", "oy", "ix", "iy", "tile_id", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    sides = {"xmin": F.col("_x0"), "ymin": F.col("_y0"), "xmax": F.col("_x1"), "ymax": F.col("_y1")}
    met = at.join(tile, ["city", "ox", "oy", "ix", "iy"]).where(boxes_touch({k: F.col(k) for k in sides}, sides))
    return met.select(*boxes.columns, "ix", "iy", "tile_id")


def point_tiles(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """Points (x, y) strictly inside a tile, so each is in one tile at most and those on a line in none."""
    s = F.lit(float(size))
    at = points.join(tiles.select("city", "ox", "oy").distinct(), "city")
    for axis, c, o in (("ix", "x", "ox"), ("iy", "y", "oy")):
        n = (F.col(c) - F.col(o)) / s
        at = at.withColumn(axis, F.explode(F.array_distinct(F.array(F.floor(n - _SLACK), F.floor(n + _SLACK)))))
    tile = tiles.select("city", "ox", "oy", "ix", "iy", "tile_id", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("x") > F.col("_x0")) & (F.col("x") < F.col("_x1")) & (F.col("y") > F.col("_y0")) & (F.col("y") < F.col("_y1"))
    return at.join(tile, ["city", "ox", "oy", "ix", "iy"]).where(inside).select(*points.columns, "ix", "iy", "tile_id")


def tile_density(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """city, tile_id, n_buildings, area_km2, buildings_per_km2, density_class of every tile, with 0 for empty ones."""
    from gridproof.functions.exprs import density_class

    counts = point_tiles(points, tiles, size).groupBy("city", "tile_id").agg(F.count("*").alias("n"))
    km2 = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 1e6
    out = tiles.join(counts, ["city", "tile_id"], "left").select("city", "tile_id", F.coalesce("n", F.lit(0)).alias("n_buildings"), km2.alias("area_km2"))
    out = out.withColumn("buildings_per_km2", F.try_divide("n_buildings", "area_km2"))
    return out.withColumn("density_class", density_class("buildings_per_km2"))


def density_class_summary(density: DataFrame) -> DataFrame:
    return density.groupBy("density_class").agg(
        F.count("*").alias("tiles"),
        F.sum("n_buildings").alias("buildings"),
        F.min("buildings_per_km2").alias("min_density"),
        F.median("buildings_per_km2").alias("median_density"),
        F.max("buildings_per_km2").alias("max_density"),
    )
