"""Extracts of footprints by area, range look-ups, and file choices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridproof.functions.geometry import BOX, box, boxes_touch, inverse_mercator, polygon_area, ring_bounds, utm, utm_zone, web_mercator
from gridproof.operators import cover, dissolve
from gridproof.sources.scratch import written


def bbox_filter(bounds: tuple[float, float, float, float], column: str | None = "bbox") -> Column:
    """Box overlap, edges included, on a struct column or on four columns; both reach the parquet reader as filters."""
    x0, y0, x1, y1 = bounds
    c = {k: F.col(f"{column}.{k}" if column else k) for k in BOX}
    return (c["xmin"] <= x1) & (c["xmax"] >= x0) & (c["ymin"] <= y1) & (c["ymax"] >= y0)


#: Side of the cells by which boxes, and by which outlines meet.
BOX_CELL, OUTLINE_CELL = 1000.0, 100.0


def _boxes_meet(footprints: DataFrame, areas: DataFrame, cell: float = BOX_CELL, by: Sequence[str] = ("city",)) -> DataFrame:
    """Footprints with _id and sub_aoi_id (where areas have it), a row for each cell and area in which boxes touch."""
    def cells(df: DataFrame, prefix: str) -> DataFrame:
        for axis, c in (("_cx", "x"), ("_cy", "y")):
            df = df.withColumn(axis, F.explode(F.sequence(F.floor(F.col(f"{prefix}{c}min") / cell).cast("long"), F.floor(F.col(f"{prefix}{c}max") / cell).cast("long"))))
        return df

    names = [c for c in ("sub_aoi_id",) if c in areas.columns]
    other = cells(areas.select(*by, *[F.col(k).alias(f"_{k}") for k in BOX], *names), "_")
    met = cells(footprints.withColumn("_id", F.monotonically_increasing_id()), "").join(other, [*by, "_cx", "_cy"])
    return met.where(boxes_touch(box(), {k: F.col(f"_{k}") for k in BOX})).drop("_cx", "_cy", *[f"_{k}" for k in BOX])


def _outlines_meet(footprints: DataFrame, areas: DataFrame, buffer: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(footprints with _id, areas with _area, distinct pairs of them), the first two written so that numbers stay."""
    own = written(footprints.withColumn("_id", F.monotonically_increasing_id()))
    other = written(areas.withColumn("_area", F.monotonically_increasing_id()))
    return own, other, cover.meeting(own, other, OUTLINE_CELL, buffer)


def extract(footprints: DataFrame, areas: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Footprints that touch an area of their city, grown by a round buffer.

    Rows have a box, and may have a ring and holes: then outlines decide, so a
    footprint in a hole or in the corner of an area's box goes.  Areas of one
    city count as one, overlapping or not.  Both sides meet by city and cell.
    """
    if "ring" not in footprints.columns and "ring" not in areas.columns and buffer <= 0:
        return _boxes_meet(footprints, areas.drop("sub_aoi_id")).dropDuplicates(["_id"]).select(*footprints.columns)
    own, _, pairs = _outlines_meet(footprints, areas, buffer)
    return own.join(pairs.select("_id").distinct(), "_id", "left_semi").select(*footprints.columns)


def tag_sub_areas(footprints: DataFrame, sub_areas: DataFrame) -> DataFrame:
    """Footprints with sub_aoi_id, a row for each part that they touch, by outlines as in ``extract``; those in a gap go.

    Columns that an earlier tag or spatial join left go too.
    """
    left = {"index_left", "index_right", "sub_aoi_id"}
    clean = footprints.drop(*[c for c in footprints.columns if c in left or c.startswith("sub_aoi_id_")])
    if "ring" not in clean.columns and "ring" not in sub_areas.columns:
        tagged = _boxes_meet(clean, sub_areas).dropDuplicates(["_id", "sub_aoi_id"])
    else:
        own, other, pairs = _outlines_meet(clean, sub_areas, 0.0)
        names = pairs.join(other.select("_area", "sub_aoi_id"), "_area").select("_id", "sub_aoi_id").distinct()
        tagged = own.join(names, "_id")
    return tagged.select(*clean.columns, "sub_aoi_id")


def load_areas(areas: DataFrame, geographic: bool = True, fix: bool = True, dissolved: bool = False, buffer: float = 0.0) -> DataFrame:
    """Areas (city, ring, perhaps holes and more) in metres, with box and area_m2; rows without a ring of three points go.

    With ``fix`` rings become valid (``dissolve.repair``), so a row can become several or
    none.  ``dissolved`` unites the areas of each city, then only city, ring, holes,
    box and area_m2 are left; so does a ``buffer``, as grown areas overlap.  Degrees
    are grown in spherical Mercator metres and projected to the UTM zone in the
    middle of the city's bounds, so that all parts of a city lie in one plane;
    ``zone`` is then added.
    """
    out = areas.where(F.col("ring").isNotNull() & (F.size("ring") >= 3))
    if fix:
        out = dissolve.repair(out)
    if buffer > 0:
        out = dissolve.buffered(_moved(out, lambda p: web_mercator(p["x"], p["y"])) if geographic else out, buffer)
        out = _moved(out, lambda p: inverse_mercator(p["x"], p["y"])) if geographic else out
    elif dissolved:
        out = dissolve.dissolve(out)
    if geographic:
        b = ring_bounds("ring")
        middle = out.groupBy("city").agg(((F.min(b["xmin"]) + F.max(b["xmax"])) / 2).alias("_m")).select("city", utm_zone("_m").alias("zone"))
        out = _moved(out.join(middle, "city"), lambda p: utm(p["x"], p["y"], "zone"))
    b = ring_bounds("ring")
    return out.withColumns({k: b[k] for k in BOX} | {"area_m2": polygon_area("ring", "holes" if "holes" in out.columns else None)})


def _moved(areas: DataFrame, to: Callable[[Column], Column]) -> DataFrame:
    """Areas with all points of rings and holes mapped."""
    out = areas.withColumn("ring", F.transform("ring", to))
    return out.withColumn("holes", F.transform("holes", lambda h: F.transform(h, to))) if "holes" in out.columns else out


def range_lookup(df: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """df with the columns of the range (lo, hi, both inclusive) that holds the value; ranges are disjoint.

    Ranges are cut into blocks of 1000 values and joined by block, so neither side
    needs to be small.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / 1000), F.floor(F.col("hi") / 1000)))
    cut = ranges.withColumn("_b", blocks)
    return df.withColumn("_b", F.floor(F.col(value) / 1000)).join(cut, "_b").where(F.col(value).between(F.col("lo"), F.col("hi"))).drop("_b", "lo", "hi")


def parse_tracker_tiles(paths: DataFrame, degrees: float = 2.0, pad: float = 0.011) -> DataFrame:
    """Start, end, corner and padded box from names such as WSFtracker_<start>[-_]<end>_<lon>_<lat>.tif; others go."""
    pattern = r"WSFtracker_(\d{8})[-_](\d{8})_(-?\d+)_(-?\d+)\.tif$"
    got = {k: F.regexp_extract("path", pattern, i) for i, k in enumerate(("start", "end", "lon", "lat"), 1)}
    out = paths.where(F.regexp_like("path", F.lit(pattern))).withColumns(got).withColumns({k: F.col(k).cast("int") for k in ("lon", "lat")})
    box = {"xmin": F.col("lon") - pad, "ymin": F.col("lat") - pad, "xmax": F.col("lon") + degrees + pad, "ymax": F.col("lat") + degrees + pad}
    return out.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumns(box)


def touching_tiles(index: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of a tile index (with a box) that touch any area; both meet by cells as large as the largest tile."""
    side = index.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0]
    return _boxes_meet(index, areas.drop("sub_aoi_id"), float(side or 1.0) or 1.0, ()).dropDuplicates(["_id"]).select(*index.columns)


#: Names that a grid's number can have, the first one counts.
GRID_NAMES = ("gridID", "grid_id", "grid_ID", "GRIDID", "GRID_ID", "id", "ID")


def grid_ids(grid: DataFrame, areas: DataFrame, cell: float = 0.25) -> DataFrame:
    """city and grid_id: the distinct cells of a grid of outlines that each city's areas touch, in order.

    The number is the first of GRID_NAMES that the grid has.  ``cell`` is the
    side of the squares by which outlines meet, in their unit (degrees by default).
    """
    name = next((n for n in GRID_NAMES if n in grid.columns), None)
    if name is None:
        raise ValueError(f"a grid needs one of the columns {', '.join(GRID_NAMES)}")
    # the grid belongs to no city, so all meet under one name and by cell
    holes = [c for c in ("holes",) if c in grid.columns]
    own = written(grid.select(F.lit("").alias("city"), F.col(name).alias("grid_id"), "ring", *holes).withColumn("_id", F.monotonically_increasing_id()))
    other = written(areas.withColumnsRenamed({"city": "_city"}).withColumns({"city": F.lit(""), "_area": F.monotonically_increasing_id()}))
    found = cover.meeting(own, other, cell).join(own.select("_id", "grid_id"), "_id").join(other.select("_area", F.col("_city").alias("city")), "_area")
    return found.select("city", "grid_id").distinct().sort("city", "grid_id")


def split_bounds(bounds: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes cut into tiles of at most width by height; the last ones are cut at the edge."""
    for axis, lo, hi, s in (("i", "xmin", "xmax", width), ("j", "ymin", "ymax", height)):
        n = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / s)).cast("int")
        bounds = bounds.withColumn(axis, F.explode(F.sequence(F.lit(0), n - 1)))
    x0, y0 = F.col("xmin") + F.col("i") * width, F.col("ymin") + F.col("j") * height
    return bounds.withColumns({"x0": x0, "y0": y0, "x1": F.least(x0 + width, F.col("xmax")), "y1": F.least(y0 + height, F.col("ymax"))})


def select_files(files: DataFrame, by: Sequence[str], priorities: Sequence[str]) -> DataFrame:
    """Of each group the files that fit the first pattern that any file of the group fits."""
    rank = F.lit(None).cast("int")
    for k in reversed(range(len(priorities))):
        rank = F.when(F.regexp_like("name", F.lit(priorities[k])), k).otherwise(rank)
    ranked = files.withColumn("_k", rank).where("_k is not null")
    return ranked.withColumn("_m", F.min("_k").over(Window.partitionBy(*by))).where("_k = _m").drop("_k", "_m")


def first_file(files: DataFrame, by: Sequence[str], pattern: str) -> DataFrame:
    """The first name in order of each group's names that fit a pattern."""
    return files.where(F.regexp_like("name", F.lit(pattern))).groupBy(*by).agg(F.min("name").alias("name"))


def work_list(products: DataFrame, years: Sequence[int]) -> DataFrame:
    """Every product in every year, and its label."""
    out = products.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return out.withColumn("label", F.concat_ws("_", "product", "year"))
