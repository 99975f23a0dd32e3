"""Map algebra on pixel tables.

A pixel table has a row for each cell: its keys (city, dataset), the lower left
corner (x, y), and a value; NULL is no data.  Cells are square and lie on
multiples of their resolution, so a cell of one grid meets those of another by
arithmetic on its corner, never by a product of tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.exprs import col, mean_dropping_missing, precision_recall_f1, ratio
from gridproof.functions.geometry import overlap_length
from gridproof.operators import cover
from gridproof.operators.tiling import assign_tiles
from gridproof.sources.scratch import written

CATEGORICAL = ("wsf_tracker", "binary", "nonzero", "value_in")


def predicted_area(value, pixel_area: float, spec: Mapping) -> Column:
    """Built area of a cell by the spec's method: fraction, percent, area_m2, binary, nonzero, value_in, wsf_tracker."""
    v, px = col(value).cast("double"), float(pixel_area)
    method = spec.get("method", "fraction")

    def clamped(most: float) -> Column:
        return F.least(F.lit(float(spec.get("clamp_max", most))), F.greatest(F.lit(float(spec.get("clamp_min", 0.0))), v))

    if method == "fraction":
        return F.when(v.isNotNull(), clamped(1.0) * px)
    if method == "percent":
        return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), clamped(100.0) / 100)) * px)
    if method == "area_m2":
        area = F.when(v.isNotNull(), F.greatest(F.lit(0.0), v))
        return F.least(area, F.when(v.isNotNull(), F.lit(px))) if spec.get("clamp_to_pixel_area", True) else area
    if method == "binary":
        built = v >= float(spec.get("threshold", 1.0))
    elif method == "nonzero":
        built = v != 0
    elif method == "value_in":
        built = v.isin(*[float(x) for x in spec.get("values", ())]) if spec.get("values") else F.lit(False)
    elif method == "wsf_tracker":
        built = (v != float(spec.get("nonbuilt_value", 0))) & (v >= float(spec.get("built_value_min", 1))) & (v <= float(spec.get("as_of_code", 19)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(v.isNotNull(), built.cast("double") * px)


def predicted_bin(area: Column, pixel_area: float, spec: Mapping, tau: float) -> Column:
    """Whether a cell counts as built: at a share of the cell, or for codes at any area."""
    share = spec.get("threshold_frac")
    if spec.get("method", "fraction") in CATEGORICAL and share is None:
        return area > 0
    return area / float(pixel_area) >= float(tau if share is None else share)


def native_cells(pixels: DataFrame, resolution: float, spec: Mapping, min_area: float) -> DataFrame:
    """pixels with valid, area and built at native resolution; built is false where invalid.

    A nodata value fills missing cells.  For codes it makes a cell invalid; for
    shares and areas it is a value like any other, so filled cells count as valid.
    """
    px = float(resolution) ** 2
    nodata, method = spec.get("nodata"), spec.get("method", "fraction")
    if nodata is not None:
        pixels = pixels.withColumn("value", F.coalesce("value", F.lit(float(nodata))))
    valid = F.col("value").isNotNull() & ~F.isnan(F.col("value"))
    if nodata is not None and method not in ("fraction", "percent", "area_m2"):
        valid = valid & (F.col("value") != float(nodata))
    area = predicted_area("value", px, spec)
    return pixels.withColumn("valid", valid).withColumn("area", F.when(F.col("valid"), area)).withColumn("built", F.coalesce(F.col("valid") & predicted_bin(F.col("area"), px, spec, min(1.0, min_area / px)), F.lit(False)))


def overlaps(cells: DataFrame, native: float, target: float) -> DataFrame:
    """cells with gx, gy (target cell numbers) and w (shared area): one row for each target cell they share area with."""
    for axis, c in (("gx", "x"), ("gy", "y")):
        first, last = F.floor(F.col(c) / target), F.ceil((F.col(c) + native) / target) - 1
        cells = cells.withColumn(axis, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    wide = overlap_length(F.col("x"), F.col("x") + native, F.col("gx") * target, (F.col("gx") + 1) * target)
    high = overlap_length(F.col("y"), F.col("y") + native, F.col("gy") * target, (F.col("gy") + 1) * target)
    return cells.withColumn("w", wide * high)


def regrid(cells: DataFrame, native: float, target: float, keys: Sequence[str] = ("city", "dataset")) -> DataFrame:
    """Target cells: share of built and regridded area, both from valid native cells only, and nearest validity.

    A partly covered target cell takes the mean of what covers it.
    """
    shared = overlaps(cells, native, target)
    w = F.when(F.col("valid"), F.col("w"))
    near = (F.floor((F.col("gx") + 0.5) * target / native) * native == F.col("x")) & (F.floor((F.col("gy") + 0.5) * target / native) * native == F.col("y"))
    return shared.groupBy(*keys, "gx", "gy").agg(
        F.try_divide(F.sum(w * F.col("built").cast("double")), F.sum(w)).alias("built_share"),
        (F.try_divide(F.sum(w * F.col("area")), F.sum(w)) * (target / native) ** 2).alias("pred_area"),
        F.coalesce(F.bool_or(near & F.col("valid")), F.lit(False)).alias("valid"),
    )


def reference_fraction(refs: DataFrame, resolution: float, oversample: int = 4, all_touched: bool = False) -> DataFrame:
    """Share of each cell's sub-cells whose centre lies in a box: city, gx, gy, ref_share.  Overlapping boxes count once.

    A box has a row in each cell that it covers a sub-cell of, with one mask of
    the covered sub-cells for each row of them; masks meet by bit_or, so nothing
    is kept for single sub-cells.  ``all_touched`` takes every sub-cell that a
    box shares area with.  Where refs have a ``ring`` (and ``holes``) it decides:
    by runs of sub-cells in each row of them, and with ``all_touched`` also by those
    that an edge touches.
    """
    s = resolution / oversample
    none = F.lit(0).cast("long")

    def bits(first: Column, last: Column) -> Column:
        """Mask of the sub-cells first to last of a cell."""
        return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), (last - first + 1).cast("int")) - 1, first.cast("int"))

    if "ring" in refs.columns:
        # numbers stay, as runs need all edges of a ring
        edges = cover.edges_of(written(refs.withColumn("_o", F.monotonically_increasing_id())), ["city", "_o"])
        rows = cover.inside_runs(edges, ["city", "_o"], s).select("city", "cy", "c0", (F.col("c1") - 1).alias("c1"))
        if all_touched:
            rows = rows.unionByName(cover.edge_cells(edges, ["city"], s).select("city", "cy", F.col("cx").alias("c0"), F.col("cx").alias("c1")))
        rows = rows.withColumn("gx", F.explode(F.sequence(F.floor(F.col("c0") / oversample), F.floor(F.col("c1") / oversample))))
        low, high = F.greatest(F.lit(0), F.col("c0") - F.col("gx") * oversample), F.least(F.lit(oversample - 1), F.col("c1") - F.col("gx") * oversample)
        rows = rows.select("city", "gx", F.floor(F.col("cy") / oversample).alias("gy"), F.pmod("cy", F.lit(oversample)).alias("_k"), bits(low, high).alias("_m"))
        masks = {f"m{k}": F.bit_or(F.when(F.col("_k") == k, F.col("_m")).otherwise(none)) for k in range(oversample)}
    else:
        for axis, lo, hi in (("gx", "xmin", "xmax"), ("gy", "ymin", "ymax")):
            first, last = (F.floor(F.col(lo) / s), F.ceil(F.col(hi) / s) - 1) if all_touched else (F.ceil(F.col(lo) / s - 0.5), F.ceil(F.col(hi) / s - 0.5) - 1)
            cells = F.when(first <= last, F.sequence(F.floor(first / oversample), F.floor(last / oversample)))
            refs = refs.withColumn(axis, F.explode(cells)).withColumns({f"_{axis}0": F.greatest(F.lit(0), first - F.col(axis) * oversample), f"_{axis}1": F.least(F.lit(oversample - 1), last - F.col(axis) * oversample)})
        rows = refs
        masks = {f"m{k}": F.bit_or(F.when(F.lit(k).between(F.col("_gy0"), F.col("_gy1")), bits(F.col("_gx0"), F.col("_gx1"))).otherwise(none)) for k in range(oversample)}
    cells = rows.groupBy("city", "gx", "gy").agg(*[m.alias(k) for k, m in masks.items()])
    count = sum((F.bit_count(k) for k in masks), F.lit(0))
    return cells.select("city", "gx", "gy", (count / float(oversample**2)).alias("ref_share"))


def tile_cells(tiles: DataFrame, resolution: float, areas: DataFrame | None = None, all_touched: bool = False) -> DataFrame:
    """Cells of a resolution by their centre's tile: each is in one tile at most, so totals don't count twice.

    With ``areas`` (city, and a ring, perhaps holes, or a box) there is in_area: the
    centre lies in an area of the city, or with ``all_touched`` the cell shares a
    point with one.
    """
    for axis, lo, hi in (("gx", "x0", "x1"), ("gy", "y0", "y1")):
        first, last = F.ceil(F.col(lo) / resolution - 0.5), F.ceil(F.col(hi) / resolution - 0.5) - 1
        tiles = tiles.withColumn(axis, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    cells = tiles.select("city", "tile_id", "gx", "gy")
    if areas is None:
        return cells
    inside = cover.covered_cells(areas, ["city"], resolution, all_touched).select("city", F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.lit(True).alias("_in"))
    return cells.join(inside, ["city", "gx", "gy"], "left").select("city", "tile_id", "gx", "gy", F.coalesce("_in", F.lit(False)).alias("in_area"))


def clip_to_areas(cells: DataFrame, areas: DataFrame, resolution: float, all_touched: bool = False) -> DataFrame:
    """Native cells, with a NULL value outside the areas of their city: where the centre isn't in one, or with ``all_touched`` the cell shares no point with one.

    Areas have a ring, perhaps holes, or a box.  x and y, the lower left corners, may be off the multiples of the resolution: then
    a cell is taken to be the one that holds its centre.
    """
    inside = cover.covered_cells(areas, ["city"], resolution, all_touched).select("city", F.col("cx").alias("_gx"), F.col("cy").alias("_gy"), F.lit(True).alias("_in"))
    at = {f"_g{c}": F.floor((F.col(c) + resolution / 2) / resolution).cast("long") for c in "xy"}
    # a few outlines may hold very many cells, which no estimate from the outlines' size foresees, so the driver must not gather them
    out = cells.withColumns(at).join(inside.hint("merge"), ["city", "_gx", "_gy"], "left")
    return out.withColumn("value", F.when(F.col("_in"), F.col("value"))).select(*cells.columns)


def mosaic(parts: Sequence[DataFrame], keys: Sequence[str] = ("city", "dataset", "x", "y")) -> DataFrame:
    """Cells of several rasters; where they overlap the first with a value counts."""
    every = None
    for k, part in enumerate(parts):
        part = part.withColumn("_k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    value = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("_k")))
    return every.groupBy(*keys).agg(value.alias("value"))


def guard(grids: DataFrame, datasets: DataFrame, tolerance: float = 0.75, mode: str = "skip_finer", enabled: bool = True) -> DataFrame:
    """Pairs of dataset and grid (name, resolution_m) that may be evaluated, with ``blocked``.

    A grid finer than tolerance times the native resolution is blocked unless the
    dataset allows it or has no known resolution.  skip_finer drops blocked pairs,
    warn_only keeps them, error raises.
    """
    finer = F.col("resolution_m") < F.col("native_resolution_m") * tolerance
    allowed = F.coalesce(F.col("allow_finer_than_native"), F.lit(False)) if "allow_finer_than_native" in datasets.columns else F.lit(False)
    pairs = datasets.crossJoin(F.broadcast(grids)).withColumn("blocked", F.coalesce(finer & ~allowed & F.lit(enabled), F.lit(False)))
    if mode == "warn_only":
        return pairs
    if mode == "skip_finer":
        return pairs.where(~F.col("blocked"))
    if mode == "error":
        if not pairs.where("blocked").isEmpty():
            raise ValueError("a grid is finer than the native resolution")
        return pairs
    raise ValueError(f"unknown mode {mode!r}")


def tile_metrics(tiles: DataFrame, refs: DataFrame, native: DataFrame, native_resolution: float, resolution: float, grid: str, ref_min_area: float = 20.0, oversample: int = 4, tile_size: float = 1000.0, areas: DataFrame | None = None, all_touched: bool = False) -> DataFrame:
    """Confusion and area metrics of each dataset and tile at one grid.

    ``native`` comes from ``native_cells``.  Undefined P, R and errors are NULL, and
    so is F1 where P + R = 0.  A tile without a valid cell has zeros and NULLs.
    With ``areas`` only cells in an area of the city are valid, as in ``tile_cells``.
    """
    fraction = reference_fraction(refs, resolution, oversample, all_touched)
    return metrics_of_cells(tile_cells(tiles, resolution, areas, all_touched), fraction, built_counts(refs, tiles, tile_size), native, native_resolution, resolution, grid, ref_min_area)


def built_counts(refs: DataFrame, tiles: DataFrame, tile_size: float) -> DataFrame:
    """Number and mean area of the references of each tile."""
    return assign_tiles(refs, tiles, tile_size).groupBy("city", "tile_id").agg(F.count("*").alias("ref_building_count"), F.avg("area_m2").alias("mean_ref_building_area_m2"))


def metrics_of_cells(cells: DataFrame, fraction: DataFrame, built: DataFrame, native: DataFrame, native_resolution: float, resolution: float, grid: str, ref_min_area: float = 20.0) -> DataFrame:
    """``tile_metrics`` from what all products of a grid share: ``tile_cells``, ``reference_fraction`` and ``built_counts``."""
    px = float(resolution) ** 2
    tau = min(1.0, ref_min_area / px)
    masked = "in_area" in cells.columns
    cells = cells.join(native.select("city", "dataset").distinct(), "city")
    cells = cells.join(regrid(native, native_resolution, resolution), ["city", "dataset", "gx", "gy"], "left").join(fraction, ["city", "gx", "gy"], "left")
    valid, share = F.coalesce("valid", F.lit(False)), F.coalesce("ref_share", F.lit(0.0))
    if masked:
        valid = valid & F.col("in_area")
    ref, pred = share >= tau, F.coalesce(F.col("built_share") >= tau, F.lit(False))

    def count(*on: Column) -> Column:
        test = valid
        for c in on:
            test = test & c
        return F.count_if(test)

    per = cells.groupBy("city", "dataset", "tile_id").agg(
        F.count("*").alias("n_pixels"), count().alias("n_valid"), count(ref, pred).alias("tp"), count(~ref, pred).alias("fp"), count(ref, ~pred).alias("fn"), count(~ref, ~pred).alias("tn"),
        F.sum(F.when(valid, share * px)).alias("ref_area_m2"), F.sum(F.when(valid, F.coalesce("pred_area", F.lit(0.0)))).alias("pred_area_m2"),
    )
    out = per.join(built, ["city", "tile_id"], "left")
    none = F.col("n_valid") == 0
    p, r, f1 = precision_recall_f1("tp", "fp", "fn", None)
    area_error = ratio(F.col("pred_area_m2") - F.col("ref_area_m2"), "ref_area_m2")
    n_ref = F.coalesce("ref_building_count", F.lit(0))
    n_pred = F.when(F.col("mean_ref_building_area_m2") > 0, F.col("pred_area_m2") / F.col("mean_ref_building_area_m2"))
    qd, ad = disagreement("tp", "fp", "fn", "tn")

    def known(c: Column) -> Column:
        return F.when(~none, c)

    return out.select(
        "city", "dataset", "tile_id", F.lit(grid).alias("grid"), F.lit(float(resolution)).alias("resolution_m"), F.lit(px).alias("pixel_area_m2"), F.when(none, 0).otherwise(F.col("n_pixels")).cast("long").alias("n_pixels"),
        "n_valid", (F.col("n_valid") * px).alias("valid_area_m2"), "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        F.coalesce("ref_area_m2", F.lit(0.0)).alias("ref_area_m2"), F.coalesce("pred_area_m2", F.lit(0.0)).alias("pred_area_m2"), known(n_ref).alias("ref_building_count"), known(F.col("mean_ref_building_area_m2")).alias("mean_ref_building_area_m2"),
        known(n_pred).alias("pred_building_count"), known(n_pred - n_ref).alias("delta_building_count"), known(ratio(n_pred - n_ref, n_ref)).alias("rel_delta_building_count"),
        known(area_error).alias("rel_area_error"), known(area_error).alias("signed_area_bias"), qd.alias("quantity_disagreement"), ad.alias("allocation_disagreement"), known(F.lit(float(native_resolution))).alias("native_resolution_m"),
    )


def disagreement(tp, fp, fn, tn) -> tuple[Column, Column]:
    """Quantity |fp - fn| / n and allocation 2 min(fp, fn) / n; NULL for no cells."""
    tp, fp, fn, tn = map(col, (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    return ratio(F.abs(fp - fn), n), ratio(2 * F.least(fp, fn), n)


MEANS = ("precision", "recall", "f1", "rel_area_error", "signed_area_bias", "quantity_disagreement", "allocation_disagreement")


def city_summary(tiles: DataFrame, cities: DataFrame) -> DataFrame:
    """Summary of each dataset and grid; cities has n_ref_buildings, aoi_area_km2, avg_building_size_m2.

    Micro shares come from summed areas, 0 where undefined; macro means leave NULL tiles out.
    """
    px = F.col("pixel_area_m2")
    out = tiles.groupBy("city", "dataset", "grid", "resolution_m").agg(
        F.countDistinct("tile_id").alias("n_tiles"),
        *[F.sum(a).alias(b) for a, b in (("valid_area_m2", "valid_area_total_m2"), ("ref_area_m2", "ref_area_total_m2"), ("pred_area_m2", "pred_area_total_m2"))],
        *[F.sum(c).alias(f"{c}_total") for c in ("tp", "fp", "fn")],
        *[F.sum(F.col(c) * px).alias(f"{c}_m2") for c in ("tp", "fp", "fn")],
        F.avg("f1").alias("f1_tile_mean"), F.median("f1").alias("f1_tile_median"), F.avg("rel_area_error").alias("rel_area_error_mean"), F.median("rel_area_error").alias("rel_area_error_median"),
        F.avg("quantity_disagreement").alias("quantity_disagreement_mean"), F.avg("allocation_disagreement").alias("allocation_disagreement_mean"),
        *[mean_dropping_missing(c, "valid_area_m2").alias(f"{c}_weighted_mean") for c in MEANS],
    ).join(cities, "city", "left")
    p, r, f1 = precision_recall_f1("tp_m2", "fp_m2", "fn_m2", 0.0)
    n_pred = F.when(F.col("avg_building_size_m2") > 0, F.col("pred_area_total_m2") / F.col("avg_building_size_m2"))
    delta = n_pred - F.col("n_ref_buildings")
    return out.select(
        "city", "dataset", "grid", "resolution_m", "n_ref_buildings", "aoi_area_km2", ratio("n_ref_buildings", "aoi_area_km2").alias("buildings_per_km2"), "avg_building_size_m2",
        F.col("n_ref_buildings").alias("ref_building_count"), n_pred.alias("pred_building_count"), delta.alias("delta_building_count"), ratio(delta, "n_ref_buildings").alias("rel_delta_building_count"),
        "n_tiles", "valid_area_total_m2", "ref_area_total_m2", "pred_area_total_m2", "tp_total", "fp_total", "fn_total", p.alias("precision_area"), r.alias("recall_area"), f1.alias("f1_area"),
        "f1_tile_mean", "f1_tile_median", "rel_area_error_mean", "rel_area_error_median", ratio(F.col("pred_area_total_m2") - F.col("ref_area_total_m2"), "ref_area_total_m2").alias("signed_area_bias"),
        "quantity_disagreement_mean", "allocation_disagreement_mean", *[f"{c}_weighted_mean" for c in MEANS],
    )


def bilinear(cells: DataFrame, points: DataFrame, resolution: float) -> DataFrame:
    """points (city, dataset, px, py) with the value between the four nearest cell centres; missing ones drop out and weights are scaled up."""
    u, v = F.col("px") / resolution - 0.5, F.col("py") / resolution - 0.5
    at = points.withColumns({"_u": u, "_v": v}).withColumn("_d", F.explode(F.expr("array(struct(0 as i, 0 as j), struct(1 as i, 0 as j), struct(0 as i, 1 as j), struct(1 as i, 1 as j))")))
    gx, gy = F.floor("_u") + F.col("_d.i"), F.floor("_v") + F.col("_d.j")
    at = at.withColumns({"x": gx * resolution, "y": gy * resolution, "_w": (1 - F.abs(F.col("_u") - gx)) * (1 - F.abs(F.col("_v") - gy))}).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    met = at.join(cells.where("value is not null").select("city", "dataset", "x", "y", "value"), ["city", "dataset", "x", "y"], "left")
    return met.groupBy("city", "dataset", "px", "py").agg(F.try_divide(F.sum(F.col("_w") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))).alias("value"))


