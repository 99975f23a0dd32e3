"""Rasters brought from one plane to another.

A raster is a table of cells (city, dataset, col, row, value) on a ``Grid``.  Each
centre of the target grid is mapped back to the source grid, and meets the
cells there by an equi-join on city, column and row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions import geometry
from gridproof.operators.raster import CATEGORICAL


@dataclass(frozen=True)
class Grid:
    """Cells of ``dx`` by ``dy`` from the corner (x, y) on, in degrees (``lonlat``), spherical ``mercator`` metres or metres of a ``utm`` zone; a negative dy counts rows downwards."""

    x: float
    y: float
    dx: float
    dy: float
    plane: str = "lonlat"
    zone: int = 0
    south: bool = False

    def __post_init__(self):
        if self.plane not in ("lonlat", "mercator", "utm") or self.plane == "utm" and not 1 <= self.zone <= 60 or not self.dx or not self.dy:
            raise ValueError(f"no such grid: {self}")

    def degrees(self, x: Column, y: Column) -> Column:
        """Struct (x, y) of longitude and latitude of a place in the plane."""
        if self.plane == "utm":
            return geometry.inverse_utm(x, y, F.lit(self.zone), self.south)
        return geometry.inverse_mercator(x, y) if self.plane == "mercator" else F.struct(x.alias("x"), y.alias("y"))

    def place(self, p: Column) -> Column:
        """Struct (x, y) in the plane of degrees."""
        if self.plane == "utm":
            at = geometry.utm(p["x"], p["y"], F.lit(self.zone))
            # a zone's northing is its own, whichever side of the equator the place is on
            return F.struct(at["x"].alias("x"), (at["y"] - F.when(p["y"] < 0, 10000000.0).otherwise(0.0) + (10000000.0 if self.south else 0.0)).alias("y"))
        return geometry.web_mercator(p["x"], p["y"]) if self.plane == "mercator" else p

    def corner(self, col: Column, row: Column) -> Column:
        return F.struct((self.x + col * self.dx).alias("x"), (self.y + row * self.dy).alias("y"))


def resampling(spec: Mapping) -> str:
    """Codes take the nearest cell, shares and areas the bilinear value."""
    return "nearest" if spec.get("method", "fraction") in CATEGORICAL else "bilinear"


def warped_cells(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """city, dataset, gx, gy: target cells of the bounds of all source cells' corners after projection."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = source.corner(F.col("col") + F.col("_c.i"), F.col("row") + F.col("_c.j"))
    p = cells.withColumn("_c", corners).withColumn("_p", target.place(source.degrees(at["x"], at["y"])))
    u, v = (F.col("_p.x") - target.x) / target.dx, (F.col("_p.y") - target.y) / target.dy
    bounds = p.groupBy("city", "dataset").agg(F.floor(F.min(u)).alias("a"), F.ceil(F.max(u)).alias("b"), F.floor(F.min(v)).alias("c"), F.ceil(F.max(v)).alias("d"))
    rows = bounds.withColumn("gy", F.explode(F.sequence("c", F.col("d") - 1)))
    # rows are dealt out first, so that no task makes all cells of a city
    return rows.repartition("city", "dataset", "gy").select("city", "dataset", F.explode(F.sequence("a", F.col("b") - 1)).alias("gx"), "gy")


def warp(cells: DataFrame, source: Grid, targets: DataFrame, target: Grid, method: str = "nearest") -> DataFrame:
    """targets (city, dataset, gx, gy) with the value of the source cell around each centre, or between the four nearest centres.

    Bilinear weights of missing cells go to the others; a centre with no cell at all,
    or for ``nearest`` in no cell or a missing one, has NULL.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"no such resampling: {method}")
    keys = ["city", "dataset", "gx", "gy"]
    centre = target.corner(F.col("gx") + 0.5, F.col("gy") + 0.5)
    at = targets.select(*keys).withColumn("_p", source.place(target.degrees(centre["x"], centre["y"])))
    at = at.select(*keys, ((F.col("_p.x") - source.x) / source.dx).alias("_u"), ((F.col("_p.y") - source.y) / source.dy).alias("_v"))
    own = cells.where("value is not null and not isnan(value)").select("city", "dataset", "col", "row", "value")
    if method == "nearest":
        at = at.select(*keys, F.floor("_u").cast("long").alias("col"), F.floor("_v").cast("long").alias("row"))
        return at.join(own, ["city", "dataset", "col", "row"], "left").select(*keys, "value")
    at = at.withColumns({"_u": F.col("_u") - 0.5, "_v": F.col("_v") - 0.5})
    corner = F.explode(F.array(*[F.struct((F.floor("_u") + i).cast("long").alias("col"), (F.floor("_v") + j).cast("long").alias("row")) for i in (0, 1) for j in (0, 1)]))
    near = at.withColumn("_c", corner).select(*keys, "_c.*", ((1 - F.abs(F.col("_u") - F.col("_c.col"))) * (1 - F.abs(F.col("_v") - F.col("_c.row")))).alias("_w"))
    met = near.join(own, ["city", "dataset", "col", "row"], "left").where("_w > 0 or value is null")
    return met.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_w") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))).alias("value"))
