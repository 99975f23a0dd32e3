"""Cells of outlines: rows of cells inside, cells on the edge, and which footprints meet which outline.

Everything is a column expression.  An outline is turned into two tables: runs of
cells whose centre lies inside, from its crossings with the middle of each row of
cells, and the cells that its edges touch, with these edges.  Work follows the
length of the outline, not the number of cells times the number of edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridproof.functions.geometry import box, box_ring, edges_meet, edges_near, point_in_edges, polygon_edges
from gridproof.sources.scratch import written

#: Levels of runs: cells, and rows of 8, 64, ... cells.
FAN, LEVELS = 8, 6


def outline(df: DataFrame) -> Column:
    """Edges of a row's polygon: its ring and holes where it has them, else its box."""
    return polygon_edges("ring", "holes" if "holes" in df.columns else None) if "ring" in df.columns else polygon_edges(box_ring(box()))


def edges_of(outlines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and e, a struct (p, q), for each edge; rows without three points have none."""
    rows = outlines.where(F.col("ring").isNotNull() & (F.size("ring") >= 3)) if "ring" in outlines.columns else outlines
    return rows.select(*keys, F.explode(outline(rows)).alias("e"))


def _centre(cell: Column, size: float) -> Column:
    """The double nearest to a cell's centre, from the decimal digits of the size: (cell + 0.5) * 1.4142 in doubles is one step off for many cells."""
    n, d = (Fraction(str(float(size))) / 2).as_integer_ratio()
    return (2.0 * cell + 1.0) * float(n) / float(d)


def _first(value: Column, size: float, beyond: bool = False) -> Column:
    """The first cell whose centre is at a value or beyond it, or only ``beyond`` it; centres decide, as a quotient is off where one is at the value."""
    near = F.ceil(value / size - 0.5).cast("long")

    def reached(cell: Column) -> Column:
        return _centre(cell, size) > value if beyond else _centre(cell, size) >= value

    return F.when(reached(near - 1), near - 1).when(reached(near), near).otherwise(near + 1)


def inside_runs(edges: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """keys, cy, c0, c1: in row cy the centres of cells c0 to c1 - 1 lie inside by the even-odd rule.

    Lower and left edges are inside, upper and right ones aren't, as in ``point_in_edges``.
    """
    p, q = F.col("e.p"), F.col("e.q")
    low, high = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
    rows = edges.withColumns({"_a": _first(low, size), "_b": _first(high, size) - 1}).where("_a <= _b").withColumn("cy", F.explode(F.sequence("_a", "_b")))
    y = _centre(F.col("cy"), size)
    at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
    met = rows.groupBy(*keys, "cy").agg(F.sort_array(F.collect_list(_first(at, size))).alias("_c"))
    pair = F.transform(F.sequence(F.lit(0), F.size("_c") - 2, F.lit(2)), lambda k: F.struct(F.get("_c", k).alias("c0"), F.get("_c", k + 1).alias("c1")))
    return met.where(F.size("_c") >= 2).select(*keys, "cy", F.explode(pair).alias("_r")).select(*keys, "cy", "_r.*").where("c0 < c1")


def edge_cells(edges: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """keys, cx, cy, e: each edge with every cell that it shares a point with, sides and corners included."""
    p, q = F.col("e.p"), F.col("e.q")
    slack = 1e-9 * (F.abs(p["x"]) + F.abs(q["x"]) + size)

    def span(lo: Column, hi: Column) -> Column:
        return F.sequence((F.ceil(lo / size) - 1).cast("long"), F.floor(hi / size).cast("long"))

    low, high = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
    rows = edges.withColumn("cy", F.explode(span(low, high)))
    cut = [F.greatest(low, F.col("cy") * size), F.least(high, (F.col("cy") + 1) * size)]
    at = [F.when(p["y"] == q["y"], v).otherwise(p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(p["y"] == q["y"], 1.0).otherwise(q["y"] - p["y"])) for y, v in zip(cut, (p["x"], q["x"]), strict=True)]
    cells = rows.withColumn("cx", F.explode(span(F.least(*at) - slack, F.greatest(*at) + slack)))
    x, y = F.col("cx") * size, F.col("cy") * size
    side = [(q["x"] - p["x"]) * (b - p["y"]) - (q["y"] - p["y"]) * (a - p["x"]) for a in (x, x + size) for b in (y, y + size)]
    touches = (F.least(*side) <= 0) & (F.greatest(*side) >= 0) & (F.least(p["x"], q["x"]) <= x + size) & (F.greatest(p["x"], q["x"]) >= x)
    return cells.where(touches).select(*keys, "cx", "cy", "e")


def covered_cells(outlines: DataFrame, keys: Sequence[str], size: float, all_touched: bool = False) -> DataFrame:
    """keys, cx, cy: cells whose centre lies in a polygon of the keys, or with ``all_touched`` all that share a point with one, each once."""
    own = outlines.withColumn("_o", F.monotonically_increasing_id())
    edges = edges_of(written(own), [*keys, "_o"])
    runs = inside_runs(edges, [*keys, "_o"], size)
    cells = runs.select(*keys, F.explode(F.sequence("c0", F.col("c1") - 1)).alias("cx"), "cy")
    if all_touched:
        cells = cells.unionByName(edge_cells(edges, keys, size).drop("e"))
    return cells.distinct()


def interior_cells(outlines: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """keys, cx, cy: cells whose centre lies in the interior of a polygon's ring and not in that of its holes, each once.

    Edges belong to no interior, on any side: a centre on the ring is outside, one on the edge of a hole isn't in the hole.
    """
    own, of = written(outlines.withColumn("_o", F.monotonically_increasing_id())), [*keys, "_o"]
    edges = edges_of(own.drop("holes"), of).withColumn("_hole", F.lit(False))
    if "ring" in own.columns and "holes" in own.columns:
        edges = edges.unionByName(edges_of(own.select(*of, F.explode("holes").alias("ring")), of).withColumn("_hole", F.lit(True)))
    p, q = F.col("e.p"), F.col("e.q")
    low, high, level = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]), p["y"] == q["y"]
    rows = edges.withColumns({"_a": _first(low, size), "_b": _first(high, size, True) - 1}).where("_a <= _b").withColumn("cy", F.explode(F.sequence("_a", "_b")))
    y, none = _centre(F.col("cy"), size), F.array().cast("array<bigint>")
    at = F.when(y == p["y"], p["x"]).when(y == q["y"], q["x"]).otherwise(p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(level, 1.0).otherwise(q["y"] - p["y"]))
    ends = (F.when(level, f(p["x"], q["x"])).otherwise(at) for f in (F.least, F.greatest))
    # cells first to last - 1 have their centre on the edge; an edge along the row, or that ends in it from below, isn't crossed
    rows = rows.select(*of, "cy", "_hole", (y < high).alias("_met"), *[_first(x, size, k == "_last").alias(k) for k, x in zip(("_first", "_last"), ends, strict=True)])
    crossed, on = F.when(F.col("_met"), F.col("_first")), F.when(F.col("_first") < F.col("_last"), F.sequence("_first", F.col("_last") - 1))
    lists = [f(F.collect_list(F.when(side, x))).alias(f"{name}{k}") for k, side in enumerate((~F.col("_hole"), F.col("_hole"))) for name, f, x in (("_c", F.sort_array, crossed), ("_on", F.flatten, on))]
    met = rows.groupBy(*of, "cy").agg(*lists).where(F.size("_c0") >= 2)

    def less(cells: Column, others: Column) -> Column:
        return F.when(F.size(others) == 0, cells).otherwise(F.array_except(cells, others))

    def within(c: str, on: str) -> Column:
        """Cells between crossings, without those on an edge."""
        runs = F.transform(F.sequence(F.lit(0), F.size(c) - 2, F.lit(2)), lambda k: F.when(F.get(c, k) < F.get(c, k + 1), F.sequence(F.get(c, k), F.get(c, k + 1) - 1)).otherwise(none))
        return F.when(F.size(c) >= 2, less(F.flatten(runs), F.col(on))).otherwise(none)

    met = met.select(*keys, "cy", within("_c0", "_on0").alias("_in"), within("_c1", "_on1").alias("_out"))
    return met.select(*keys, F.explode(less(F.col("_in"), F.col("_out"))).alias("cx"), "cy").distinct()


def _blocks(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, level, c, cy: runs as blocks of FAN ** level cells, each as large as fits."""
    lo, hi, parts = F.col("c0"), F.col("c1"), []

    def block(level: int, a: Column, b: Column) -> Column:
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda c: F.struct(F.lit(level).alias("level"), c.alias("c")))).otherwise(F.array().cast("array<struct<level:int,c:bigint>>"))

    for level in range(LEVELS - 1):
        runs = runs.withColumns({f"_lo{level}": lo, f"_hi{level}": hi})
        lo, hi = F.col(f"_lo{level}"), F.col(f"_hi{level}")
        up, down = F.ceil(lo / FAN).cast("long"), F.floor(hi / FAN).cast("long")
        deeper = up < down
        parts += [block(level, lo, F.when(deeper, up * FAN).otherwise(hi)), block(level, F.when(deeper, down * FAN).otherwise(hi), hi)]
        lo, hi = F.when(deeper, up), F.when(deeper, down)
    parts.append(block(LEVELS - 1, lo, hi))
    return runs.select(*keys, "cy", F.explode(F.concat(*parts)).alias("_b")).select(*keys, "_b.level", "_b.c", "cy")


def meeting(footprints: DataFrame, areas: DataFrame, size: float = 100.0, distance: float = 0.0) -> DataFrame:
    """Distinct (_id, _area) of footprints that share a point with an area of their city, or come within a distance of it.

    footprints have _id, areas have _area; both have city and a ring (and holes)
    or a box, and all are closed.  Joins go by city and cell.  A footprint's first
    point asks for the runs of cells around it, of any length, and for the edges in
    its own cell.  Its outline is held against the edges in the cells of its box alone.
    """
    keys = ["city", "_area"]
    edges = edges_of(areas, keys)
    # an area's first point stands for it where a footprint lies around it
    first = areas.withColumn("_e", F.get(outline(areas), F.lit(0))).select(*keys, F.col("_e.p").alias("_start"))
    first = first.where("_start is not null").select(*keys, F.floor(F.col("_start.x") / size).cast("long").alias("cx"), F.floor(F.col("_start.y") / size).cast("long").alias("cy"), "_start")
    cells = edge_cells(edges, keys, size).groupBy(*keys, "cx", "cy").agg(F.collect_list("e").alias("_edges")).join(first, [*keys, "cx", "cy"], "left")
    cells = written(cells)
    blocks = _blocks(inside_runs(edges, keys, size), keys)

    own = footprints.select("city", "_id", outline(footprints).alias("_mine")).where("_mine is not null and size(_mine) > 0")
    start = F.get("_mine", F.lit(0))["p"]
    point = own.select("city", "_id", start["x"].alias("_x"), start["y"].alias("_y"))
    point = point.withColumns({"cx": F.floor(F.col("_x") / size).cast("long"), "cy": F.floor(F.col("_y") / size).cast("long")})
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("cx") / FAN**k).cast("long").alias("c")) for k in range(LEVELS)])
    inside = point.select("city", "_id", "cy", F.explode(levels).alias("_b")).select("city", "_id", "cy", "_b.*").join(blocks, ["city", "level", "c", "cy"]).select("_id", "_area", F.lit(1).alias("_n"))
    # from the cell's centre straight up or down, then along: how many edges lie between
    xc, yc = _centre(F.col("cx"), size), _centre(F.col("cy"), size)

    def between(e: Column) -> Column:
        p, q = e["p"], e["q"]
        y_at = p["y"] + (xc - p["x"]) * (q["y"] - p["y"]) / F.when(q["x"] == p["x"], 1.0).otherwise(q["x"] - p["x"])
        x_at = p["x"] + (F.col("_y") - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"])
        up = ((p["x"] > xc) != (q["x"] > xc)) & ((y_at > yc) != (y_at > F.col("_y")))
        along = ((p["y"] > F.col("_y")) != (q["y"] > F.col("_y"))) & ((x_at > xc) != (x_at > F.col("_x")))
        return up.cast("int") + along.cast("int")

    near = point.join(cells, ["city", "cx", "cy"]).select("_id", "_area", F.aggregate("_edges", F.lit(0), lambda n, e: n + between(e)).alias("_n"))
    within = inside.unionByName(near).groupBy("_id", "_area").agg(F.sum("_n").alias("_n")).where("_n % 2 = 1").drop("_n")

    for axis, values in (("cx", F.transform("_mine", lambda e: e["p"]["x"])), ("cy", F.transform("_mine", lambda e: e["p"]["y"]))):
        own = own.withColumn(axis, F.explode(F.sequence(F.floor((F.array_min(values) - distance) / size).cast("long"), F.floor((F.array_max(values) + distance) / size).cast("long"))))
    met = edges_near("_mine", "_edges", distance) if distance > 0 else edges_meet("_mine", "_edges")
    around = F.coalesce(point_in_edges("_start.x", "_start.y", "_mine"), F.lit(False))
    touching = own.join(cells, ["city", "cx", "cy"]).where(met | around).select("_id", "_area")
    return within.unionByName(touching).distinct()

