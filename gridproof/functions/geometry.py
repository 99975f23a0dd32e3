"""Geometry as column expressions: boxes in closed form, polygons as arrays of points, and UTM.

A box is (xmin, ymin, xmax, ymax); a ring is ``array<struct<x:double,y:double>>``,
closed or open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridproof.functions.exprs import col

BOX = ("xmin", "ymin", "xmax", "ymax")


def box(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}{suffix}") for k in BOX}


def overlap_length(lo_a, hi_a, lo_b, hi_b) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(hi_a), col(hi_b)) - F.greatest(col(lo_a), col(lo_b)))


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap_length(a["xmin"], a["xmax"], b["xmin"], b["xmax"]) * overlap_length(a["ymin"], a["ymax"], b["ymin"], b["ymax"])


def box_area(a: dict[str, Column]) -> Column:
    return (a["xmax"] - a["xmin"]) * (a["ymax"] - a["ymin"])


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes meet, at an edge or a corner too."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def grown(a: dict[str, Column], by: float) -> dict[str, Column]:
    """A box grown by a distance, with square corners."""
    return {"xmin": a["xmin"] - by, "ymin": a["ymin"] - by, "xmax": a["xmax"] + by, "ymax": a["ymax"] + by}


def box_iou(a: dict[str, Column], b: dict[str, Column], buffer: float = 0.0) -> Column:
    """Intersection over union of boxes, 0 for an empty union; a buffer keeps square corners."""
    if buffer > 0:
        a, b = grown(a, buffer), grown(b, buffer)
    both = box_intersection(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def box_ring(a: dict[str, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((a["xmin"], a["ymin"]), (a["xmax"], a["ymin"]), (a["xmax"], a["ymax"]), (a["xmin"], a["ymax"]))])


def _edges(ring: Column) -> Column:
    """Structs (p, q) of a ring's neighbouring points, last to first."""
    after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _local(ring: Column) -> Column:
    """The ring seen from its first point, so that products of plane coordinates of millions of metres lose no digits."""
    o = F.element_at(ring, 1)
    return F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))


def ring_area(ring) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    r = _local(col(ring))
    twice = F.aggregate(_edges(r), F.lit(0.0), lambda a, e: a + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2)


def ring_length(ring) -> Column:
    r = col(ring)
    return F.aggregate(_edges(r), F.lit(0.0), lambda a, e: a + F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2)))


def ring_centroid(ring) -> Column:
    """Struct (x, y) of the area centroid; the first point where the area is 0."""
    r = col(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        c = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (p["x"] + q["x"]) * c).alias("x"), (s["y"] + (p["y"] + q["y"]) * c).alias("y"))

    def end(s: Column) -> Column:
        first = F.element_at(r, 1)
        return F.when(s["a"] != 0, F.struct((first["x"] + s["x"] / (3 * s["a"])).alias("x"), (first["y"] + s["y"] / (3 * s["a"])).alias("y"))).otherwise(F.struct(first["x"].alias("x"), first["y"].alias("y")))

    return F.aggregate(_edges(_local(r)), zero, add, end)


def ring_bounds(ring) -> Column:
    r = col(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def point_in_ring(x, y, ring) -> Column:
    """Even-odd test by a ray to the right; lower and left edges are inside, upper and right ones aren't."""
    x, y = col(x), col(y)

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(_edges(col(ring)), F.lit(0), lambda a, e: a + crosses(e)) % 2 == 1


def polygon_edges(ring, holes=None) -> Column:
    """Edges of an outer ring and of its holes, as one array."""
    outer = _edges(col(ring))
    if holes is None:
        return outer
    inner = F.coalesce(F.flatten(F.transform(col(holes), _edges)), F.slice(outer, 1, 0))
    return F.concat(outer, inner)


def polygon_area(ring, holes=None) -> Column:
    """Area of the outer ring less that of its holes."""
    if holes is None:
        return ring_area(ring)
    return ring_area(ring) - F.coalesce(F.aggregate(col(holes), F.lit(0.0), lambda a, h: a + ring_area(h)), F.lit(0.0))


def _crosses_ray(x: Column, y: Column, e: Column) -> Column:
    p, q = e["p"], e["q"]
    at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"])
    return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)


def point_in_edges(x, y, edges) -> Column:
    """``point_in_ring`` for the edges of a polygon with holes."""
    x, y = col(x), col(y)
    return F.aggregate(col(edges), F.lit(0), lambda a, e: a + _crosses_ray(x, y, e)) % 2 == 1


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Side of line ab on which c lies: -1, 0 or 1."""
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _segments_meet(e: Column, f: Column) -> Column:
    a, b, c, d = e["p"], e["q"], f["p"], f["q"]
    boxes = [(F.greatest(a[k], b[k]) >= F.least(c[k], d[k])) & (F.greatest(c[k], d[k]) >= F.least(a[k], b[k])) for k in ("x", "y")]
    return boxes[0] & boxes[1] & (_turn(a, b, c) * _turn(a, b, d) <= 0) & (_turn(c, d, a) * _turn(c, d, b) <= 0)


def edges_meet(mine, others) -> Column:
    """Any two edges share a point."""
    return F.exists(col(mine), lambda e: F.exists(col(others), lambda f: _segments_meet(e, f)))


def edges_intersect(mine, others) -> Column:
    """Closed polygons, given by their edges, share a point: edges meet, or one holds the other outside its holes."""
    a, b = col(mine), col(others)
    first, second = F.element_at(a, 1)["p"], F.element_at(b, 1)["p"]
    met = edges_meet(a, b)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False)) & (met | point_in_edges(first["x"], first["y"], b) | point_in_edges(second["x"], second["y"], a))


def _point_segment(p: Column, e: Column) -> Column:
    """Square of the distance between a point and a segment."""
    a, b = e["p"], e["q"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.pow(p["x"] - a["x"] - t * dx, 2) + F.pow(p["y"] - a["y"] - t * dy, 2)


def edges_near(mine, others, distance: float) -> Column:
    """Any two edges come within a distance of each other."""
    limit = float(distance) ** 2

    def near(e: Column, f: Column) -> Column:
        return _segments_meet(e, f) | (F.least(_point_segment(e["p"], f), _point_segment(e["q"], f), _point_segment(f["p"], e), _point_segment(f["q"], e)) <= limit)

    return F.coalesce(F.exists(col(mine), lambda e: F.exists(col(others), lambda f: near(e, f))), F.lit(False))


def edges_within(mine, others, distance: float) -> Column:
    """Polygons come within a distance of each other, which is to meet one of them after a round buffer."""
    return edges_intersect(mine, others) | edges_near(mine, others, distance)


def web_mercator(lon, lat) -> Column:
    """Struct (x, y) in metres of the spherical Mercator projection (EPSG:3857)."""
    half = math.pi / 4
    return F.struct((F.radians(col(lon)) * 6378137.0).alias("x"), (F.log(F.tan(half + F.radians(col(lat)) / 2)) * 6378137.0).alias("y"))


def ring_to_utm(ring, zone) -> Column:
    """A ring of degrees (x is the longitude) in metres of a UTM zone."""
    zone = col(zone)
    return F.transform(col(ring), lambda p: utm(p["x"], p["y"], zone))


def ring_to_mercator(ring) -> Column:
    return F.transform(col(ring), lambda p: web_mercator(p["x"], p["y"]))


def inverse_mercator(x, y) -> Column:
    """Struct (x, y) in degrees of spherical Mercator metres."""
    return F.struct(F.degrees(col(x) / 6378137.0).alias("x"), F.degrees(2 * F.atan(F.exp(col(y) / 6378137.0)) - math.pi / 2).alias("y"))


def utm_zone(lon) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((col(lon) + 180) / 6).cast("int") + 1))


def utm_epsg(lon, lat) -> Column:
    """326xx north of the equator and on it, 327xx south."""
    return F.when(col(lat) >= 0, 32600).otherwise(32700) + utm_zone(lon)


# WGS 84 and the Krueger series in the third flattening.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm(lon, lat, zone=None) -> Column:
    """Struct (x, y) in metres; southern latitudes get a false northing."""
    lon, lat = col(lon), col(lat)
    zone = utm_zone(lon) if zone is None else col(zone)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    k = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * _RADIUS * x).alias("x"), (F.when(lat < 0, 10000000.0).otherwise(0.0) + 0.9996 * _RADIUS * y).alias("y"))


def inverse_utm(x, y, zone, south=False) -> Column:
    """Struct (x, y) in degrees of metres in a UTM zone, north of the equator or ``south``."""
    north = F.when(col(south) if not isinstance(south, bool) else F.lit(south), 10000000.0).otherwise(0.0)
    k = 0.9996 * _RADIUS
    xi, eta = (col(y) - north) / k, (col(x) - 500000) / k
    p, q = xi, eta
    for j, b in enumerate(_BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((col(zone) * 6 - 183 + F.degrees(F.atan2(F.sinh(q), F.cos(p)))).alias("x"), F.degrees(lat).alias("y"))
