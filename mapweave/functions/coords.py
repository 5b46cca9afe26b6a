"""Geometry on arrays of points (struct<x,y>) as Catalyst expressions, and tile arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Circumference of the map at the equator in metres, and half of it.
EARTH = 40075016.68
HALF = EARTH / 2
RADIUS = 6378137.0


def dedup(pts: Column) -> Column:
    """Without nulls, and without points equal to the one before."""
    some = F.filter(pts, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    return F.filter(some, lambda p, i: (i == 0) | (p != F.try_element_at(some, F.when(i > 0, i).otherwise(1).cast("int"))))


def segments(pts: Column) -> Column:
    """Of a line: array<struct<a,b>> of neighbouring points."""
    n = F.size(pts) - 1
    return F.when(n > 0, F.zip_with(F.slice(pts, 1, F.greatest(n, F.lit(0))), F.slice(pts, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def length(pts: Column) -> Column:
    d = lambda s: F.sqrt((s["a"]["x"] - s["b"]["x"]) * (s["a"]["x"] - s["b"]["x"]) + (s["a"]["y"] - s["b"]["y"]) * (s["a"]["y"] - s["b"]["y"]))
    return _sum(F.transform(segments(pts), d))


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    c = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    a6 = signed_area(ring) * 6
    return F.struct((_sum(F.transform(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"]) * c(s))) / a6).alias("x"), (_sum(F.transform(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"]) * c(s))) / a6).alias("y"))


def bbox(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def n_points(pts: Column) -> Column:
    return F.when(pts.isNull(), 0).otherwise(F.size(pts))


def point_n(pts: Column, n: int) -> Column:
    """1-based, negative from the end, 0 and beyond the ends: null."""
    return F.try_element_at(pts, F.lit(n)) if n else F.lit(None)


def is_closed(nodes: Column) -> Column:
    return (F.size(nodes) > 0) & (F.try_element_at(nodes, F.lit(1)) == F.try_element_at(nodes, F.lit(-1)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def interpolate(a: Column, b: Column, f: float) -> Column:
    return F.struct((a["x"] + f * (b["x"] - a["x"])).alias("x"), (a["y"] + f * (b["y"] - a["y"])).alias("y"))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def mercator_y(lat: Column) -> Column:
    held = F.greatest(F.lit(-89.99), F.least(F.lit(89.99), lat))
    return F.ln(F.tan(F.lit(3.141592653589793 / 4) + F.radians(held) / 2)) * RADIUS


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test; points on the boundary count as inside."""
    cross = F.size(F.filter(segments(ring), lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(s["b"]["y"] != s["a"]["y"], s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])))
    edge = F.exists(segments(ring), lambda s: ((s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) == (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])) & x.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & y.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"])))
    return edge | (cross % 2 == 1)


# -- tiles ------------------------------------------------------------------

def tile_coord(merc: Column, zoom: Column | int, axis: str) -> Column:
    """A mercator coordinate as a fraction of tiles from the map's west or north edge."""
    z = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return z * (F.lit(0.5) + merc / EARTH) if axis == "x" else z * (F.lit(0.5) - merc / EARTH)


def tile_box(x: Column, y: Column, zoom: Column, margin: float = 0.0) -> Column:
    """Mercator box of a tile with a margin (in tiles), held within the map."""
    w = F.lit(EARTH) / F.pow(F.lit(2.0), zoom)
    hold = lambda c: F.greatest(F.lit(-HALF), F.least(F.lit(HALF), c))
    return F.struct(hold((x - margin) * w - HALF).alias("x0"), hold(F.lit(HALF) - (y + 1 + margin) * w).alias("y0"), hold((x + 1 + margin) * w - HALF).alias("x1"), hold(F.lit(HALF) - (y - margin) * w).alias("y1"))


def _spread(v: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def quadkey(x: Column, y: Column) -> Column:
    """x on the even bits, y on the odd ones."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def quadkey_xy(q: Column) -> Column:
    return F.struct(_gather(q).cast("int").alias("x"), _gather(F.shiftright(q, 1)).cast("int").alias("y"))


def parse_tile(s: Column) -> Column:
    """'zoom/x/y' to struct<zoom,x,y>; null unless digits only, zoom below 32, x and y within the zoom."""
    ok = s.rlike("^[0-9]{1,2}/[0-9]{1,10}/[0-9]{1,10}$")
    part = F.split(F.when(ok, s), "/")
    z, x, y = (F.try_element_at(part, F.lit(k)).cast("long") for k in (1, 2, 3))
    top = F.pow(F.lit(2.0), F.least(z, F.lit(31)))
    return F.when((z < 32) & (x < top) & (y < top), F.struct(z.cast("int").alias("zoom"), x.cast("int").alias("x"), y.cast("int").alias("y")))
