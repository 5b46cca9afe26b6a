"""Lookup of regions by location: an equi-join on grid cells, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import st


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Grid cells (struct<i,j>) that a box touches."""
    cell = lambda v: F.floor(v / size).cast("int")
    rows = F.transform(F.sequence(cell(x0), cell(x1)), lambda i: F.transform(F.sequence(cell(y0), cell(y1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.flatten(rows)


def region_boxes(regions: DataFrame) -> DataFrame:
    """(name, geom, x0, y0, x1, y1) of regions (name, geom as EWKB)."""
    return regions.withColumn("b", st.bbox("geom")).select("name", "geom", "b.*")


def matches(points: DataFrame, regions: DataFrame, size: float = 10.0, exact: bool = True) -> DataFrame:
    """(points' columns, name): points (id, lon, lat) within or on regions (name, x0, y0, x1, y1[, geom]).

    Regions are dealt to the cells they touch and points to theirs, so the join
    is an equi-join whatever the number of either; a region over many cells
    repeats, a cell with many points is split by adaptive execution.
    """
    dealt = regions.withColumn("cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    at = points.withColumn("cell", F.struct(F.floor(F.col("lon") / size).cast("int").alias("i"), F.floor(F.col("lat") / size).cast("int").alias("j")))
    hit = at.join(dealt, "cell").where("lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
    if exact and "geom" in regions.columns:
        hit = hit.withColumn("p", st.as_point(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))).where(st.intersects("geom", "p"))
    return hit.select(*points.columns, "name")


def geometry_matches(things: DataFrame, regions: DataFrame, size: float = 10.0) -> DataFrame:
    """(id, name): things (id, geom) that share a point with regions (name, geom)."""
    boxed = things.withColumn("b", st.bbox("geom")).where("b IS NOT NULL").select("id", F.col("geom").alias("g"), "b")
    left = boxed.withColumn("cell", F.explode(cells(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), size)))
    right = region_boxes(regions).withColumn("cell", F.explode(cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)))
    hit = left.join(right, "cell").where("b.x0 <= x1 AND b.x1 >= x0 AND b.y0 <= y1 AND b.y1 >= y0")
    return hit.where(st.intersects("geom", "g")).select("id", "name").distinct()


def all_intersecting(points: DataFrame, regions: DataFrame, size: float = 10.0) -> DataFrame:
    """(id, names): sorted distinct names; points in no region are left out."""
    return matches(points, regions, size).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def first_intersecting(points: DataFrame, regions: DataFrame, size: float = 10.0) -> DataFrame:
    """(id, name): the first name in order."""
    return matches(points, regions, size).groupBy("id").agg(F.min("name").alias("name"))


def box_region(name: str, x0: float, y0: float, x1: float, y1: float) -> tuple:
    from ..functions import shapes as S

    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return name, S.to_ewkb(S.Geom("POLYGON", [ring]))


def tile_join(shapes: DataFrame, zoom: int, margin: float = 0.0) -> DataFrame:
    """Shapes with a mercator box (x0, y0, x1, y1) beside each tile (tx, ty) whose box with a margin they touch."""
    from ..functions.coords import tile_coord

    top = (1 << zoom) - 1
    lim = lambda c: F.greatest(F.lit(0), F.least(F.lit(top), F.floor(c))).cast("int")
    xs = F.sequence(lim(tile_coord(F.col("x0"), zoom, "x") - margin), lim(tile_coord(F.col("x1"), zoom, "x") + margin))
    ys = F.sequence(lim(tile_coord(F.col("y1"), zoom, "y") - margin), lim(tile_coord(F.col("y0"), zoom, "y") + margin))
    return shapes.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))
