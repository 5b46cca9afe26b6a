"""References between nodes, ways and relations, resolved by joins on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B
from ..functions import coords as C


def way_edges(ways: DataFrame) -> DataFrame:
    """(way_id, pos, ref) of ways (id, nodes)."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "ref"))


def member_edges(relations: DataFrame) -> DataFrame:
    """(rel_id, pos, type, ref, role) of relations (id, members)."""
    return relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select("rel_id", "pos", "m.*")


def locate(edges: DataFrame, nodes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """(way_id, pts, found): points in order, null where a node is missing.

    One join on the node id and one aggregation by way; only three numbers a
    reference are shuffled. The list of a way is bounded by the way.
    """
    at = nodes.select(F.col("id").alias("ref"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("p"))
    rows = edges.join(at, "ref", "left").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("l"))
    pts = F.transform("l", lambda e: e["p"])
    return rows.select("way_id", pts.alias("pts"), F.size(F.filter(pts, lambda p: p.isNotNull())).alias("found"))


def way_lines(located: DataFrame) -> DataFrame:
    """Lines of two points or more, without repeated points: (way_id, line, found)."""
    return located.withColumn("line", C.dedup(F.col("pts"))).where(F.size("line") >= 2).select("way_id", "line", "found")


def way_polygons(rings: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, geom) of closed ways that are polygons; each is made once (a filter on a UDF's result would have it made again)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            geom = B.polygons_of_ways(b.column(1))
            there = geom.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(there), geom.filter(there)], names=[key, "geom"])

    df = rings.select(key, ring)
    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, geom binary")


def members(edges: DataFrame, nodes: DataFrame, way_points: DataFrame, types: str = "nw") -> DataFrame:
    """(rel_id, members): array of struct<pos,type,ref,role,pts> in member order; missing ways are left out, nodes stay, repeats repeat."""
    n = edges.where("type = 'n'").join(nodes.select(F.col("id").alias("ref"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("pts")), "ref", "left")
    w = edges.where("type = 'w'").join(way_points.select(F.col("way_id").alias("ref"), "pts"), "ref")
    parts = [f for t, f in (("n", n), ("w", w)) if t in types]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "ref", "role", "pts"))).alias("members"))


def way_boxes(located: DataFrame) -> DataFrame:
    pts = F.filter("pts", lambda p: p.isNotNull())
    return located.select("way_id", C.bbox(pts).alias("b")).where("b.x0 IS NOT NULL").select("way_id", "b.*")


def relation_boxes(edges: DataFrame, nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(rel_id, x0, y0, x1, y1) of member nodes and ways; relations without any located member are left out."""
    n = edges.where("type = 'n'").join(nodes.select(F.col("id").alias("ref"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "ref")
    w = edges.where("type = 'w'").join(boxes.withColumnRenamed("way_id", "ref"), "ref")
    both = n.select("rel_id", "x0", "y0", "x1", "y1").unionByName(w.select("rel_id", "x0", "y0", "x1", "y1"))
    return both.groupBy("rel_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def parent_ways(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Ways that hold one of the changed nodes: (id)."""
    return edges.join(changed.select(F.col("id").alias("ref")), "ref", "left_semi").select(F.col("way_id").alias("id")).distinct()


def parent_relations(changed: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Relations that hold one of the changed objects of a kind: (id)."""
    held = edges.where(F.col("type") == kind)
    return held.join(changed.select(F.col("id").alias("ref")), "ref", "left_semi").select(F.col("rel_id").alias("id")).distinct()


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def in_id_cache(edges: DataFrame, cached: DataFrame) -> DataFrame:
    """(way_id, positions): 1-based positions of the references that are in the cache, in order."""
    hit = edges.join(cached.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi")
    return hit.groupBy("way_id").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"))


def enrich_members(edges: DataFrame, relations: DataFrame, kind: str, value: str) -> DataFrame:
    """(id, values): of each member of a kind, the sorted distinct values of the relations that hold it."""
    held = edges.where(F.col("type") == kind).join(relations.select(F.col("id").alias("rel_id"), F.col(value).alias("v")), "rel_id")
    return held.where("v IS NOT NULL").groupBy(F.col("ref").alias("id")).agg(F.array_sort(F.collect_set("v")).alias("values"))


def with_users(objects: DataFrame, users: DataFrame) -> DataFrame:
    """User names from the table of users; unknown ones are null."""
    return objects.drop("user").join(users, "uid", "left")


def lookup(objects: DataFrame, ids: list[int] | DataFrame, id_col: str = "id") -> DataFrame:
    """Single objects by their ids: a list goes into the scan as a filter, a table (id) is semi-joined. Ids that aren't there give no row."""
    if isinstance(ids, DataFrame):
        return objects.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    return objects.where(F.col(id_col).isin([int(i) for i in ids]))
