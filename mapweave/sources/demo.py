"""The generic test tables seen as nodes, ways, relations, regions and changes.

Parts are nodes on a grid, orders are ways over the parts of their items,
customers are relations over their orders; events are a change log. ``CTE`` says
the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, lon, lat, tags)"""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey + 1 AS id", "CAST(((p_partkey * 7919) % 3400 - 1700) * 1000000 AS INT) AS x", "CAST(((p_partkey * 104729) % 1600 - 800) * 1000000 AS INT) AS y",
                     "map('brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING), 'name', p_name) AS tags")
    return p.select("id", "x", "y", (F.col("x") / F.lit(1e7)).alias("lon"), (F.col("y") / F.lit(1e7)).alias("lat"), "tags")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, ref)"""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey + 1 AS way_id", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS pos", "l_partkey + 1 AS ref")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, nodes, tags)"""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey + 1 AS id", "map('status', o_orderstatus, 'priority', o_orderpriority) AS tags")
    e = edges(spark, sf_dir).groupBy(F.col("way_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", "ref"))).alias("l"))
    return o.join(e, "id", "left").select("id", F.coalesce(F.transform("l", lambda v: v["ref"]), F.array().cast("array<bigint>")).alias("nodes"), "tags")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_id, pos, type, ref, role): a customer's orders as ways, after each its first part as a node."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey + 1 AS rel_id", "o_orderkey + 1 AS oid", "o_orderstatus AS role", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k")
    first = edges(spark, sf_dir).where("pos = 0").select(F.col("way_id").alias("oid"), F.col("ref").alias("first"))
    j = o.join(first, "oid", "left")
    w = j.selectExpr("rel_id", "2 * k AS pos", "'w' AS type", "oid AS ref", "role")
    return w.unionByName(j.where("first IS NOT NULL").selectExpr("rel_id", "2 * k + 1 AS pos", "'n' AS type", "first AS ref", "'stop' AS role"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS name", "CAST(-175 + (n_nationkey % 5) * 70 - 1 AS DOUBLE) AS x0", "CAST(-85 + ((n_nationkey - n_nationkey % 5) / 5) * 34 - 1 AS DOUBLE) AS y0",
        "CAST(-175 + (n_nationkey % 5) * 70 + 71 AS DOUBLE) AS x1", "CAST(-85 + ((n_nationkey - n_nationkey % 5) / 5) * 34 + 35 AS DOUBLE) AS y1")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring): closed rings, one for each order of three to eight items, in tenths of degrees round the origin."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey + 1 AS id", f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS i", "CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n", "0.1D + l_quantity / 500D AS r")
    li = li.where("n BETWEEN 3 AND 8").withColumn("d", F.expr("CAST(floor(i * 8 / n) AS INT)"))
    li = li.withColumn("p", F.struct((F.col("r") * F.try_element_at(F.array(*[F.lit(float(v)) for v in (1, 1, 0, -1, -1, -1, 0, 1)]), F.col("d") + 1)).alias("x"), (F.col("r") * F.try_element_at(F.array(*[F.lit(float(v)) for v in (0, 1, 1, 1, 0, -1, -1, -1)]), F.col("d") + 1)).alias("y")))
    g = li.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("l")).select("id", F.transform("l", lambda v: v["p"]).alias("pts"))
    return g.select("id", F.concat("pts", F.slice("pts", 1, 1)).alias("ring"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, version, visible, kind, value): events in order; signup creates, error deletes, others modify."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS seq", "user_id + 1 AS id", "CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS version", "event_type <> 'error' AS visible", "event_type AS kind", "value")


CTE = f"""
nodes AS (SELECT p_partkey + 1 AS id, ((p_partkey * 7919) % 3400 - 1700) * 1000000 / 1e7 AS lon, ((p_partkey * 104729) % 1600 - 800) * 1000000 / 1e7 AS lat,
  p_brand AS brand, p_type AS type, p_size AS size, p_name AS name FROM part),
edges AS (SELECT l_orderkey + 1 AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS pos, l_partkey + 1 AS ref FROM lineitem),
mem AS (SELECT o_custkey + 1 AS rel_id, o_orderkey + 1 AS oid, o_orderstatus AS role, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS k FROM orders),
members AS (SELECT rel_id, 2 * k AS pos, 'w' AS type, oid AS ref, role FROM mem UNION ALL
  SELECT rel_id, 2 * k + 1, 'n', ref, 'stop' FROM mem JOIN edges ON oid = way_id AND edges.pos = 0),
loc AS (SELECT way_id, pos, lon, lat FROM edges LEFT JOIN nodes ON ref = id),
seen AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY pos) AS k, lon, lat,
  lag(lon) OVER (PARTITION BY way_id ORDER BY pos) AS plon, lag(lat) OVER (PARTITION BY way_id ORDER BY pos) AS plat FROM loc WHERE lon IS NOT NULL),
pts AS (SELECT way_id, k, lon, lat, plon, plat FROM seen WHERE plon IS NULL OR plon <> lon OR plat <> lat),
lines AS (SELECT way_id, count(*) AS n, sum(CASE WHEN plon IS NULL THEN 0e0 ELSE sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat)) END) AS len,
  min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM pts GROUP BY way_id HAVING count(*) >= 2),
regions AS (SELECT n_name AS name, -175 + (n_nationkey % 5) * 70 - 1 AS x0, -85 + ((n_nationkey - n_nationkey % 5) / 5) * 34 - 1 AS y0,
  -175 + (n_nationkey % 5) * 70 + 71 AS x1, -85 + ((n_nationkey - n_nationkey % 5) / 5) * 34 + 35 AS y1 FROM nation),
sp AS (SELECT l_orderkey + 1 AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n,
  0.1e0 + l_quantity / 5e2 AS r FROM lineitem),
star AS (SELECT id, i, n, r * [1, 1, 0, -1, -1, -1, 0, 1][CAST(floor(i * 8 / n) AS INT) + 1] AS x, r * [0, 1, 1, 1, 0, -1, -1, -1][CAST(floor(i * 8 / n) AS INT) + 1] AS y FROM sp WHERE n BETWEEN 3 AND 8),
seg AS (SELECT a.id, a.i, a.n, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM star a JOIN star b ON a.id = b.id AND b.i = (a.i + 1) % a.n),
changes AS (SELECT event_id AS seq, user_id + 1 AS id, CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS version, event_type <> 'error' AS visible, event_type AS kind, value FROM events)
"""
