"""A query for each operator, over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import coerce as K
from ..functions import coords as C
from ..functions import st
from ..functions import tags as T
from ..operators import expire as E
from ..operators import generalize as G
from ..operators import resolve as R
from ..operators import spatial as X
from ..sources import demo as D
from ..sources import sinks as W
from ..streaming import changes as CH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = (f"WITH {D.CTE}\n" if cte else "") + sql
        return fn
    return put


def r6(c):
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _lines(spark, sf):
    return R.way_lines(R.locate(D.edges(spark, sf), D.nodes(spark, sf)))


# -- resolution, geometries ---------------------------------------------------

@query("""SELECT way_id, CAST(n AS INT) AS n_points, round(len, 6) AS length, x0, y0, x1, y1, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS SMALLINT) AS priority
FROM lines JOIN orders ON o_orderkey + 1 = way_id""")
def way_lines(spark, sf):
    """Lines of ways with typed tags."""
    lines = _lines(spark, sf).withColumn("b", C.bbox(F.col("line")))
    ways = D.table(spark, sf, "orders").selectExpr("o_orderkey + 1 AS way_id", "o_orderstatus AS status", "o_orderpriority")
    return lines.join(ways, "way_id").select("way_id", C.n_points(F.col("line")).alias("n_points"), r6(C.length(F.col("line"))).alias("length"), "b.x0", "b.y0", "b.x1", "b.y1", "status", K.to_int(F.substring("o_orderpriority", 1, 1), "int2").alias("priority"))


@query("SELECT way_id, CAST(count(*) AS INT) AS refs, CAST(count(lon) FILTER (ref % 50 <> 0) AS INT) AS found FROM edges LEFT JOIN nodes ON ref = id GROUP BY way_id")
def j1_missing_nodes(spark, sf):
    """References kept where the node is missing, and how many were found; every fiftieth node is taken away for it."""
    return R.locate(D.edges(spark, sf), D.nodes(spark, sf).where("id % 50 <> 0")).select("way_id", F.size("pts").alias("refs"), "found")


@query("""SELECT rel_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos * (ref % 1000)) AS BIGINT) AS checksum, min(role) AS first_role, max(role) AS last_role
FROM members m WHERE type = 'n' OR ref IN (SELECT way_id FROM edges) GROUP BY rel_id""")
def j2_relation_members(spark, sf):
    """Members in order, without ways that are missing."""
    pts = R.locate(D.edges(spark, sf), D.nodes(spark, sf))
    m = R.members(D.members(spark, sf), D.nodes(spark, sf), pts)
    return m.select("rel_id", F.explode("members").alias("m")).groupBy("rel_id").agg(F.count("*").alias("n"), F.sum(F.col("m.pos") * (F.col("m.ref") % 1000)).alias("checksum"), F.min("m.role").alias("first_role"), F.max("m.role").alias("last_role"))


@query("""SELECT rel_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (
SELECT rel_id, lon AS x0, lat AS y0, lon AS x1, lat AS y1 FROM members JOIN nodes ON ref = id WHERE members.type = 'n' UNION ALL
SELECT rel_id, lon, lat, lon, lat FROM members JOIN loc ON ref = way_id WHERE type = 'w' AND lon IS NOT NULL) GROUP BY rel_id""")
def a3_relation_bbox(spark, sf):
    """A3, A4: boxes of relations over member nodes and ways."""
    n = D.nodes(spark, sf)
    return R.relation_boxes(D.members(spark, sf), n, R.way_boxes(R.locate(D.edges(spark, sf), n)))


@query("SELECT DISTINCT way_id AS id FROM edges WHERE ref IN (SELECT id FROM changes WHERE version <> 1)")
def j5_parent_ways(spark, sf):
    """Ways of changed nodes."""
    return R.parent_ways(D.changes(spark, sf).where("version <> 1").select("id"), D.edges(spark, sf))


@query("""SELECT DISTINCT rel_id AS id, m.type AS kind FROM members m JOIN (SELECT DISTINCT id FROM changes WHERE visible AND value > 90) c ON m.ref = c.id""")
def j6_parent_relations(spark, sf):
    """Relations of changed nodes and of changed ways."""
    c, e = D.changes(spark, sf).where("visible AND value > 90").select("id"), D.members(spark, sf)
    return R.parent_relations(c, e, "n").withColumn("kind", F.lit("n")).unionByName(R.parent_relations(c, e, "w").withColumn("kind", F.lit("w")))


@query("SELECT id, string_agg(name, ',' ORDER BY name) AS names, min(name) AS first FROM (SELECT DISTINCT id, regions.name FROM nodes JOIN regions ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) GROUP BY id")
def j7_locator(spark, sf):
    """Regions of nodes, all names and the first."""
    hit = X.matches(D.nodes(spark, sf), D.regions(spark, sf))
    return hit.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.min("name").alias("first"))


@query("""SELECT s.id, count(*) AS n FROM (SELECT id, max(r) AS r, ((id * 7919) % 3400 - 1700) / 1e1 AS cx, ((id * 104729) % 1600 - 800) / 1e1 AS cy FROM sp WHERE n BETWEEN 3 AND 8 GROUP BY id) s
JOIN regions ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY s.id""")
def f27_point_in_polygon(spark, sf):
    """The exact test on EWKB regions."""
    pts = D.stars(spark, sf).selectExpr("id", "((id * 7919) % 3400 - 1700) / 10D AS lon", "((id * 104729) % 1600 - 800) / 10D AS lat")
    box = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    regions = D.regions(spark, sf).withColumn("geom", st.as_polygon(box))
    return X.matches(pts, regions).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT way_id, string_agg(CAST(pos + 1 AS VARCHAR), ',' ORDER BY pos) AS positions FROM edges WHERE ref IN (SELECT id FROM nodes WHERE brand = 'Brand#11') GROUP BY way_id")
def j10_id_cache(spark, sf):
    """Positions of a way's nodes that are in a cache."""
    cached = D.nodes(spark, sf).where(T.tag(F.col("tags"), "brand") == "Brand#11")
    return R.in_id_cache(D.edges(spark, sf), cached).select("way_id", F.array_join("positions", ",").alias("positions"))


@query("SELECT id FROM ((SELECT id FROM changes WHERE visible UNION SELECT id FROM nodes WHERE size > 40) EXCEPT SELECT way_id FROM edges WHERE pos = 7)")
def j12_id_sets(spark, sf):
    """Union, difference and uniqueness of id lists."""
    a, b = D.changes(spark, sf).where("visible").select("id"), D.nodes(spark, sf).where(K.to_int(T.tag(F.col("tags"), "size")) > 40).select("id")
    return R.minus_ids(R.union_ids(a, b), D.edges(spark, sf).where("pos = 7").select(F.col("way_id").alias("id")))


@query("""SELECT ref AS id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS routes FROM members JOIN customer ON c_custkey + 1 = rel_id WHERE type = 'w' GROUP BY ref""")
def j15_member_enrichment(spark, sf):
    """Relation data on member ways, by one join."""
    rel = D.table(spark, sf, "customer").selectExpr("c_custkey + 1 AS id", "c_mktsegment AS v")
    return R.enrich_members(D.members(spark, sf), rel, "w", "v").select("id", F.array_join("values", ",").alias("routes"))


@query("SELECT c.id, c.kind, CAST(u.uid AS INT) AS uid, u.name AS user FROM (SELECT id, max_by(kind, seq) AS kind FROM changes GROUP BY id) c LEFT JOIN (SELECT c_custkey + 1 AS uid, min(c_name) AS name FROM customer GROUP BY 1) u ON c.id = u.uid")
def j4_users(spark, sf):
    """Attributes from the table of users."""
    users = W.add_users(spark.createDataFrame([], "uid int, user string"), D.table(spark, sf, "customer").selectExpr("CAST(c_custkey + 1 AS INT) AS uid", "c_name AS user"))
    last = M.latest_versions(D.changes(spark, sf), ["id"], ["seq"]).selectExpr("id", "kind", "CAST(id AS INT) AS uid", "'' AS user")
    return R.with_users(last, users.withColumn("known", F.col("uid"))).select("id", "kind", F.col("known").alias("uid"), "user")


# -- scans and checks ------------------------------------------------------------

@query("SELECT CAST(count(*) FILTER (id < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (id = last) AS BIGINT) AS duplicate, CAST(count(*) FILTER (id < last) AS BIGINT) AS unordered FROM (SELECT id, lag(id) OVER (PARTITION BY kind ORDER BY seq) AS last FROM changes)")
def s7_input_order(spark, sf):
    """Order of ids within a stream of each kind."""
    return M.check_input(D.changes(spark, sf), ["seq"], ("kind",))


@query("SELECT id, seq, visible, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM changes) WHERE k = 1")
def s9_latest_version(spark, sf):
    """Of two files together, the last version of each object."""
    c = D.changes(spark, sf).drop("version")
    return M.merge_files([c.where("seq % 2 = 0"), c.where("seq % 2 = 1")], ["id"], ["seq"])


@query("SELECT id, lon, lat FROM nodes WHERE lon BETWEEN -20.5 AND 60 AND lat BETWEEN -10 AND 45.5")
def s12_bbox(spark, sf):
    """Valid nodes of a box, on the fixed-point coordinates."""
    return M.in_bbox(M.valid_locations(D.nodes(spark, sf)), -20.5, -10, 60, 45.5).select("id", "lon", "lat")


@query("SELECT rel_id, count(*) AS n FROM members GROUP BY rel_id HAVING count(*) <= 20")
def s14_member_limit(spark, sf):
    """Relations without more than so many members."""
    rel = D.members(spark, sf).groupBy(F.col("rel_id").alias("id")).agg(F.collect_list("ref").alias("members"))
    return M.members_within(rel, 20).select(F.col("id").alias("rel_id"), F.size("members").cast("long").alias("n"))


@query("SELECT max(o_orderdate) AS ts FROM orders", cte=False)
def s11_last_timestamp(spark, sf):
    """The last time of all objects."""
    o = D.table(spark, sf, "orders").selectExpr("o_orderdate AS ts")
    return M.last_timestamp(o.where("ts IS NOT NULL"), o)


@query("""SELECT s, CAST(z AS INT) AS zoom, CAST(x AS INT) AS x, CAST(y AS INT) AS y, z < 32 AND x < pow(2, z) AND y < pow(2, z) AS ok FROM (SELECT DISTINCT CAST(l_quantity AS INT) % 34 AS z, l_suppkey % 40 AS x, l_linenumber AS y,
concat(CAST(l_quantity AS INT) % 34, '/', l_suppkey % 40, '/', l_linenumber) AS s FROM lineitem) """, cte=False)
def s16_tile_list(spark, sf):
    """Tiles written as zoom/x/y."""
    s = D.table(spark, sf, "lineitem").selectExpr("concat(CAST(l_quantity AS INT) % 34, '/', l_suppkey % 40, '/', l_linenumber) AS s").distinct()
    part = F.split("s", "/")
    return s.select("s", part[0].cast("int").alias("zoom"), part[1].cast("int").alias("x"), part[2].cast("int").alias("y"), C.parse_tile(F.col("s")).isNotNull().alias("ok"))


@query("SELECT kind, count(*) AS n, CAST(max(id) AS BIGINT) AS max_id, CAST(count(*) FILTER (visible) AS BIGINT) AS seen FROM changes GROUP BY kind")
def a1_counters(spark, sf):
    """Objects by kind, the largest id, how many were accepted."""
    return D.changes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("max_id"), F.count_if("visible").alias("seen"))


@query("SELECT way_id >> 5 AS bucket, count(*) AS n, CAST(sum(ref) AS BIGINT) AS refs FROM edges GROUP BY way_id >> 5")
def a6_buckets(spark, sf):
    """Way lists by id >> 5."""
    g = D.edges(spark, sf).groupBy(F.shiftright("way_id", 5).alias("bucket")).agg(F.collect_list("ref").alias("l"))
    return g.select("bucket", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda s, v: s + v).alias("refs"))


@query("""SELECT id AS node_id, -id AS way_id, -id - 100000000000000000 AS rel_id, -id AS area_rel, id AS with_type FROM nodes""")
def id_mapping(spark, sf):
    """Ids in tables of one and of all kinds."""
    return D.nodes(spark, sf).select(M.map_id("n", "any").alias("node_id"), M.map_id("w", "any").alias("way_id"), M.map_id("r", "any").alias("rel_id"), M.map_id("r", "area").alias("area_rel"), M.map_id("r", "any", has_type=True).alias("with_type"))


# -- tags ----------------------------------------------------------------------------

@query("""SELECT id, brand, CAST(2 AS INT) AS left_over, starts_with(type, 'ECO') AS prefixed, ends_with(type, 'L') AS suffixed, CASE WHEN type IN ('ECONOMY', 'PROMO', 'LARGE') THEN type ELSE 'other' END AS checked,
least(greatest(size, 10), 40) AS clamped, string_agg(w, '|') AS words FROM (SELECT id, brand, type, size, unnest(list_filter(regexp_split_to_array(name, '[ #]'), lambda v: v <> '')) AS w FROM nodes) GROUP BY ALL""")
def p_tag_helpers(spark, sf):
    """Grabbing, cleaning, checking, clamping, splitting."""
    tags = F.col("tags")
    brand, rest = T.grab_tag(tags, "brand")
    kind = T.tag(tags, "type")
    return D.nodes(spark, sf).select("id", brand.alias("brand"), F.size(T.clean_tags(rest, ["na*", "*zzz", "x"])).alias("left_over"), T.has_prefix(kind, "ECO").alias("prefixed"), T.has_suffix(kind, "L").alias("suffixed"),
                                     T.check_values(kind, ["ECONOMY", "PROMO", "LARGE"], "other").alias("checked"), T.clamp(K.to_int(T.tag(tags, "size")), 10, 40).alias("clamped"), F.array_join(T.split_string(T.tag(tags, "name"), " #"), "|").alias("words"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 0 THEN 'ft' WHEN p_size % 4 = 1 THEN 'mi' ELSE 'm' END AS unit FROM part""", cte=False)
def p9_split_unit(spark, sf):
    """Numbers with units."""
    s = F.concat(F.col("p_size"), F.when(F.col("p_size") % 4 == 0, "ft").when(F.col("p_size") % 4 == 1, " mi").when(F.col("p_size") % 4 == 2, "").otherwise(".1.2 x"))
    return D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.split_unit(s, "m").alias("u")).select("id", "u.value", "u.unit")


@query("SELECT name, CAST(regexp_matches(name, '^.*a.c.*$') AS INT) AS a, CAST(regexp_matches(name, '^p.*$') AS INT) AS b, CAST(regexp_matches(name, '^.*[0-9]$') AS INT) + CAST(regexp_matches(name, '^.....$') AS INT) AS c FROM (SELECT DISTINCT p_name AS name FROM part)", cte=False)
def p12_wildcards(spark, sf):
    """* and ? over whole strings."""
    name = F.col("name")
    digit = F.lit(False)
    for d in "0123456789":
        digit = digit | T.wild_match("*" + d, name)
    return D.table(spark, sf, "part").selectExpr("p_name AS name").distinct().select("name", T.wild_match("*a?c*", name).cast("int").alias("a"), T.wild_match("p*", name).cast("int").alias("b"), (digit.cast("int") + T.wild_match("?????", name).cast("int")).alias("c"))


_ROAD = "CASE o_orderkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'secondary_link' WHEN 2 THEN 'residential' WHEN 3 THEN 'path' WHEN 4 THEN 'trunk' END"


@query(f"""SELECT o_orderkey AS id, 100 * (CAST(substr(o_orderpriority, 1, 1) AS INT) - 3) + CASE o_orderkey % 6 WHEN 0 THEN 39 WHEN 1 THEN 25 WHEN 2 THEN 33 WHEN 3 THEN 10 WHEN 4 THEN 38 ELSE 0 END
+ CASE WHEN o_orderkey % 7 = 0 THEN 35 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 100 WHEN o_orderstatus = 'O' THEN -100 ELSE 0 END AS z_order,
o_orderkey % 6 IN (0, 1, 4) OR o_orderkey % 7 = 0 AS road FROM orders WHERE {_ROAD} IS NOT NULL""", cte=False)
def p15_z_order(spark, sf):
    """Drawing order and roads."""
    o = D.table(spark, sf, "orders").where(f"{_ROAD} IS NOT NULL").selectExpr("o_orderkey AS id", f"""map('highway', {_ROAD}, 'layer', concat(CAST(substr(o_orderpriority, 1, 1) AS INT) - 3, 'x'),
      'railway', CASE WHEN o_orderkey % 7 = 0 THEN 'rail' ELSE '' END, 'bridge', CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END, 'tunnel', CASE WHEN o_orderstatus = 'O' THEN '1' ELSE 'x' END) AS tags""")
    return o.select("id", T.z_order(F.col("tags")).alias("z_order"), T.is_road(F.col("tags")).alias("road"))


_KIND = "CASE c_nationkey % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'boundary' WHEN 2 THEN 'multipolygon' ELSE 'site' END"


@query(f"""SELECT c_custkey AS id, {_KIND} <> 'site' AS keep, {_KIND} = 'boundary' OR {_KIND} = 'multipolygon' AND c_custkey % 3 = 0 AS boundary, {_KIND} = 'multipolygon' AND c_custkey % 3 <> 0 AS polygon,
CASE WHEN {_KIND} = 'route' THEN c_name END AS route_name, CASE WHEN c_custkey % 11 = 0 THEN 'own' WHEN {_KIND} = 'route' AND c_custkey % 2 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'alternate' WHEN 1 THEN 'connection' ELSE 'yes' END END AS lcn,
CASE WHEN {_KIND} = 'route' AND c_custkey % 2 = 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'alternate' WHEN 1 THEN 'connection' ELSE 'yes' END END AS ncn, CASE WHEN {_KIND} = 'route' AND c_custkey % 2 = 0 AND c_custkey % 13 > 0 THEN CAST(c_custkey AS VARCHAR) END AS lcn_ref,
CASE WHEN {_KIND} = 'route' THEN CASE WHEN c_custkey % 7 < 5 THEN CAST(c_custkey % 7 AS VARCHAR) ELSE '0' END END AS route_pref_color, CASE c_custkey % 5 WHEN 0 THEN 'alternate' WHEN 1 THEN 'connection' WHEN 2 THEN 'proposed' END AS state,
CASE c_custkey % 7 WHEN 6 THEN '22' ELSE CAST(c_custkey % 7 AS VARCHAR) END AS preferred_color FROM customer""", cte=False)
def p16_relation_tags(spark, sf):
    """What relations become; networks with their state, own keys that stay, colours."""
    c = D.table(spark, sf, "customer").selectExpr("c_custkey AS id", f"""map_filter(map('type', {_KIND}, 'name', c_name, 'network', if(c_custkey % 2 = 0, 'lcn', 'ncn'), 'boundary', if(c_custkey % 3 = 0, 'town', null),
      'state', CASE c_custkey % 5 WHEN 0 THEN 'alternate' WHEN 1 THEN 'connection' WHEN 2 THEN 'proposed' END, 'lcn', if(c_custkey % 11 = 0, 'own', null), 'ref', if(c_custkey % 13 > 0, CAST(c_custkey AS STRING), null),
      'preferred_color', if(c_custkey % 7 = 6, '22', CAST(c_custkey % 7 AS STRING))), (k, v) -> v IS NOT NULL) AS tags""")
    r = c.select("id", T.relation_tags(F.col("tags")).alias("r"))
    return r.select("id", "r.keep", "r.boundary", "r.polygon", *[T.tag(F.col("r.tags"), k).alias(k) for k in ("route_name", "lcn", "ncn", "lcn_ref", "route_pref_color", "state", "preferred_color")])


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CAST(sum(CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity AS INT) WHEN 1 THEN (CAST(l_quantity AS INT) + CAST(l_suppkey AS INT) + 1) // 2 END) AS BIGINT) AS total,
round(sum(CASE l_linenumber % 3 WHEN 0 THEN CAST(l_quantity AS INT) + 5e-1 WHEN 1 THEN CAST(l_quantity AS INT) * 3048e-4 END), 6) AS metres FROM lineitem GROUP BY ALL""", cte=False)
def p19_legacy_numbers(spark, sf):
    """Ranges, feet, decimal commas."""
    q = F.col("l_quantity").cast("int")
    i = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" m"))).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit("-"), F.col("l_suppkey") + 1)).otherwise("x12")
    r = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(",5"))).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(" ft"))).otherwise("none")
    return D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).agg(F.sum(K.legacy_int(i).cast("long")).alias("total"), r6(F.sum(K.legacy_real(r))).alias("metres"))


@query("SELECT id, CASE WHEN size > 25 THEN 3 ELSE 4 END AS n, 'name' AS first_key, concat('\"name\"=>\"', name, '\",\"type\"=>\"', type, '\"') AS stored FROM nodes")
def p21_hstore(spark, sf):
    """Which tags the tags column takes, and its text."""
    n = D.nodes(spark, sf).withColumn("big", K.to_int(T.tag(F.col("tags"), "size")) > 25)
    norm = T.hstore(F.col("tags"), "norm", ["brand", "size"])
    return n.select("id", F.size(F.when(F.col("big"), T.hstore(F.col("tags"), "norm", ["brand"])).otherwise(T.hstore(F.col("tags"), "all", []))).alias("n"), F.array_min(F.map_keys(norm)).alias("first_key"), T.hstore_text(norm).alias("stored"))


@query("""SELECT k, CASE WHEN k % 5 = 0 THEN true WHEN k % 5 = 1 THEN false END AS b, CASE WHEN k % 5 = 2 AND k * 10 BETWEEN -32768 AND 32767 THEN CAST(k * 10 AS SMALLINT) WHEN k % 5 = 3 THEN CAST(-1 AS SMALLINT) END AS i2,
CASE WHEN k % 5 = 2 THEN CAST(k * 10 AS INT) WHEN k % 5 = 3 THEN -1 END AS i4, CASE WHEN k % 5 = 3 THEN CAST(-1 AS SMALLINT) WHEN k % 5 = 0 THEN CAST(1 AS SMALLINT) WHEN k % 5 = 1 THEN CAST(0 AS SMALLINT) END AS dir,
CASE WHEN k % 5 = 2 THEN CAST(k * 10 AS DOUBLE) WHEN k % 5 = 3 THEN -1e0 WHEN k % 5 = 4 THEN 26e0 END AS re FROM (SELECT p_partkey AS k FROM part)""", cte=False)
def p23_typed_columns(spark, sf):
    """Strings into booleans, integers, reals and directions."""
    s = F.when(F.col("k") % 5 == 0, "yes").when(F.col("k") % 5 == 1, "no").when(F.col("k") % 5 == 2, F.concat(F.lit(" "), F.col("k") * 10)).when(F.col("k") % 5 == 3, "-1").otherwise("0x1a")
    return D.table(spark, sf, "part").selectExpr("p_partkey AS k").select("k", K.coerce(s, "bool").alias("b"), K.coerce(s, "int2").alias("i2"), K.coerce(s, "integer").alias("i4"), K.coerce(s, "direction").alias("dir"), K.coerce(s, "double").alias("re"))


@query("SELECT CAST(count(*) FILTER (size > 10 AND id % 3 > 0) AS BIGINT) AS accepted, CAST(count(*) FILTER (size <= 10 OR id % 3 = 0) AS BIGINT) AS rejected, CAST(count(*) FILTER (size <= 10) AS BIGINT) AS by_first FROM nodes")
def p24_not_null(spark, sf):
    """Rows rejected for a null, and the column at fault."""
    rows = D.nodes(spark, sf).select("id", F.when(K.to_int(T.tag(F.col("tags"), "size")) > 10, 1).alias("a"), F.when(F.col("id") % 3 > 0, 1).alias("b"))
    good, bad = K.accepted_rejected(rows, ["a", "b"])
    return good.agg(F.count("*").alias("accepted")).join(bad.agg(F.count("*").alias("rejected"), F.count_if(F.col("rejected_column") == "a").alias("by_first")), F.lit(True))


@query("SELECT id, CAST(6 AS INT) AS n, CAST(id AS VARCHAR) AS osm_uid FROM nodes")
def p26_attributes(spark, sf):
    """Attributes as pseudo tags."""
    t = T.with_attributes(F.col("tags"), {"uid": F.col("id"), "user": F.lit("u"), "version": F.lit(None).cast("int")})
    return D.nodes(spark, sf).select("id", F.size(t).alias("n"), T.tag(t, "osm_uid").alias("osm_uid"))


@query("""SELECT CAST(floor(value) AS INT) AS s, CASE WHEN value * 60 < 60 THEN concat(CAST(floor(value * 60) AS BIGINT), 's') WHEN value * 60 < 3600 THEN concat(CAST(floor(value * 60) AS BIGINT), 's (', CAST(floor(value * 60) AS BIGINT) // 60, 'm ', CAST(floor(value * 60) AS BIGINT) % 60, 's)')
ELSE concat(CAST(floor(value * 60) AS BIGINT), 's (', CAST(floor(value * 60) AS BIGINT) // 3600, 'h ', CAST(floor(value * 60) AS BIGINT) % 3600 // 60, 'm ', CAST(floor(value * 60) AS BIGINT) % 60, 's)') END AS d, event_id FROM events WHERE value >= 0""", cte=False)
def h5_duration(spark, sf):
    """H5: durations for people."""
    return D.table(spark, sf, "events").where("value >= 0").select(F.expr("CAST(floor(value) AS INT)").alias("s"), T.duration(F.floor(F.col("value") * 60)).alias("d"), "event_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events", cte=False)
def h6_iso_time(spark, sf):
    """H6: times as ISO text."""
    return D.table(spark, sf, "events").select("event_id", T.iso_time(F.expr("unix_timestamp(CAST(ts AS timestamp))")).alias("t"))


@query("""SELECT event_id, CASE WHEN s >= 604800 THEN concat(s // 604800, ' week(s) ') ELSE '' END || CASE WHEN s >= 86400 THEN concat(s // 86400 % 7, ' day(s) ') ELSE '' END || CASE WHEN s >= 3600 THEN concat(s // 3600 % 24, ' hour(s) ') ELSE '' END
|| CASE WHEN s >= 60 THEN concat(s // 60 % 60, ' minute(s) ') ELSE '' END || concat(s % 60, ' second(s)') AS d FROM (SELECT event_id, CAST(event_id AS BIGINT) * CAST(event_id AS BIGINT) * 61 % 2000000 AS s FROM events)""", cte=False)
def h7_pretty_delta(spark, sf):
    """H7: time differences, with inner units that are zero."""
    return D.table(spark, sf, "events").select("event_id", T.pretty_delta(F.expr("CAST(event_id AS BIGINT) * CAST(event_id AS BIGINT) * 61 % 2000000")).alias("d"))


@query("SELECT id, brand, CAST(size AS VARCHAR) AS size, 'brand,name,size,type' AS keys FROM nodes")
def h2_parse_tags(spark, sf):
    """H2: tags written as JSON and parsed, with their keys in order."""
    t = T.parse_tags(F.to_json("tags"))
    return D.nodes(spark, sf).select("id", T.tag(t, "brand").alias("brand"), T.tag(t, "size").alias("size"), F.array_join(F.map_keys(t), ",").alias("keys"))


@query("SELECT rel_id, count(*) AS n, CAST(sum(ref) AS BIGINT) AS refs, count(DISTINCT role) AS roles, arg_max(type, pos) AS last_type FROM members GROUP BY rel_id")
def h2_parse_members(spark, sf):
    """H2: members written as JSON and parsed, in order."""
    one = F.struct("pos", F.struct(F.upper("type").alias("type"), "ref", "role").alias("m"))
    rel = D.members(spark, sf).groupBy("rel_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda v: v["m"])).alias("j")).withColumn("m", T.parse_members(F.col("j")))
    return rel.select("rel_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0).cast("long"), lambda a, v: a + v["ref"]).alias("refs"), F.size(F.array_distinct(F.transform("m", lambda v: v["role"]))).cast("long").alias("roles"), F.element_at("m", -1)["type"].alias("last_type"))


@query("SELECT id, lon, lat, brand FROM nodes WHERE id IN (1, 7, 12, 100, 150, 1999, 123456789)")
def j3_lookup(spark, sf):
    """Single objects by id; those that aren't there give none."""
    return R.lookup(D.nodes(spark, sf), [1, 7, 12, 100, 150, 1999, 123456789]).select("id", "lon", "lat", T.tag(F.col("tags"), "brand").alias("brand"))


# -- files -------------------------------------------------------------------------

_READ = "SELECT id, CAST(round(lon * 1e7) AS INT) AS x, CAST(round(lat * 1e7) AS INT) AS y, brand, name FROM nodes"


def _read_back(nodes):
    return nodes.select("id", "x", "y", T.tag(F.col("tags"), "brand").alias("brand"), T.tag(F.col("tags"), "name").alias("name"))


@query(_READ)
def s4_opl(spark, sf):
    """Nodes written as lines and read back, escapes and compression included."""
    from ..sources import textfiles

    n, path = D.nodes(spark, sf), W.scratch(spark, "opl")
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "%", "%25%"), " ", "%20%")
    line = F.concat(F.lit("n"), "id", F.lit(" v1 dV c1 t2020-01-01T00:00:00Z i3 ua Tbrand="), esc(T.tag(F.col("tags"), "brand")), F.lit(",name="), esc(T.tag(F.col("tags"), "name")), F.lit(" x"), F.col("lon"), F.lit(" y"), F.col("lat"))
    n.select(line).write.option("compression", "gzip").text(path)
    return _read_back(textfiles.read_opl(spark, path)[0])


@query(_READ)
def s1_xml(spark, sf):
    """Nodes written as XML, compressed, and read back."""
    from ..sources import textfiles

    n, path = D.nodes(spark, sf), W.scratch(spark, "xml")
    tag = lambda k: F.struct(F.lit(k).alias("_k"), T.tag(F.col("tags"), k).alias("_v"))
    rows = n.select(F.col("id").alias("_id"), F.lit(1).alias("_version"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.array(tag("brand"), tag("name")).alias("tag"))
    rows.write.format("xml").option("rowTag", "node").option("rootTag", "osm").option("compression", "bzip2").save(path)
    return _read_back(textfiles.read_xml(spark, path)[0])


@query("SELECT way_id AS id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY pos) AS refs FROM edges GROUP BY way_id")
def s1_xml_ways(spark, sf):
    """Ways written as XML and read back, references in order."""
    from ..sources import textfiles

    path = W.scratch(spark, "xml-ways")
    rows = D.ways(spark, sf).where("size(nodes) > 0").select(F.col("id").alias("_id"), F.lit(1).alias("_version"), F.transform("nodes", lambda r: F.struct(r.alias("_ref"))).alias("nd"))
    rows.write.format("xml").option("rowTag", "way").option("rootTag", "osm").save(path)
    return textfiles.read_xml(spark, path)[1].select("id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("refs"))


@query("SELECT DISTINCT CAST(8 AS INT) AS zoom, x, y FROM (SELECT CAST(floor(256 * (0.5 + 6378137 * radians(lon) / 40075016.68)) AS INT) AS x, CAST(floor(256 * (0.5 - 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) / 40075016.68)) AS INT) AS y FROM nodes)")
def s16_tile_file(spark, sf):
    """A tile list written and read back; lines that are no tiles come apart."""
    from ..sources import textfiles

    path = W.scratch(spark, "tiles")
    good = W.tile_lines(_node_tiles(spark, sf).select(F.lit(8).alias("zoom"), "x", "y").distinct())
    good.unionByName(spark.createDataFrame([("no tile",), ("8/999/3",), ("",)], "value string")).write.text(path)
    return textfiles.read_tiles(spark, path)[0].select("zoom", "x", "y")


# -- measures -----------------------------------------------------------------------

@query("""SELECT id, round(abs(sum(xa * yb - xb * ya)) / 2, 6) AS area, round(sum((xa + xb) * (xa * yb - xb * ya)) / (3 * sum(xa * yb - xb * ya)), 6) + 0e0 AS cx, round(sum((ya + yb) * (xa * yb - xb * ya)) / (3 * sum(xa * yb - xb * ya)), 6) + 0e0 AS cy,
round(sum(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))), 6) AS perimeter FROM seg GROUP BY id HAVING abs(sum(xa * yb - xb * ya)) > 1e-9""")
def f1_area_centroid(spark, sf):
    """F1, F3, F5 in Catalyst: areas, lengths, centroids of rings."""
    s = D.stars(spark, sf).where(C.area(F.col("ring")) * 2 > 1e-9)
    c = C.ring_centroid(F.col("ring"))
    return s.select("id", r6(C.area(F.col("ring"))).alias("area"), r6(c["x"]).alias("cx"), r6(c["y"]).alias("cy"), r6(C.length(F.col("ring"))).alias("perimeter"))


@query("""SELECT id, 'POLYGON' AS kind, round(abs(sum(xa * yb - xb * ya)) / 2, 6) AS area, CAST(count(*) + 1 AS INT) AS n, true AS valid FROM seg GROUP BY id, n HAVING n >= 4""")
def g4_polygons(spark, sf):
    """Rings assembled to polygons, through EWKB."""
    s = D.stars(spark, sf).where("size(ring) >= 5").withColumn("geom", st.as_polygon("ring")).where("geom IS NOT NULL")
    return s.select("id", st.geometry_type("geom").alias("kind"), r6(st.area("geom")).alias("area"), st.n_points("geom").alias("n"), st.is_valid("geom").alias("valid"))


@query("""SELECT id, round(6378137 * radians(lon), 3) + 0e0 AS mx, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) + 0e0 AS my FROM nodes""")
def f18_mercator(spark, sf):
    """to the web map's projection."""
    return D.nodes(spark, sf).select("id", (F.round(C.mercator_x(F.col("lon")), 3) + F.lit(0.0)).alias("mx"), (F.round(C.mercator_y(F.col("lat")), 3) + F.lit(0.0)).alias("my"))


@query("""SELECT a.way_id, round(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)), 6) AS dist, round(a.lon + 0.25 * (b.lon - a.lon), 6) + 0e0 AS ix, round(a.lat + 0.25 * (b.lat - a.lat), 6) + 0e0 AS iy
FROM (SELECT way_id, arg_min({'lon': lon, 'lat': lat}, k) AS f, arg_max({'lon': lon, 'lat': lat}, k) AS l FROM pts GROUP BY way_id HAVING count(*) >= 2) q, LATERAL (SELECT q.way_id, q.f.lon, q.f.lat) a(way_id, lon, lat), LATERAL (SELECT q.l.lon, q.l.lat) b(lon, lat)""")
def f22_distance(spark, sf):
    """Distance and interpolation between a line's ends; the last point by number and by reversal."""
    line = F.col("line")
    a, b = C.point_n(line, 1), C.point_n(F.reverse(line), 1)
    p = C.interpolate(a, b, 0.25)
    return _lines(spark, sf).select("way_id", r6(C.distance(a, C.point_n(line, -1))).alias("dist"), r6(p["x"]).alias("ix"), r6(p["y"]).alias("iy"))


@query("SELECT way_id, 'LINESTRING' AS kind, CAST(n AS INT) AS n, round(len, 6) AS length, round(len, 6) AS reversed, round(len, 6) AS cut, CAST(4326 AS INT) AS srid FROM lines")
def f15_segmentize(spark, sf):
    """Cutting and reversing keep lengths."""
    l = _lines(spark, sf).withColumn("geom", st.as_linestring("line"))
    return l.select("way_id", st.geometry_type("geom").alias("kind"), st.n_points("geom").alias("n"), r6(st.length("geom")).alias("length"), r6(st.length(st.reverse("geom"))).alias("reversed"), r6(st.length(st.segmentize("geom", 25.0))).alias("cut"), st.srid("geom").alias("srid"))


@query()
def f16_simplify(spark, sf):
    """F16: simplified lines."""
    l = _lines(spark, sf).withColumn("geom", st.as_linestring("line"))
    return l.select("way_id", st.n_points(st.simplify("geom", 20.0)).alias("n"))


@query()
def f4_ellipsoid(spark, sf):
    """lengths and areas on the ellipsoid."""
    s = D.stars(spark, sf).withColumn("geom", st.as_polygon("ring")).where("geom IS NOT NULL")
    return s.select("id", F.round(st.spherical_area("geom"), 0).alias("area"), F.round(st.spherical_length(st.as_linestring("ring")), 3).alias("length"))


@query()
def f17_pole(spark, sf):
    """poles of inaccessibility."""
    return R.way_polygons(D.stars(spark, sf)).select("id", F.hex(st.pole_of_inaccessibility("geom")).alias("pole"))


@query()
def f14_line_merge(spark, sf):
    """members' lines merged, and their parts."""
    nodes = D.nodes(spark, sf)
    pts = R.locate(D.edges(spark, sf), nodes)
    m = R.members(D.members(spark, sf), nodes, pts, "w")
    g = m.withColumn("geom", st.as_multilinestring(F.transform("members", lambda v: v["pts"]))).where("geom IS NOT NULL")
    return g.select("rel_id", st.num_geometries(st.line_merge("geom")).alias("n"), F.size(st.split_multi("geom")).alias("parts"), r6(st.length("geom")).alias("length"))


@query()
def g7_relation_geometries(spark, sf):
    """Points, multipoints, multipolygons and collections of relations."""
    nodes = D.nodes(spark, sf)
    pts = R.locate(D.edges(spark, sf), nodes)
    m = R.members(D.members(spark, sf), nodes, pts)
    of = lambda t: F.transform(F.filter("members", lambda v: v["type"] == t), lambda v: v["pts"])
    return m.select("rel_id", st.geometry_type(st.as_multipoint(F.flatten(of("n")))).alias("points"), st.geometry_type(st.as_multipolygon(of("w"))).alias("areas"), st.num_geometries(st.as_geometrycollection(F.transform("members", lambda v: v["pts"]))).alias("n"))


# -- tiles -----------------------------------------------------------------------------

_TILE = "CAST(floor(256 * (0.5 + 6378137 * radians(lon) / 40075016.68)) AS INT) AS x, CAST(floor(256 * (0.5 - 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) / 40075016.68)) AS INT) AS y"


def _node_tiles(spark, sf, buffer=0.0):
    return D.nodes(spark, sf).select("id", F.explode(E.point_tiles(C.mercator_x(F.col("lon")), C.mercator_y(F.col("lat")), 8, buffer)).alias("t")).select("id", "t.x", "t.y")


@query(f"""SELECT DISTINCT x, y, CAST(list_sum(list_transform(range(8), lambda b: (((x >> b) & 1) << (2 * b)) + (((y >> b) & 1) << (2 * b + 1)))) AS BIGINT) AS quadkey FROM (SELECT {_TILE} FROM nodes)""")
def e1_point_tiles(spark, sf):
    """Tiles of points, distinct, by quadkey."""
    return E.by_quadkey(_node_tiles(spark, sf).select("x", "y").distinct()).select("x", "y", "quadkey")


@query(f"SELECT DISTINCT CAST(z AS INT) AS zoom, CAST(x >> (8 - z) AS INT) AS x, CAST(y >> (8 - z) AS INT) AS y FROM (SELECT {_TILE} FROM nodes), (SELECT unnest(range(3, 9)) AS z)")
def a8_roll_up(spark, sf):
    """The parents of tiles at each zoom."""
    return E.roll_up(_node_tiles(spark, sf), 3, 8)


@query(f"""SELECT x, y FROM (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM (SELECT DISTINCT way_id, {_TILE} FROM edges JOIN nodes ON ref = id)) WHERE n <= 3 GROUP BY x, y""")
def a9_tile_limit(spark, sf):
    """Changes with too many tiles are dropped whole."""
    t = D.edges(spark, sf).join(_node_tiles(spark, sf).withColumnRenamed("id", "ref"), "ref").select("way_id", "x", "y").distinct()
    return E.limit_tiles(t, "way_id", 3).select("x", "y").distinct()


@query(f"""SELECT zoom, x, y, CASE WHEN old THEN '2020' ELSE '2021' END AS first, CASE WHEN new THEN '2021' ELSE '2020' END AS last FROM (SELECT CAST(8 AS INT) AS zoom, x, y, bool_or(id % 2 = 0) AS old, bool_or(id % 3 = 0) AS new
FROM (SELECT id, {_TILE} FROM nodes) GROUP BY x, y) WHERE old OR new""")
def k8_expire_table(spark, sf):
    """K8: first and last times of expired tiles."""
    t = _node_tiles(spark, sf).withColumn("zoom", F.lit(8))
    empty = spark.createDataFrame([], "zoom int, x int, y int, first string, last string")
    old = W.upsert_tiles(empty, t.where("id % 2 = 0"), F.lit("2020"))
    return W.upsert_tiles(old, t.where("id % 3 = 0"), F.lit("2021"))


@query(f"SELECT DISTINCT concat(8, '/', x, '/', y) AS value FROM (SELECT {_TILE} FROM nodes)")
def k7_tile_file(spark, sf):
    """K7: tiles as lines."""
    return W.tile_lines(_node_tiles(spark, sf).select(F.lit(8).alias("zoom"), "x", "y").distinct())


@query(f"SELECT x, y, round((x + 0.5) * 156543.0339 - 20037508.34, 2) AS cx FROM (SELECT DISTINCT {_TILE} FROM nodes)".replace("156543.0339", "(40075016.68 / 256)"))
def h11_tile_boxes(spark, sf):
    """Boxes of tiles; their middle."""
    b = C.tile_box(F.col("x"), F.col("y"), F.lit(8))
    return _node_tiles(spark, sf).select("x", "y").distinct().select("x", "y", F.round((b["x0"] + b["x1"]) / 2, 2).alias("cx"))


def _mercator_line(spark, sf):
    return _lines(spark, sf).select("way_id", F.transform("line", lambda p: F.struct(C.mercator_x(p["x"]).alias("x"), C.mercator_y(p["y"]).alias("y"))).alias("line"))


@query()
def e2_line_tiles(spark, sf):
    """Tiles along lines."""
    return E.line_tile_rows(_mercator_line(spark, sf), "way_id", "line", 6)


@query()
def e4_area_tiles(spark, sf):
    """Tiles of areas, boundary and inside."""
    s = D.stars(spark, sf).withColumn("geom", st.as_polygon("ring")).where("geom IS NOT NULL")
    return s.select("id", F.explode(E.geometry_tiles(st.transform("geom", 3857), 12)).alias("t")).select("id", "t.x", "t.y")


@query("""SELECT way_id, xa, ya, xb, yb FROM (SELECT way_id, xa, ya, xb, yb, bool_or(o) AS o, bool_or(n) AS n FROM (
SELECT way_id, least(p.ref, q.ref) AS xa, CAST(0 AS BIGINT) AS ya, greatest(p.ref, q.ref) AS xb, CAST(0 AS BIGINT) AS yb, p.pos % 3 > 0 AS o, p.pos % 2 = 0 AS n FROM edges p JOIN edges q USING (way_id) WHERE q.pos = p.pos + 1) WHERE o OR n GROUP BY ALL) s
WHERE o <> n AND way_id IN (SELECT way_id FROM edges p JOIN edges q USING (way_id) WHERE q.pos = p.pos + 1 AND p.pos % 3 > 0) AND way_id IN (SELECT way_id FROM edges p JOIN edges q USING (way_id) WHERE q.pos = p.pos + 1 AND p.pos % 2 = 0)""")
def u2_changed_segments(spark, sf):
    """Segments in only one of two versions of a line."""
    e = D.edges(spark, sf)
    s = e.alias("p").join(e.alias("q"), F.expr("p.way_id = q.way_id AND q.pos = p.pos + 1")).selectExpr("p.way_id", "p.pos", "least(p.ref, q.ref) AS xa", "CAST(0 AS BIGINT) AS ya", "greatest(p.ref, q.ref) AS xb", "CAST(0 AS BIGINT) AS yb")
    return E.changed_parts(s.where("pos % 3 > 0"), s.where("pos % 2 = 0"), ["way_id"], ["xa", "ya", "xb", "yb"])


# -- generalisation ------------------------------------------------------------------------

@query(""", r AS (SELECT s_suppkey AS id, CAST(((s_suppkey * 7919) % 3400 - 1700) / 1e1 AS FLOAT) AS x, CAST(((s_suppkey * 104729) % 1600 - 800) / 1e1 AS FLOAT) AS y, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS INT) AS irank FROM supplier WHERE s_acctbal > 0),
dd AS (SELECT a.id, a.irank, sqrt(min(CAST(a.x - b.x AS DOUBLE) * CAST(a.x - b.x AS DOUBLE) + CAST(a.y - b.y AS DOUBLE) * CAST(a.y - b.y AS DOUBLE))) AS d FROM r a LEFT JOIN r b ON b.irank < a.irank GROUP BY a.id, a.irank),
di AS (SELECT id, irank, coalesce(d, (SELECT d FROM dd WHERE irank = 1) + 1) AS di FROM dd) SELECT id, irank, round(di, 6) AS discr_iso, CAST(row_number() OVER (ORDER BY di DESC, id) - 1 AS INT) AS dirank FROM di""")
def n5_discrete_isolation(spark, sf):
    """Ranks by importance and by isolation."""
    s = D.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "((s_suppkey * 7919) % 3400 - 1700) / 10D AS x", "((s_suppkey * 104729) % 1600 - 800) / 10D AS y", "s_acctbal AS importance")
    return G.discrete_isolation(s).select("id", "irank", r6(F.col("discr_iso")).alias("discr_iso"), "dirank")


_AREAS = "x0, y0, x1 - (n_nationkey % 3) * 4 AS x1, y1"


@query(f""", ar AS (SELECT k, x0, y0, x1, y1, CASE WHEN k % 5 = 4 THEN least(x1 - x0, y1 - y0) ELSE k % 5 + 1 END AS width FROM (SELECT n_nationkey AS k, {_AREAS} FROM nation JOIN regions ON n_name = name)),
sg AS (SELECT way_id, len, plon, plat, lon - plon AS dx, lat - plat AS dy, sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat)) AS sz, sum(sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat))) OVER (PARTITION BY way_id ORDER BY pts.k) AS e
  FROM pts JOIN lines USING (way_id) WHERE plon IS NOT NULL AND n > 2 AND len % 7 >= 2),
cl AS (SELECT way_id, ar.k AS ar, width, len, sz, e, greatest(0e0, CASE WHEN dx > 0 THEN (x0 - plon) / dx WHEN dx < 0 THEN (x1 - plon) / dx ELSE 0e0 END, CASE WHEN dy > 0 THEN (y0 - plat) / dy WHEN dy < 0 THEN (y1 - plat) / dy ELSE 0e0 END) AS lo,
  least(1e0, CASE WHEN dx > 0 THEN (x1 - plon) / dx WHEN dx < 0 THEN (x0 - plon) / dx ELSE 1e0 END, CASE WHEN dy > 0 THEN (y1 - plat) / dy WHEN dy < 0 THEN (y0 - plat) / dy ELSE 1e0 END) AS hi
  FROM sg JOIN ar ON (dx <> 0 OR plon BETWEEN x0 AND x1) AND (dy <> 0 OR plat BETWEEN y0 AND y1)),
sp1 AS (SELECT way_id, ar, width, len, e - sz + lo * sz AS a, e - sz + hi * sz AS b FROM cl WHERE lo <= hi + 1e-9),
sp2 AS (SELECT *, max(b) OVER (PARTITION BY way_id, ar ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM sp1),
sp3 AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb + len * 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY way_id, ar ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM sp2),
sp4 AS (SELECT way_id, ar, width, len, min(a) AS a, max(b) AS b FROM sp3 GROUP BY way_id, ar, width, len, g),
own AS (SELECT way_id, len, ar, CASE WHEN NOT bool_or(b - a <= len * 1e-9) THEN sum(b - a) * any_value(width) END AS s FROM sp4 GROUP BY way_id, len, ar),
cov AS (SELECT way_id FROM (SELECT way_id, len, a, b, max(b) OVER (PARTITION BY way_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM sp4) GROUP BY way_id, len HAVING min(a) <= len * 1e-9 AND max(b) >= len * (1 - 1e-9) AND NOT coalesce(bool_or(a > pb + len * 1e-9), false)),
wide AS (SELECT way_id, sum(s) / len AS w FROM own WHERE way_id IN (SELECT way_id FROM cov) GROUP BY way_id, len)
SELECT way_id, round(CASE WHEN len % 7 < 2 THEN len % 7 ELSE w END, 6) AS width FROM lines LEFT JOIN wide USING (way_id)""")
def j13_river_widths(spark, sf):
    """Widths of lines that areas cover, by the length within each; areas without a width have their inscribed circle's."""
    l = _lines(spark, sf).select("way_id", st.as_linestring("line").alias("geom"), (C.length(F.col("line")) % 7).alias("w")).select("way_id", "geom", F.when(F.col("w") < 2, F.col("w")).alias("width"))
    box = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    a = D.regions(spark, sf).join(D.table(spark, sf, "nation").selectExpr("n_name AS name", "n_nationkey"), "name").selectExpr("n_nationkey", "CASE WHEN n_nationkey % 5 < 4 THEN CAST(n_nationkey % 5 + 1 AS DOUBLE) END AS width", "x0", "y0", "CAST(x1 - (n_nationkey % 3) * 4 AS DOUBLE) AS x1", "y1")
    return G.river_widths(l, a.select(F.col("n_nationkey").alias("area_id"), "width", st.as_polygon(box).alias("geom")), 60.0).select("way_id", r6(F.col("width")).alias("width"))


@query("""SELECT a, count(*) AS degree FROM (SELECT p.ref AS a FROM edges p JOIN edges q USING (way_id) WHERE q.pos = p.pos + 1 AND p.ref <> q.ref UNION ALL SELECT q.ref FROM edges p JOIN edges q USING (way_id) WHERE q.pos = p.pos + 1 AND p.ref <> q.ref) GROUP BY a""")
def n4_river_degrees(spark, sf):
    """The graph of segments and how many meet at each point."""
    w = D.ways(spark, sf).select(F.col("id").alias("way_id"), F.lit(1.0).alias("width"), F.transform("nodes", lambda n: F.struct(n.cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("pts"))
    e = G.river_edges(w)
    return e.select(F.explode(F.array(F.col("a.x").cast("long"), F.col("b.x").cast("long"))).alias("a")).groupBy("a").agg(F.count("*").alias("degree"))


def _store(spark, name):
    """Writes tables below a new path of the shared folder and reads them back."""
    path = W.scratch(spark, name)

    def store(df, k):
        df.write.parquet(f"{path}/{k}")
        return spark.read.schema(df.schema).parquet(f"{path}/{k}")

    return store


@query(f"""WITH RECURSIVE {D.CTE}, rl AS (SELECT way_id, way_id * 100 + pos AS a, coalesce(lead(way_id * 100 + pos) OVER (PARTITION BY way_id ORDER BY pos), way_id // 3 * 100) AS b, CAST(way_id * 37 % 11 AS DOUBLE) AS width FROM edges),
through AS (SELECT p FROM (SELECT a AS p, 1 AS o FROM rl UNION ALL SELECT b, 0 FROM rl) GROUP BY p HAVING count(*) = 2 AND sum(o) = 1),
walk AS (SELECT way_id, a AS f, b AS t, width, 2 AS n FROM rl WHERE a NOT IN (SELECT p FROM through) UNION ALL SELECT w.way_id, w.f, rl.b, greatest(w.width, rl.width), w.n + 1 FROM walk w JOIN rl ON rl.a = w.t WHERE w.t IN (SELECT p FROM through)),
chain AS (SELECT way_id, f, max_by(t, n) AS t, max(width) AS width, max(n) AS n FROM walk GROUP BY way_id, f),
flow AS (SELECT f, t, width FROM chain UNION ALL SELECT c.f, c.t, flow.width FROM flow JOIN chain c ON c.f = flow.t)
SELECT way_id, f AS "from", c.t AS "to", CAST(n AS INT) AS n_points, (SELECT max(width) FROM flow WHERE flow.f = c.f) AS width FROM chain c""", cte=False)
def n4_river_chains(spark, sf):
    """Ways that flow into the way of a third of their number: segments joined to chains where none meet, widths carried downstream."""
    last = F.struct((F.floor(F.col("id") / 3) * 100).cast("double").alias("x"), F.lit(0.0).alias("y"))
    w = D.ways(spark, sf).where("size(nodes) > 0").select(F.col("id").alias("way_id"), F.expr("CAST(id * 37 % 11 AS DOUBLE)").alias("width"), F.concat(F.transform("nodes", lambda n, k: F.struct((F.col("id") * 100 + k).cast("double").alias("x"), F.lit(0.0).alias("y"))), F.array(last)).alias("pts"))
    end = lambda k: F.element_at("pts", k)["x"].cast("long")
    return G.rivers(w, _store(spark, "rivers")).select("way_id", end(1).alias("from"), end(-1).alias("to"), F.size("pts").alias("n_points"), "width")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS f, l_suppkey + 1 + l_linenumber % 2 AS t FROM lineitem), w AS (SELECT f, t, max(CAST((f * 37) % 11 AS DOUBLE)) AS width FROM e GROUP BY f, t),
p AS (SELECT f, t, width FROM w UNION SELECT w.f, w.t, p.width FROM p JOIN w ON w.f = p.t WHERE p.width > w.width) SELECT f AS "from", t AS "to", max(width) AS width FROM p GROUP BY f, t""", cte=False)
def n4_river_propagation(spark, sf):
    """Widths carried downstream."""
    e = D.table(spark, sf, "lineitem").selectExpr("l_suppkey AS `from`", "l_suppkey + 1 + l_linenumber % 2 AS `to`").distinct().withColumn("width", F.expr("CAST((`from` * 37) % 11 AS DOUBLE)"))
    return G.propagate_width(e, _store(spark, "rivers"))


def _area_tiles(spark, sf):
    s = R.way_polygons(D.stars(spark, sf)).withColumn("geom", st.transform("geom", 3857)).withColumn("b", st.bbox("geom"))
    return X.tile_join(s.select("id", "geom", F.expr("CAST(id % 2 AS STRING)").alias("grp"), F.expr("CAST(id % 3 AS STRING)").alias("layer"), "b.*"), 10)


@query()
def n2_raster_union(spark, sf):
    """Areas drawn, closed and traced by tile and group."""
    return G.raster_union(_area_tiles(spark, sf), 10).select("tx", "ty", "grp", F.round("area", 0).alias("area"))


@query()
def n3_builtup(spark, sf):
    """Layers drawn apart and joined."""
    return G.raster_union(_area_tiles(spark, sf).withColumn("grp", F.lit("")), 10, builtup=True, least=4).select("tx", "ty", F.round("area", 0).alias("area"))


@query()
def n1_vector_union(spark, sf):
    """Unions on a fine canvas."""
    return G.vector_union(_area_tiles(spark, sf), 10).select("tx", "ty", "grp", F.round("area", 0).alias("area"))


@query(f"SELECT x AS tx, y AS ty, count(*) AS n FROM (SELECT {_TILE} FROM nodes) GROUP BY x, y")
def n6_tile_sql(spark, sf):
    """One query for all tiles."""
    t = _node_tiles(spark, sf)
    t.createOrReplaceTempView("tiled_nodes")
    tiles = t.select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    return G.tile_sql(spark, "SELECT tx, ty, count(*) AS n FROM {tiles} JOIN tiled_nodes ON x = tx AND y = ty GROUP BY tx, ty", tiles, 8)


@query(f"SELECT x AS tx, y AS ty FROM (SELECT x, y, min(id) AS f FROM (SELECT id, {_TILE} FROM nodes) GROUP BY x, y) ORDER BY f, x, y LIMIT 40")
def n8_tile_batch(spark, sf):
    """The next tiles, oldest first."""
    d = _node_tiles(spark, sf).groupBy("x", "y").agg(F.min("id").alias("first")).withColumn("zoom", F.lit(8))
    return G.tile_batch(d, 8, 40)


@query(f"SELECT x, y, CASE WHEN x % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM (SELECT DISTINCT {_TILE} FROM nodes)")
def n9_replace_tiles(spark, sf):
    """A tile table with some tiles made anew."""
    t = _node_tiles(spark, sf).select("x", "y").distinct()
    some = t.where("x % 3 = 0")
    return G.replace_tiles(t.withColumn("v", F.lit("old")), some.selectExpr("x AS tx", "y AS ty"), some.withColumn("v", F.lit("new")))


# -- changes -----------------------------------------------------------------------------------

@query("""SELECT id, kind, value FROM (SELECT id, kind, value, visible FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM changes) WHERE k = 1) WHERE visible""")
def c1_apply_changes(spark, sf):
    """A table after two batches of changes."""
    c = D.changes(spark, sf).drop("version").withColumnRenamed("seq", "version")
    empty = spark.createDataFrame([], "id long, kind string, value double")
    half = c.select(F.expr("percentile_approx(version, 0.5)")).first()[0]
    first = CH.apply_objects(empty, c.where(F.col("version") < half))
    return CH.apply_objects(first, c.where(F.col("version") >= half))


@query(f"SELECT DISTINCT id, x, y FROM (SELECT id, {_TILE} FROM nodes) WHERE id % 7 = 0")
def e10_deleted_tiles(spark, sf):
    """Tiles of the geometries that deleted objects had."""
    n = D.nodes(spark, sf).select("id", st.transform(st.as_point(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))), 3857).alias("geom"))
    return E.deleted_tiles(n, n.where("id % 7 = 0").select("id"), 8, E.ExpireConfig(buffer=0.0))


_MOVED = "id % 9 = 0"


@query(f"""SELECT way_id, count(*) AS n, round(sum(CASE WHEN {_MOVED} THEN lon + 1 ELSE lon END), 6) + 0e0 AS sx FROM edges JOIN nodes ON ref = id WHERE NOT id % 11 = 0 GROUP BY way_id""")
def c6_incremental(spark, sf):
    """A derived table kept up to date by closure; it equals the one made anew."""
    nodes = D.nodes(spark, sf).withColumn("version", F.lit(1)).withColumn("visible", F.lit(True)).select("id", "version", "visible", "lon", "lat")
    ways, rels = D.ways(spark, sf).select("id", "nodes"), D.members(spark, sf).groupBy(F.col("rel_id").alias("id")).agg(F.collect_list(F.struct("type", "ref", "role")).alias("members"))
    dn = nodes.where(_MOVED).withColumn("lon", F.col("lon") + 1).withColumn("version", F.lit(2)).where("id % 11 <> 0").unionByName(nodes.where("id % 11 = 0").withColumn("version", F.lit(3)).withColumn("visible", F.lit(False)))
    old = CH.State(nodes, ways, rels)
    new = CH.State(CH.apply_objects(nodes, dn), ways, rels)
    none = spark.createDataFrame([], "id long, version int, visible boolean")
    hit = CH.affected(old, new, dn, none, none)

    def derive(state, only=None):
        e = D.edges(spark, sf)
        e = e if only is None else e.join(only.select(F.col("id").alias("way_id")), "way_id", "left_semi")
        return e.join(state.nodes.select(F.col("id").alias("ref"), "lon"), "ref").groupBy("way_id").agg(F.count("*").alias("n"), r6(F.sum("lon")).alias("sx"))

    return CH.refresh(derive(old), hit.ways, lambda ids: derive(new, ids), "way_id")


@query("""SELECT DISTINCT rel_id AS id FROM members WHERE type = 'n' AND ref % 9 = 0 OR type = 'w' AND ref IN (SELECT way_id FROM edges WHERE ref % 9 = 0)""")
def c4_pending_relations(spark, sf):
    """Relations that depend on changed nodes, directly or through ways."""
    e, m = D.edges(spark, sf), D.members(spark, sf)
    changed = D.nodes(spark, sf).where("id % 9 = 0").select("id")
    ways = R.parent_ways(changed, e)
    return R.union_ids(R.parent_relations(changed, m, "n"), R.parent_relations(ways, m, "w"))


@query("SELECT DISTINCT ref AS id FROM members WHERE type = 'w' AND rel_id % 13 = 0")
def c11_marked_members(spark, sf):
    """C11: members before and after a relation's change."""
    m = D.members(spark, sf)
    rel = lambda f: m.where(f).groupBy(F.col("rel_id").alias("id")).agg(F.collect_list(F.struct("type", "ref", "role")).alias("members"))
    none = spark.createDataFrame([], "id long, nodes array<long>")
    return CH.marked_members(CH.State(none, none, rel("pos % 4 < 3")), CH.State(none, none, rel("pos % 4 > 1")), m.where("rel_id % 13 = 0").select(F.col("rel_id").alias("id")).distinct(), "w")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, CAST(row_number() OVER (ORDER BY date_trunc('hour', ts)) AS INT) AS seq, n FROM (SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1)", cte=False)
def c12_sequences(spark, sf):
    """Change files numbered by the hour."""
    h = D.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return h.select("hour", F.expr("CAST(row_number() OVER (ORDER BY hour) AS INT)").alias("seq"), "n")


@query("SELECT k AS property, max(v) AS value FROM (SELECT event_type AS k, CAST(max(event_id) AS VARCHAR) AS v FROM events GROUP BY event_type UNION ALL SELECT 'version', '1') GROUP BY k", cte=False)
def k10_properties(spark, sf):
    """Keys and values, new ones first."""
    ev = D.table(spark, sf, "events").groupBy(F.col("event_type").alias("property")).agg(F.max("event_id").cast("string").alias("value"))
    old = spark.createDataFrame([("version", "1"), ("click", "old")], "property string, value string")
    return W.upsert_properties(old, ev)


@query(r"SELECT id, concat(id, chr(9), coalesce(brand, '\N'), chr(9), '{', size, ',', id, '}', chr(9), '\N') AS line FROM nodes")
def k1_copy_text(spark, sf):
    """K1: rows as text for bulk loading."""
    size = T.tag(F.col("tags"), "size")
    return D.nodes(spark, sf).select("id", W.copy_text(F.col("id"), T.tag(F.col("tags"), "brand"), W.copy_array(F.array(size.cast("long"), F.col("id"))), F.lit(None).cast("string")).alias("line"))


@query("SELECT 'line' AS t, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS polygons FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL", cte=False)
def p13_style_filter(spark, sf):
    """A style decides what is kept, and what is an area."""
    from ..sources.textfiles import parse_style
    from .legacy import filter_tags

    rules, _ = parse_style("node,way status text linear\nnode,way building text polygon\nnode,way note* text delete\nway priority text linear # last\n")
    o = D.table(spark, sf, "orders").selectExpr("""map_filter(map('status', if(o_orderkey % 3 = 0, null, if(o_orderkey % 4 = 0, 'F', o_orderstatus)), 'note:x', 'y', 'building', if(o_orderkey % 4 = 0 AND o_orderkey % 3 > 0, 'yes', null)), (k, v) -> v IS NOT NULL) AS tags""")
    f = o.select(filter_tags(F.col("tags"), rules, "w").alias("f")).where("f.keep")
    return f.groupBy(F.lit("line").alias("t"), T.tag(F.col("f.tags"), "status").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("f.polygon").cast("long")).alias("polygons"))


@query(f"""SELECT o_orderkey AS id, k <> 5 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 AS keep, o_orderkey % 4 = 0 AND o_orderkey % 8 <> 4 AS polygon, k IN (0, 1, 4) OR o_orderkey % 7 = 0 AS roads,
CASE WHEN k <> 5 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN CAST(CASE WHEN o_orderkey % 7 = 0 THEN 10 * (o_orderkey % 3 - 1) + 5 ELSE 0 END + CASE k WHEN 0 THEN 9 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 4 THEN 8 ELSE 0 END
  + CASE o_orderstatus WHEN 'F' THEN CASE WHEN k < 5 THEN 10 ELSE 0 END WHEN 'O' THEN CASE WHEN k < 5 THEN -10 ELSE 0 END ELSE 0 END AS VARCHAR) END AS z_order, 1 + CAST(k < 5 AS INT) * 3 + CAST(o_orderkey % 7 = 0 AS INT) * 2 + CAST(o_orderkey % 4 = 0 AS INT) + CAST(o_orderkey % 8 = 4 AS INT) - CAST(NOT (k <> 5 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0) AS INT) AS n
FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""", cte=False)
def p18_script_transform(spark, sf):
    """Ways through the standard tag script: what is kept, areas, roads, drawing order, and how many tags are left."""
    from .script import STANDARD

    o = D.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"""map_filter(map('highway', {_ROAD}, 'bridge', if({_ROAD} IS NULL, null, if(o_orderstatus = 'F', 'yes', '1')), 'tunnel', if({_ROAD} IS NULL, null, if(o_orderstatus = 'O', 'true', 'no')),
      'railway', if(o_orderkey % 7 = 0, 'rail', null), 'layer', if(o_orderkey % 7 = 0, CAST(o_orderkey % 3 - 1 AS STRING), null), 'building', if(o_orderkey % 4 = 0, 'yes', null), 'area', if(o_orderkey % 8 = 4, 'no', null), 'note', 'x', 'source', 'y'), (k, v) -> v IS NOT NULL) AS tags""")
    s = o.select("id", STANDARD.way(F.col("tags")).alias("s"))
    return s.select("id", "s.keep", "s.polygon", "s.roads", T.tag(F.col("s.tags"), "z_order").alias("z_order"), F.size("s.tags").alias("n"))


@query("""SELECT 'point' AS t, count(*) AS n FROM nodes UNION ALL SELECT 'line', count(*) FROM lines""")
def k14_legacy_tables(spark, sf):
    """The four tables of the older output."""
    from ..sources.textfiles import parse_style
    from . import legacy

    rules, _ = parse_style("node,way brand text linear\nway status text linear\nway area text polygon\n")
    n = D.nodes(spark, sf).withColumn("geom", st.as_point(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))))
    l = _lines(spark, sf).select(F.col("way_id").alias("id"), F.create_map(F.lit("status"), F.lit("x")).alias("tags"), st.as_linestring("line").alias("line"), F.lit(None).cast("binary").alias("area"))
    t = legacy.tables(n, l, l.limit(0), rules, line_length=1e9)
    return t["point"].agg(F.count("*").alias("n")).withColumn("t", F.lit("point")).unionByName(t["line"].agg(F.count("*").alias("n")).withColumn("t", F.lit("line"))).select("t", "n")


@query("SELECT way_id, o_orderstatus AS status, round(len, 6) AS length FROM lines JOIN orders ON o_orderkey + 1 = way_id WHERE o_orderstatus <> 'P'")
def user_program(spark, sf):
    """A program with a way table; its rows."""
    from .program import Program

    p = Program()
    p.define_way_table("roads", [{"name": "status", "not_null": True}, {"name": "geom", "type": "linestring", "not_null": True, "projection": 4326}])

    @p.on("process_way")
    def _(ways):
        ways.where(ways.tag("status") != "P").insert("roads", status=ways.tag("status"), geom=ways.as_linestring())

    rows = p.run(D.nodes(spark, sf), D.ways(spark, sf), spark.createDataFrame([], "id long, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"))["roads"]
    return rows.select("way_id", "status", r6(st.length("geom")).alias("length"))


@query("SELECT 'n' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'w', count(DISTINCT o_orderkey) FROM orders")
def c10_after_events(spark, sf):
    """What a program does once, after all nodes and after all ways."""
    from .program import Program

    p, seen = Program(), {}
    for kind in ("nodes", "ways"):
        p.on(f"after_{kind}")(lambda o, kind=kind: seen.update({kind[0]: o.df.agg(F.count("*").alias("n")).select(F.lit(kind[0]).alias("kind"), "n")}))
    p.run(D.nodes(spark, sf), D.ways(spark, sf), spark.createDataFrame([], "id long, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"))
    return seen["n"].unionByName(seen["w"])
