"""Functions and operators on small frames, readers on small files, and queries against SQL."""

import gzip
import struct
import zlib
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweave import model as M
from mapweave.functions import coerce as K
from mapweave.functions import coords as C
from mapweave.functions import shapes as S
from mapweave.functions import tags as T
from mapweave.operators import generalize as G
from mapweave.operators import resolve as R
from mapweave.operators import spatial as X
from mapweave.plans.legacy import filter_tags
from mapweave.plans.program import Program
from mapweave.plans.tables import ColumnDef, IndexDef, TableDef, typed_geometry
from mapweave.sources import binary as B
from mapweave.sources import sinks as W
from mapweave.sources import textfiles as X_
from mapweave.streaming import changes as CH
from mapweave.streaming import replication as RP

SF = "/root/testdata/sf0.001"


def values(spark, items, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, s {kind}")
    return [r.v for r in rows.select("i", make(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("pattern, text, hit", [
    ("fhwa", "fhwa", True), ("fhwa", "fhwa:old", False), ("*", "abc", True), ("*", "", True), ("?", "", False), ("?", "a", True), ("a*c", "abbbc", True), ("a*c", "abb", False),
    ("a?c", "abc", True), ("a?c", "ac", False), ("*fg", "abcfg", True), ("*b*", "abc", True), ("Abc", "abc", False), ("a.c", "abc", False), ("**", "x", True), ("a*b*c", "aXbYc", True)])
def test_wildcards(spark, pattern, text, hit):
    assert values(spark, [text], lambda c: T.wild_match(pattern, c)) == [hit]


def test_coercion(spark):
    s = ["yes", "no", "true", "0", "YES", " 42", "", "abc", "0a", "0xa", "--1", "1foo", "1.2", "-1", "99999", "99999999999", "1e3", "inf", None]
    assert values(spark, s, K.to_bool) == [True, False, True, False] + [None] * 15
    assert values(spark, s, lambda c: K.to_int(c, "int2")) == [None, None, None, 0, None, 42] + [None] * 7 + [-1] + [None] * 5
    assert values(spark, s, lambda c: K.to_int(c, "int4"))[14:16] == [99999, None]
    assert values(spark, s, lambda c: K.to_int(c, "int8"))[15] == 99999999999
    real = values(spark, s, K.to_real)
    assert real[5] == 42 and real[9] == 10 and real[12] == 1.2 and real[16] == 1000 and real[17] == float("inf") and real[6:9] == [None] * 3 and real[11] is None
    assert values(spark, s, K.to_direction) == [1, 0, None, 0] + [None] * 9 + [-1] + [None] * 5
    assert values(spark, ["5-6", "7 m", "1-2-3", "x", "99999999999", "-3"], K.legacy_int) == [5, 7, 1, None, None, -3]
    assert values(spark, ["1,5", "10 ft", "1-2", "x", "6ft"], K.legacy_real) == [1.5, pytest.approx(3.048), 1.5, None, pytest.approx(1.8288)]
    assert values(spark, [-5, 0, 7], lambda c: K.number_to(c, "direction"), "int") == [-1, 0, 1]


def test_strings(spark):
    assert values(spark, ["10 ft", "-1.5mi", "1.2.3", "x", "7", None], lambda c: T.split_unit(c, "m")) == [(10.0, "ft"), (-1.5, "mi"), None, None, (7.0, "m"), None]
    assert values(spark, ["a; b ;;c", "", None], lambda c: F.array_join(T.split_string(c), "|")) == ["a|b|c", "", ""]
    assert values(spark, ["  a b\t", "", "   ", None], T.trim) == ["a b", "", "", None]
    assert values(spark, [5, 50, None], lambda c: T.clamp(c, 10, 40), "int") == [10, 40, None]
    assert values(spark, [5, 75, 3675], T.duration, "int") == ["5s", "75s (1m 15s)", "3675s (1h 1m 15s)"]
    assert values(spark, [694861], T.pretty_delta, "int") == ["1 week(s) 1 day(s) 1 hour(s) 1 minute(s) 1 second(s)"]
    assert values(spark, ["31/3/27", "32/0/0", "2/4/0", "a/c/c", "1a/0/0", ""], lambda c: C.parse_tile(c).isNotNull()) == [True, False, False, False, False, False]
    with pytest.raises(ValueError):
        T.check_identifier("a;b")
    with pytest.raises(ValueError):
        T.grab_tag(None, "")


def test_tags(spark):
    df = spark.createDataFrame([({"a": "1", "addr:x": "2", "name": "n", "x:lang": "q"},)], "tags map<string,string>")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(T.clean_tags(F.col("tags"), ["a", "addr:*", "*:lang"])) == {"name": "n"}
    assert one(T.prefix_store(F.col("tags"), "addr:")) == {"x": "2"}
    assert one(T.hstore(F.col("tags"), "norm", ["a", "name"])) == {"addr:x": "2", "x:lang": "q"}
    assert one(T.grab_tag(F.col("tags"), "a")[1]).keys() == {"addr:x", "name", "x:lang"}
    z = spark.createDataFrame([({"highway": "primary", "layer": "-1x", "bridge": "yes"},), ({"railway": "rail", "tunnel": "1"},), ({},)], "tags map<string,string>")
    assert [tuple(r) for r in z.select(T.z_order(F.col("tags")), T.is_road(F.col("tags"))).collect()] == [(37, True), (-65, True), (0, False)]
    members = spark.createDataFrame([([("n", 1, ""), ("w", 2, "x"), ("n", 3, "")],)], "m array<struct<type:string,ref:long,role:string>>")
    assert members.select(T.member_ids(F.col("m"), "n")).first()[0] == [1, 3]


@pytest.mark.parametrize("x, y, key", [(3, 5, 0x27), (65535, 65535, 0xFFFFFFFF), (262143, 262143, 0xFFFFFFFFF), (131068, 131068, 0x3FFFFFFF0)])
def test_quadkeys(spark, x, y, key):
    r = spark.range(1).select(C.quadkey(F.lit(x), F.lit(y)).alias("q")).select("q", C.quadkey_xy(F.col("q")).alias("b")).first()
    assert r.q == key and (r.b.x, r.b.y) == (x, y)


def test_style():
    rules, area = X_.parse_style("# c\nnode,way name text linear\nway building text polygon # x\nnode note* text delete\nway way_area real delete\n")
    assert len(rules) == 3 and not area and rules[2].wildcard
    for bad in ("node name", "x name text", "node na* text linear", ""):
        with pytest.raises(ValueError):
            X_.parse_style(bad)


def test_style_filter(spark):
    rules, _ = X_.parse_style("node,way name text linear\nway building text polygon\nnode,way note* text delete\n")
    df = spark.createDataFrame([({"name": "a", "note:x": "y", "z": "1"},), ({"building": "yes"},), ({"building": "yes", "area": "no"},), ({"natural": "coastline"},), ({"z": "1"},)], "tags map<string,string>")
    got = [r.f for r in df.select(filter_tags(F.col("tags"), rules, "w").alias("f")).collect()]
    assert [(g.keep, g.polygon) for g in got] == [(True, False), (True, True), (True, False), (False, True), (False, False)]
    stored = [r.f for r in df.select(filter_tags(F.col("tags"), rules, "w", "all").alias("f")).collect()]
    assert stored[0].tags == {"name": "a", "z": "1"} and stored[4].keep
    assert not df.select(filter_tags(F.col("tags"), rules, "w", "all", match_only=True).alias("f")).collect()[4].f.keep


def test_input_checks(spark):
    df = spark.createDataFrame([(1, 1), (2, -1), (3, 5), (4, 5), (5, 3)], "k int, id long")
    assert tuple(M.check_input(df, ["k"]).first()) == (1, 1, 2)
    v = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "id long, version int, v string")
    assert {(r.id, r.v) for r in M.latest_versions(v, ["id"], ["version"]).collect()} == {(1, "c"), (2, "x")}
    with pytest.raises(Exception, match="deleted object"):
        M.no_deleted(spark.createDataFrame([(1, False)], "id long, visible boolean")).collect()
    with pytest.raises(ValueError):
        M.ImportOptions(append=True)
    with pytest.raises(ValueError):
        M.ImportOptions(hstore="all")
    assert M.ImportOptions(output="pgsql", hstore="all", expire_zoom=(3, 9)).prefix == "planet"


OPL = """n1 v1 dV c3 t2020-01-01T00:00:00Z i7 uab%20%c Tk=v%2c%w,name=x x1.5 y2.25
n2 v2 x-1 y-2
n3 v2 dD
w10 v1 Thighway=primary Nn1,n2,n9
r20 v1 Ttype=route Mw10@main,n1@
"""


def test_opl(spark, tmp_path):
    (tmp_path / "a.opl").write_text(OPL)
    n, w, r = X_.read_opl(spark, str(tmp_path / "a.opl"))
    a = {x.id: x for x in n.collect()}
    assert (a[1].x, a[1].y, a[1].user, a[1].tags) == (15000000, 22500000, "ab c", {"k": "v,w", "name": "x"}) and not a[3].visible and a[3].x == M.UNDEFINED
    assert w.first().nodes == [1, 2, 9] and [tuple(m) for m in r.first().members] == [("w", 10, "main"), ("n", 1, "")]
    assert {x.id for x in M.valid_locations(n).collect()} == {1, 2}


XML = """<osm version="0.6"><node id="1" version="3" lat="2.25" lon="1.5" timestamp="2020-01-01T00:00:00Z" uid="7" user="u"><tag k="a" v="b"/></node><node id="2" lat="0" lon="0"/>
<way id="10" version="1"><nd ref="1"/><nd ref="2"/><tag k="highway" v="x"/></way><relation id="20" version="1"><member type="way" ref="10" role="r"/><tag k="type" v="route"/></relation></osm>"""


def test_xml_and_changes(spark, tmp_path):
    (tmp_path / "a.osm.gz").write_bytes(gzip.compress(XML.encode()))
    n, w, r = X_.read_xml(spark, str(tmp_path / "a.osm.gz"))
    assert {(x.id, x.x, x.version) for x in n.collect()} == {(1, 15000000, 3), (2, 0, 0)}
    assert w.first().nodes == [1, 2] and tuple(r.first().members[0]) == ("w", 10, "r")
    osc = '<osmChange><create><node id="5" version="1" lat="1" lon="1"/></create><delete><way id="10" version="2"/></delete><modify><node id="5" version="2" lat="2" lon="2"><tag k="a" v="b"/></node></modify></osmChange>'
    (tmp_path / "a.osc").write_text(osc)
    n, w, _ = X_.read_changes(spark, str(tmp_path / "a.osc"))
    assert {(x.id, x.version, x.visible) for x in n.collect()} == {(5, 1, True), (5, 2, True)} and not w.first().visible


def vi(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zz(n):
    return vi(n << 1 ^ n >> 63 if n >= 0 else (-n << 1) - 1)


def field(k, raw):
    return vi(k << 3 | 2) + vi(len(raw)) + raw if isinstance(raw, bytes) else vi(k << 3) + vi(raw)


def pbf():
    strings = b"".join(field(1, s) for s in (b"", b"k", b"v", b"role"))
    dense = field(1, zz(1) + zz(1)) + field(8, zz(22500000) + zz(5)) + field(9, zz(15000000) + zz(-5)) + field(10, vi(1) + vi(2) + vi(0) + vi(0))
    way = field(1, 10) + field(2, vi(1)) + field(3, vi(2)) + field(8, zz(1) + zz(1))
    rel = field(1, 20) + field(8, vi(3)) + field(9, zz(10)) + field(10, vi(1))
    block = field(1, strings) + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, rel))
    data = b""
    for kind, raw in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(2, len(raw)) + field(3, zlib.compress(raw))
        head = field(1, kind) + field(3, len(blob))
        data += struct.pack(">I", len(head)) + head + blob
    return data


def test_pbf(spark, tmp_path):
    (tmp_path / "a.pbf").write_bytes(pbf())
    n, w, r = B.split(B.read_pbf(spark, str(tmp_path / "a.pbf")))
    assert {(x.id, x.x, x.y, x.tags.get("k")) for x in n.collect()} == {(1, 15000000, 22500000, "v"), (2, 14999995, 22500005, None)}
    assert w.first().nodes == [1, 2] and tuple(r.first().members[0]) == ("w", 10, "role")


def test_o5m(spark, tmp_path):
    node = zz(1) + vi(1) + zz(0) + zz(15000000) + zz(22500000) + b"\0k\0v\0"
    node2 = zz(1) + vi(0) + zz(-5) + zz(5) + vi(1)
    way = zz(10) + vi(0) + vi(len(zz(1) + zz(1))) + zz(1) + zz(1) + vi(1)
    rel = zz(20) + vi(0) + vi(len(zz(10) + b"\x001role\0")) + zz(10) + b"\x001role\0"
    gone = zz(1) + vi(0)
    data = b"\xff\xe0\x04o5m2" if False else b"\xff"
    for mark, raw in ((0x10, node), (0x10, node2), (0x11, way), (0x12, rel), (0x10, gone)):
        data += bytes([mark]) + vi(len(raw)) + raw
    (tmp_path / "a.o5m").write_bytes(data + b"\xfe")
    n, w, r = B.split(B.read_o5m(spark, str(tmp_path / "a.o5m")))
    assert {(x.id, x.x, x.visible, x.tags.get("k")) for x in n.collect()} == {(1, 15000000, True, "v"), (2, 14999995, True, "v"), (3, None, False, None)}
    assert w.first().nodes == [1, 2] and tuple(r.first().members[0]) == ("w", 10, "role")


def test_resolution(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, lon double, lat double")
    ways = spark.createDataFrame([(10, [1, 1, 7, 2]), (11, [1]), (12, [])], "id long, nodes array<long>")
    got = {r.way_id: r for r in R.locate(R.way_edges(ways), nodes).collect()}
    assert len(got[10].pts) == 4 and got[10].pts[2] is None and got[10].found == 3
    lines = {r.way_id: r.line for r in R.way_lines(R.locate(R.way_edges(ways), nodes)).collect()}
    assert list(lines) == [10] and [tuple(p) for p in lines[10]] == [(0, 0), (3, 4)]


def test_locator(spark):
    regions = spark.createDataFrame([X.box_region("a", 0, 0, 2, 2), X.box_region("b", 1, 1, 30, 30)], "name string, geom binary")
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.5, 1.5), (3, 50.0, 0.0), (4, 30.0, 30.0)], "id long, lon double, lat double")
    got = {r.id: r.names for r in X.all_intersecting(pts, X.region_boxes(regions)).collect()}
    assert got == {1: ["a"], 2: ["a", "b"], 4: ["b"]}
    things = spark.createDataFrame([(1, S.to_ewkb(S.line([(-5, 1), (1, 1)]))), (2, S.to_ewkb(S.line([(40, 1), (41, 1)])))], "id long, geom binary")
    assert sorted((r.id, r.name) for r in X.geometry_matches(things, regions).collect()) == [(1, "a"), (1, "b")]


def test_tables_and_program(spark):
    with pytest.raises(ValueError):
        ColumnDef("a", "nothing")
    with pytest.raises(ValueError):
        TableDef("t", "what")
    assert TableDef("t", "tile").ddl().startswith("x int NOT NULL") or "x int NOT NULL" in TableDef("t", "tile").ddl()
    assert ColumnDef("g", "point", projection="latlong").projection == 4326
    with pytest.raises(ValueError):
        typed_geometry(S.line([(0, 0), (1, 1)]), "POINT", 4326)
    assert S.from_ewkb(typed_geometry(S.point(1, 2), "MULTIPOINT", 4326)).kind == "MULTIPOINT"
    dup = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "a int")
    assert [tuple(r) for r in IndexDef(("a",), unique=True).violations(dup).collect()] == [(1, 2)]
    p = Program()
    p.define_node_table("pois", [{"name": "name", "not_null": True}, {"name": "geom", "type": "point"}])
    p.define_area_table("areas", [{"name": "geom", "type": "geometry"}])

    @p.on("process_node")
    def _(o):
        name, rest = o.grab_tag("name")
        rest.insert("pois", name=name, geom=o.as_point())

    @p.on("process_relation")
    def _(o):
        o.insert("areas", geom=o.as_multipolygon())

    nodes = spark.createDataFrame([(k, float(x), float(y), {"name": "n"} if k == 1 else {"a": "b"} if k == 2 else {}) for k, x, y in ((1, 0, 0), (2, 4, 0), (3, 4, 4), (4, 0, 4))], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2, 3], {}), (11, [3, 4, 1], {})], "id long, nodes array<long>, tags map<string,string>")
    rels = spark.createDataFrame([(20, [("w", 10, ""), ("w", 11, "")], {"type": "multipolygon"})], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    out = p.run(nodes, ways, rels)
    assert [(r.node_id, r.name) for r in out["pois"].collect()] == [(1, "n")]
    assert p.rejected["pois"][0].first().rejected_column == "name"
    area = out["areas"].first()
    assert area.area_id == -20 and S.from_ewkb(area.geom).kind == "POLYGON"


def test_incremental_equals_rebuild(spark):
    nodes = spark.createDataFrame([(k, 1, True, float(k)) for k in range(1, 30)], "id long, version int, visible boolean, lon double")
    ways = spark.createDataFrame([(100 + k, 1, True, [k, k + 1, k + 2]) for k in range(1, 27)], "id long, version int, visible boolean, nodes array<long>")
    rels = spark.createDataFrame([(200, 1, True, [("w", 101, ""), ("n", 9, "")])], "id long, version int, visible boolean, members array<struct<type:string,ref:long,role:string>>")
    dn = spark.createDataFrame([(5, 2, True, 50.0), (5, 3, True, 51.0), (7, 2, False, 0.0), (40, 1, True, 40.0)], nodes.schema)
    dw = spark.createDataFrame([(110, 2, False, []), (130, 1, True, [1, 40])], ways.schema)
    dr = rels.limit(0)
    old = CH.State(nodes, ways, rels)
    new, hit = CH.apply(old, dn, dw, dr)

    def derive(s, only=None):
        e = R.way_edges(s.ways)
        e = e.join(only.select(F.col("id").alias("way_id")), "way_id", "left_semi") if only is not None else e
        return e.join(s.nodes.select(F.col("id").alias("ref"), "lon"), "ref").groupBy("way_id").agg(F.sum("lon").alias("s"), F.count("*").alias("n"))

    kept = CH.refresh(derive(old), hit.ways, lambda ids: derive(new, ids), "way_id")
    assert sorted(kept.collect()) == sorted(derive(new).collect())
    assert {r.id for r in hit.pending_relations.collect()} == set() and {r.id for r in hit.pending_ways.collect()} == {103, 104, 105, 106, 107}


def test_change_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 1, True, 5.0)], "id long, version int, visible boolean, lon double").write.parquet(str(tmp_path / "in/a"))
    seen = []
    q = CH.start_stream(spark.readStream.schema("id long, version int, visible boolean, lon double").parquet(str(tmp_path / "in/*")), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [(0, 1)]


def test_replication():
    t = datetime(2024, 1, 1, tzinfo=UTC)
    server, stored, applied = RP.Position("u", 12, t), [], []
    start = RP.init(lambda: server, lambda at: 5 if at == t - timedelta(hours=3) else 0, t)
    assert start.sequence == 5
    end = RP.update(start, lambda: server, lambda n: applied.append(n) or t, stored.append, per_round=3)
    assert end.sequence == 12 and applied == list(range(6, 13)) and [p.sequence for p in stored] == [8, 11, 12]

    def fail(n):
        raise OSError

    with pytest.raises(OSError):
        RP.update(start, lambda: server, fail, stored.append)
    assert len(stored) == 3
    assert RP.status(None, server)["status"] == 2 and RP.status(start, None)["status"] == 1 and RP.status(start, server, t)["lag"] == 7
    assert RP.parse_time("2020-01-02T03:04:05Z").hour == 3
    assert RP.check_properties({"updatable": "true", "prefix": "a"}, {"prefix": "b"}) == ["prefix: stored 'a', given 'b'"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, 1, 2), (3, 7, 7)], "zoom int, x int, y int")
    assert '"type":"FeatureCollection"' in W.feature_collection([r.value for r in W.tile_geojson(df).collect()])
    W.tile_lines(df).write.text(str(tmp_path / "t"))
    good, bad = X_.read_tiles(spark, str(tmp_path / "t"))
    assert good.count() == 2 and bad.count() == 0
    W.write_clustered(df, str(tmp_path / "c"), C.quadkey(F.col("x"), F.col("y")), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    W.discard(df)


def test_isolation_blocks(spark):
    rows = [(k, float(k * 37 % 101), float(k * 53 % 97), float(k % 50 + 1)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, importance double")
    a = {r.id: r.discr_iso for r in G.discrete_isolation(df).where("irank > 0").collect()}
    b = {r.id: r.d for r in G.isolation_blocks(df, 64).where("irank > 0").collect()}
    assert a == pytest.approx(b) and G.discrete_isolation(df.limit(1)).count() == 0


def test_raster():
    c = np.zeros((40, 40), bool)
    G.fill(c, [np.array([(5.0, 5.0), (25.0, 5.0), (25.0, 25.0), (5.0, 25.0), (5.0, 5.0)])])
    assert c.sum() == 400
    c[10, 30:36] = True  # a thin line goes, a gap closes
    c[12, 12] = False
    out = G.open_close(c, 2)
    assert out[12, 12] and not out[10, 33] and out.sum() == 400
    assert sum(S.area(S.Geom("POLYGON", p)) for p in G.trace(out)) == 400
    with pytest.raises(ValueError):
        G.strategy("x")


ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", ["way_lines", "j2_relation_members", "j7_locator", "p19_legacy_numbers", "a8_roll_up", "u2_changed_segments", "c6_incremental", "j13_river_widths", "n4_river_chains", "p18_script_transform"])
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = c.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(map(repr, (tuple(r[x] for x in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE) <= set(entry.queries())


def test_legacy_tables_by_script(spark):
    from dataclasses import replace

    from mapweave.plans import legacy
    from mapweave.plans.script import STANDARD
    from mapweave.sources.textfiles import parse_style

    rules, _ = parse_style("node,way name text linear\nway z_order int4 linear\n")
    line, area, spot = (bytearray(S.to_ewkb(g)) for g in (S.line([(0, 0), (1, 1)]), S.Geom("POLYGON", [[(0, 0), (1, 0), (1, 1), (0, 0)]]), S.point(1, 2)))
    kinds = "id long, tags map<string,string>, line binary, area binary"
    nodes = spark.createDataFrame([(1, {"name": "a"}, spot), (2, {"note": "b"}, spot), (3, {}, spot)], "id long, tags map<string,string>, geom binary")
    ways = spark.createDataFrame([(1, {"highway": "motorway", "layer": " 1.5 ", "tunnel": "yes"}, line, area), (2, {"building": "yes"}, line, area), (3, {"leisure": "x", "area": "0"}, line, area), (4, {"FIXME": "x"}, line, area),
                                  (5, {"railway": "", "layer": "up", "bridge": "1"}, line, area), (6, None, line, area)], kinds)
    rels = spark.createDataFrame([(1, {"type": "multipolygon", "name": "m"}, line, area), (2, {"type": "boundary", "boundary": "administrative"}, line, area), (3, {"type": "site", "name": "s"}, line, area), (4, {"type": "route"}, line, area)], kinds)
    t = legacy.tables(nodes, ways, rels, rules, script=STANDARD)
    ids = lambda t, k: sorted((r["osm_id"], r["z_order"]) if "z_order" in r else r["osm_id"] for r in map(lambda r: r.asDict(), t[k].collect()))
    assert ids(t, "point") == [1]
    assert ids(t, "line") == [(-4, 0), (-2, 0), (1, 14), (3, 0), (5, 5)]
    assert ids(t, "polygon") == [(-2, 0), (-1, 0), (2, 0)]
    assert ids(t, "roads") == [(-2, 0), (1, 14), (5, 5)]
    own = replace(STANDARD, node=lambda tags: F.struct((F.size(tags) == 0).alias("keep"), F.create_map(F.lit("name"), F.lit("none")).alias("tags")))
    assert [(r["osm_id"], r["name"]) for r in legacy.tables(nodes, ways, rels, rules, script=own)["point"].collect()] == [(3, "none")]


def test_raster_files(spark):
    from mapweave.operators.generalize import png, raster_files, raster_wkb, world_file

    canvas = np.zeros((6, 6), bool)
    canvas[1:3, 2] = True
    raw = png(canvas)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (6, 6)
    size = struct.unpack(">I", raw[33:37])[0]
    assert np.array_equal(np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(6, 7)[:, 1:] == 255, canvas)
    wkb = raster_wkb(canvas, 0, 0, 1, 1)
    assert len(wkb) == 63 + 36 and struct.unpack("<BHH6diHH", wkb[:61])[-3:] == (3857, 6, 6) and wkb[61:63] == b"\x04\x00" and np.array_equal(np.frombuffer(wkb[63:], np.uint8) == 255, canvas.ravel())
    width, left, top = (float(v) for v in np.array(world_file(0, 0, 1, 4, 1).split(), float)[[0, 4, 5]])
    assert (left, top) == pytest.approx((-20037508.34 - width / 2, 20037508.34 + width / 2), abs=0.01)
    ring = [(-1e7, 1e7), (-5e6, 1e7), (-5e6, 1.5e7), (-1e7, 1.5e7), (-1e7, 1e7)]
    tiles = spark.createDataFrame([(0, 0, None, "", bytearray(S.to_ewkb(S.Geom("POLYGON", [ring], 3857))))] * 2, "tx int, ty int, grp string, layer string, geom binary")
    got = raster_files(tiles, 1, extent=64, margin=0.1).collect()
    assert [(r["name"], len(r["wkb"])) for r in got] == [("0-0-i", 63 + 76 * 76), ("0-0-o", 63 + 76 * 76)]
    assert np.frombuffer(got[0]["wkb"][63:], np.uint8).astype(bool).sum() == pytest.approx((5e6 / 20037508.34 * 64) ** 2, rel=0.15)


def test_tables_are_finished_in_order(spark, tmp_path):
    import pyarrow.parquet as pq

    tiles = TableDef("t", "tile", [ColumnDef("n", "int")])
    assert tiles.id_index() is None and tiles.id_index(updatable=True).columns == ("x", "y") and TableDef("t", "tile", create_index="always").id_index().columns == ("x", "y")
    rows = spark.range(200).selectExpr("CAST(id * 7 % 20 AS INT) AS x", "CAST(id % 10 AS INT) AS y", "CAST(id AS INT) AS n").repartition(3)
    got = tiles.finish(rows, f"{tmp_path}/t", updatable=True, partitions=4)
    assert sorted(got.collect()) == sorted(rows.collect())
    ranges = []
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        keys = [(r["x"], r["y"]) for r in pq.read_table(f).to_pylist()]
        assert keys == sorted(keys)
        ranges += [(keys[0], keys[-1])] if keys else []
    ranges.sort()
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for how, ids in (("unique", "1, 2, 2"), ("primary_key", "1, 2, NULL")):
        t = TableDef("u", "way", [ColumnDef("n", "int")], id_column="way_id", create_index=how)
        with pytest.raises(ValueError, match="table u"):
            t.finish(spark.sql(f"SELECT explode(CAST(array({ids}) AS ARRAY<BIGINT>)) AS way_id, 1 AS n"), f"{tmp_path}/{how}")
        assert not (tmp_path / how).exists()
    free = TableDef("u", "way", [ColumnDef("n", "int")], id_column="way_id", create_index="unique")
    assert free.finish(spark.sql("SELECT explode(CAST(array(1, NULL, NULL) AS ARRAY<BIGINT>)) AS way_id, 1 AS n"), f"{tmp_path}/free").count() == 3
