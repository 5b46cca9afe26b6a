"""Registered queries without SQL reach every object of their tables, with the kernels' own values."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweave.functions import shapes as S
from mapweave.functions import tags as T
from mapweave.functions.coords import EARTH
from mapweave.operators import expire as E
from mapweave.operators import generalize as G
from mapweave.plans import queries as Q
from mapweave.sources import demo as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rings(spark):
    """Polygons of all stars, by id, made by the kernel alone."""
    made = {r["id"]: S.polygon_of_way([(p["x"], p["y"]) for p in r["ring"]]) for r in D.stars(spark, SF).collect()}
    return {k: g for k, g in made.items() if S.to_ewkb(g)}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_measures_of_all_rings(spark, rings):
    got = {r["id"]: r["area"] for r in rows(spark, "f4_ellipsoid")}
    assert len(rings) > 1000 and got == pytest.approx({k: S.spherical_area(g) for k, g in rings.items()}, abs=1)
    poles = {r["id"]: r["pole"] for r in rows(spark, "f17_pole")}
    assert poles == {k: S.to_ewkb(S.pole_of_inaccessibility(g)).hex().upper() for k, g in rings.items()}


def test_tiles_of_all_rings(spark, rings):
    got = {(r["id"], r["x"], r["y"]) for r in rows(spark, "e4_area_tiles")}
    assert got == {(k, x, y) for k, g in rings.items() for x, y in E.tiles_of(S.transform(g, 3857), 12)}


def test_all_lines_and_relations(spark):
    ways = {r["way_id"] for r in rows(spark, "way_lines")}
    assert ways <= {r["way_id"] for r in rows(spark, "f16_simplify")}
    assert ways <= {r["way_id"] for r in entry.queries()["e2_line_tiles"](spark, SF).select("way_id").distinct().collect()}
    rels = {r["rel_id"] for r in D.members(spark, SF).select("rel_id").distinct().collect()}
    assert rels == {r["rel_id"] for r in rows(spark, "f14_line_merge")} == {r["rel_id"] for r in rows(spark, "g7_relation_geometries")}


def test_fill_by_pixels():
    rng, at = np.random.default_rng(1), np.arange(40) + 0.5
    for _ in range(60):
        rings = [np.vstack([p, p[:1]]) for p in (rng.uniform(-20, 60, (int(rng.integers(3, 8)), 2)) for _ in range(2))]
        canvas, want = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
        G.fill(canvas, rings)
        for r in rings:
            for (xa, ya), (xb, yb) in zip(r[:-1], r[1:], strict=True):
                if ya != yb:
                    want ^= ((ya > at) != (yb > at))[:, None] & (at[None, :] < (xa + (at - ya) / (yb - ya) * (xb - xa))[:, None])
        assert (canvas == want).all()


@pytest.mark.parametrize("name, extent, pad, buffer, parts", [("n1_vector_union", 512, 0, 1, 1), ("n2_raster_union", 256, 25, 2, 1), ("n3_builtup", 256, 25, 2, 3)])
def test_unions_of_all_areas(spark, rings, name, extent, pad, buffer, parts):
    got = defaultdict(float)
    for r in rows(spark, name):
        got[r["tx"], r["ty"], "" if parts == 3 else r["grp"]] += r["area"]
    width, n, want = EARTH / 1024, extent + 2 * pad, {}
    for tx, ty in {(r["tx"], r["ty"]) for r in rows(spark, name)}:
        for grp in ("",) if parts == 3 else ("0", "1"):
            whole = np.zeros((n, n), bool)
            for layer in range(parts):
                drawn = np.zeros((n, n), bool)
                for k, g in rings.items():
                    if (parts == 3 and k % 3 == layer) or (parts == 1 and str(k % 2) == grp):
                        one = np.zeros((n, n), bool)
                        G.fill(one, [np.array([((x + EARTH / 2) / width * extent - tx * extent + pad, (EARTH / 2 - y) / width * extent - ty * extent + pad) for x, y in r]) for r in S.transform(g, 3857).data])
                        drawn |= one
                whole |= G.open_close(drawn, buffer)
            want[tx, ty, grp] = whole[pad : pad + extent, pad : pad + extent].sum() * (width / extent) ** 2
    assert got == pytest.approx(want, abs=(4 if parts == 3 else 0.5) * (width / extent) ** 2)


def test_lines_over_all_nodes(spark):
    at = {r["id"]: (r["lon"], r["lat"]) for r in D.nodes(spark, SF).collect()}
    want = {}
    for r in D.ways(spark, SF).collect():
        pts = [at[n] for n in r["nodes"]]
        pts = [p for k, p in enumerate(pts) if not k or p != pts[k - 1]]
        if len(pts) > 1:
            want[r["id"]] = len(S.simplify(S.Geom("LINESTRING", pts), 20.0).data)
    assert {r["way_id"]: r["n"] for r in rows(spark, "f16_simplify")} == want


def test_line_tiles_equal_the_kernel(spark):
    lines = {r["way_id"]: [(p["x"], p["y"]) for p in r["line"]] for r in Q._mercator_line(spark, SF).collect()}
    got = defaultdict(set)
    for r in rows(spark, "e2_line_tiles"):
        got[r["way_id"]].add((r["x"], r["y"]))
    want = {k: E.tiles_of(S.Geom("LINESTRING", pts, 3857), 6, E.ExpireConfig(buffer=0.0)) for k, pts in lines.items()}
    assert len(want) > 1000 and {k for k in want if got[k] != want[k]} == set()


def test_mode_is_decided_on_the_whole():
    square = lambda x: S.Geom("POLYGON", [[(x, 0.0), (x + 2e4, 0.0), (x + 2e4, 2e4), (x, 2e4), (x, 0.0)]], 3857)
    both = S.Geom("MULTIPOLYGON", [square(0.0), square(3e5)], 3857)
    of = lambda mode: E.tiles_of(both, 14, E.ExpireConfig(mode, full_area_limit=5e4))
    assert of("hybrid") == of("boundary_only") < of("full_area")


def test_overall_limit(spark):
    t = spark.createDataFrame([(k, x, 0) for k in range(50) for x in range(k % 4 + 1)], "seq int, x int, y int").repartition(7)
    want, total = set(), 0
    for k in range(50):
        total += k % 4 + 1
        want |= {k} if total <= 70 else set()
    assert {r["seq"] for r in E.limit_overall(t, "seq", 70).collect()} == want


def test_layers_of_any_size(spark):
    texts = [" 3x", "-2", "", None, "x", "99999999999999999999", "-99999999999999999999", "4294967297", "12345678901"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.prefix_int(F.col("s"))).collect()]
    assert got == [3, -2, 0, 0, 0, -1, 0, 1, -539222987]


def test_chains_with_rings_and_branches(spark, tmp_path):
    def store(df, k):
        df.write.parquet(f"{tmp_path}/{k}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{k}")

    ring = [(5.0, 9.0), (4.0, 9.0), (3.0, 9.0), (6.0, 9.0), (5.0, 9.0)]
    long = [(float(k), 0.0) for k in range(40)]
    lines = [(1, 2.0, long[:20]), (2, None, long[19:]), (3, 7.0, [(5.0, 5.0), (39.0, 0.0)]), (4, 1.0, [(39.0, 0.0), (39.0, -1.0), (39.0, -1.0), (39.0, -2.0)]), (5, 3.0, ring), (6, 9.0, [(0.0, 50.0)])]
    df = spark.createDataFrame([(i, w, [{"x": x, "y": y} for x, y in p]) for i, w, p in lines], "way_id long, width double, pts array<struct<x:double,y:double>>")
    got = {r["way_id"]: (r["width"], [(p["x"], p["y"]) for p in r["pts"]]) for r in G.rivers(df, store).collect()}
    assert got == {1: (2.0, long), 3: (7.0, lines[2][2]), 4: (7.0, [(39.0, 0.0), (39.0, -1.0), (39.0, -2.0)]), 5: (3.0, [ring[2], ring[3], ring[0], ring[1], ring[2]])}
