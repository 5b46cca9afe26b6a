"""Kernels on arrays, for large tables, against those that take one object at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapweave.functions import batch as B
from mapweave.functions import shapes as S
from mapweave.functions.coords import EARTH
from mapweave.operators import expire as E
from mapweave.operators import generalize as G
from mapweave.plans import queries as Q

SF = "/root/testdata/sf0.001"
PTS = "array<struct<x:double,y:double>>"


@pytest.mark.parametrize("zoom, buffer, block", [(4, 0.0, 7), (6, 0.1, 200_000), (6, 1.7, 50)])
def test_line_tile_rows(spark, zoom, buffer, block):
    rng = np.random.default_rng(zoom)
    lines = [(k, [{"x": float(x), "y": float(y)} for x, y in rng.uniform(-0.5, 0.5, (int(rng.integers(2, 7)), 2)) * EARTH]) for k in range(60)]
    lines += [(100, [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 1.0}]), (101, [{"x": 5.0, "y": 5.0}]), (102, []), (103, None)]
    df = spark.createDataFrame(lines, f"id long, line {PTS}").repartition(3)
    want = {(r["id"], r["t"]["x"], r["t"]["y"]) for r in df.where("size(line) > 1").select("id", F.explode(E.line_tiles(F.col("line"), zoom, buffer)).alias("t")).collect()}
    got = [tuple(r) for r in E.line_tile_rows(df, "id", "line", zoom, buffer, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_line_tiles_are_not_shuffled(spark):
    plan = Q.e2_line_tiles(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(v in plan.split("MapInArrow")[0] for v in ("Aggregate", "Distinct"))


def ways():
    """Stars, some with equal distances; rings on a small grid that cross or touch themselves; open ones and gaps."""
    rng, at = np.random.default_rng(2), [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    out = [[(float(r) * at[k * 8 // n][0] / 10, float(r) * at[k * 8 // n][1] / 10) for k, r in enumerate(rng.integers(1, 6, n))] for n in rng.integers(3, 9, 150)]
    out += [[(float(x), float(y)) for x, y in rng.integers(0, 5, (n, 2))] for n in rng.integers(1, 8, 300)]
    out += [[(30 + np.cos(v) * (3 + k % 2), 88 + np.sin(v)) for k, v in enumerate(np.arange(n) * 2 * np.pi / n)] for n in (12, 39, 60)]
    out = [w + w[:1] if k % 9 else w for k, w in enumerate(out)]
    return [*out, None, [], [(0.0, 0.0), None, (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]


def test_batches_equal_the_kernels():
    made = ways()
    column = pa.array([w if w is None else [p if p is None else {"x": p[0], "y": p[1]} for p in w] for w in made], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    want = [w if w is None else S.to_ewkb(S.polygon_of_way([p for p in w if p])) or None for w in made]
    got = B.polygons_of_ways(column)
    assert got.to_pylist() == want and B.polygons_of_ways(column.slice(70, 200)).to_pylist() == want[70:270] and 150 < sum(v is not None for v in want) < 450
    holed = S.to_ewkb(S.Geom("POLYGON", [[(0.0, 0.0), (9.0, 0.0), (9.0, 7.0), (0.0, 7.0), (0.0, 0.0)], [(2.0, 2.0), (2.0, 5.0), (4.0, 5.0), (2.0, 2.0)]]))
    raw = [*want, holed, S.to_ewkb(S.point(3, 4)), S.to_ewkb(S.line([(1.0, 2.0), (5.0, 1.0)])), b"", S.to_ewkb(S.transform(S.from_ewkb(holed), 3857))]
    one = lambda fn: [v if v is None else fn(S.from_ewkb(v)) or None for v in raw]
    column = pa.array(raw, pa.binary())
    assert B.poles_of(column).to_pylist() == one(lambda g: S.to_ewkb(S.pole_of_inaccessibility(g)))
    assert B.mercator_of(column).to_pylist() == one(lambda g: S.to_ewkb(S.transform(g, 3857)))
    assert [v and tuple(v.values()) for v in B.boxes_of(column).to_pylist()] == one(S.bbox)
    assert B.poles_of(column.slice(3, 0)).to_pylist() == [] == B.boxes_of(column.slice(3, 0)).to_pylist()


def test_polygons_are_made_once(spark):
    plan = Q.f17_pole(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 == plan.count("ArrowEvalPython")


def test_fill_many_equals_fill():
    rng = np.random.default_rng(3)
    for k in range(90):
        r = rng.uniform(-20, 60, (int(rng.integers(1, 5)), int(rng.integers(3, 9)), 2))
        r = np.round(r * 2) / 2 if k % 3 == 0 else r  # vertices and edges through pixels' centres
        r = np.concatenate([r, r[:, :1]], axis=1)
        got, want = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
        G.fill_many(got, r, block=int(rng.integers(1, 500)))
        for one in r:
            G.fill(want, [one])
        assert (got == want).all()


@pytest.mark.parametrize("apart", [False, True])
def test_canvases_are_put_together(spark, apart):
    width, rng, n = EARTH / 1024, np.random.default_rng(4), 32
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s / 2), (x, y + s), (x, y)]
    shapes = [(int(t), 1, "g" if t % 2 else None, None if k % 3 == 0 else f"l{k % 3}", S.to_ewkb(S.Geom("POLYGON", [ring(t * width - EARTH / 2 + a * width, EARTH / 2 - width * (1 + b), width * s)], 3857)))
              for k, (t, (a, b, s)) in enumerate(zip(rng.integers(0, 6, 200), rng.uniform(0, 0.4, (200, 3)), strict=True))]
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    at = lambda r: [(x * width - EARTH / 2, EARTH / 2 - width - y * width) for x, y in r]
    shapes += [(0, 1, None, "h", S.to_ewkb(S.Geom("POLYGON", [at(square(0.1, 0.9)), at(square(0.3, 0.6))], 3857))), (9, 1, "e", "l", b""), (9, 2, "e", "l", None)]
    df = spark.createDataFrame(shapes, "tx int, ty int, grp string, layer string, geom binary").repartition(3)
    got = {}
    for r in G.drawn(df, 10, n, 4, apart, rows=10, canvases=2).collect():
        c = got.setdefault((r["tx"], r["ty"], r["grp"], r["layer"]), np.zeros((n + 8, n + 8), bool))
        c[r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["height"] * r["width"]).reshape(r["height"], r["width"]).astype(bool)
    want = {}
    for tx, ty, grp, layer, raw in shapes:
        c = want.setdefault((tx, ty, grp, layer if apart else ""), np.zeros((n + 8, n + 8), bool))
        if raw:
            one = np.zeros_like(c)
            G.fill(one, [np.array([((x - (tx * width - EARTH / 2)) / width * n + 4, (EARTH / 2 - ty * width - y) / width * n + 4) for x, y in r]) for r in S.from_ewkb(raw).data])
            c |= one
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


@pytest.mark.parametrize("name", ["n1_vector_union", "n2_raster_union", "n3_builtup"])
def test_shapes_are_drawn_before_they_are_dealt(spark, name):
    dealt = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[1].split("MapInArrow")[0]
    assert "bits" in dealt and "layer" in dealt and "Generate" not in dealt


def test_lines_in_batches_equal_the_kernels():
    rng = np.random.default_rng(5)
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    areas = [S.Geom("POLYGON", [square(1.0, 6.0)]), S.Geom("POLYGON", [square(0.0, 8.0), square(2.0, 4.0)]), S.Geom("MULTIPOLYGON", [S.Geom("POLYGON", [square(0.0, 3.0)]), S.Geom("POLYGON", [square(5.0, 7.0)])]), S.point(1, 1)]
    found = 0
    for n in (2, 3, 6):
        pts = np.round(rng.uniform(0, 8, (80, n, 2)))
        pts[40:] += rng.uniform(-1, 1, (40, n, 2))
        lines = [S.Geom("LINESTRING", [tuple(p) for p in l.tolist()]) for l in pts]
        for g in areas:
            got = [[] for _ in lines]
            for k, x, y in zip(*(v.tolist() for v in B.spans_of_lines(pts, g)), strict=True):
                got[k].append((x, y))
            want = [S.spans_within(l, g) for l in lines]
            assert [len(v) for v in got] == [len(v) for v in want] and np.allclose([p for v in got for p in v], [p for v in want for p in v], rtol=0, atol=1e-12)
            found += sum(map(len, want))
    assert found > 500
    made = ways()
    column = pa.array([w if w is None else [p if p is None else {"x": p[0], "y": p[1]} for p in w] for w in made], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    want = [w if w is None else S.to_ewkb(S.line([p for p in w if p])) or None for w in made]
    raw = [*want, S.to_ewkb(areas[2]), b""]
    assert B.lines_of(column).to_pylist() == want
    for k, r in enumerate(B.line_measures(pa.array(raw, pa.binary())).T.tolist()):
        g = S.from_ewkb(raw[k])
        assert r == pytest.approx([S.n_points(g), S.length(g), *(S.bbox(g) or (0, 0, 0, 0))])


def test_river_widths_in_batches(spark):
    plan = Q.j13_river_widths(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
