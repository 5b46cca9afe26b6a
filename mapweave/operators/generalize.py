"""Generalisation for low zooms: isolation ranks, rivers, and shapes drawn tile by tile."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch as B
from ..functions import shapes as S
from ..functions import st
from ..functions.coords import EARTH, tile_box


def discrete_isolation(df: DataFrame, id_col="id", x="x", y="y", importance="importance") -> DataFrame:
    """(id, irank, discr_iso, dirank): rank by importance, the least distance to a more important one, rank by that.

    Ties go by id. Differences are taken between coordinates of single precision.
    The first feature has the distance of the second plus one. Fewer than two
    features: none. Every pair is compared, as the definition asks;
    ``isolation_blocks`` does so for many.
    """
    rows = df.where(F.col(importance) > 0).select(F.col(id_col).alias("id"), F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"), F.col(importance).alias("imp"))
    ranked = rows.withColumn("irank", F.expr("CAST(row_number() OVER (ORDER BY imp DESC, id) - 1 AS INT)"))
    other = ranked.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("irank").alias("orank"))
    pairs = ranked.join(other, F.col("orank") < F.col("irank"))
    far = lambda a, b: (F.col(a) - F.col(b)).cast("double")
    near = pairs.groupBy("id").agg(F.sqrt(F.min(far("x", "ox") * far("x", "ox") + far("y", "oy") * far("y", "oy"))).alias("d"))
    out = ranked.join(near, "id", "left")
    second = F.expr("max(CASE WHEN irank = 1 THEN d END) OVER () + 1")
    out = out.withColumn("discr_iso", F.coalesce("d", second)).where("discr_iso IS NOT NULL")
    return out.withColumn("dirank", F.expr("CAST(row_number() OVER (ORDER BY discr_iso DESC, id) - 1 AS INT)")).select("id", "irank", "discr_iso", "dirank")


def isolation_blocks(df: DataFrame, block: int = 2048) -> DataFrame:
    """The same distances for many features: those in order of importance, cut into blocks; each block against those before it, a task a pair.

    (id, irank, d) with d null for the first. Blocks are arrays in numpy, so no pairs of rows are made.
    """
    rows = df.where("importance > 0").select("id", F.col("x").cast("double"), F.col("y").cast("double"), "importance")
    ranked = rows.withColumn("irank", F.expr("CAST(row_number() OVER (ORDER BY importance DESC, id) - 1 AS INT)"))
    packed = ranked.groupBy(F.expr(f"irank div {block}").cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("irank", "id", "x", "y"))).alias("r"))
    n = packed.select("b").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b"))))
    left = n.join(packed, "b")
    pairs = left.join(packed.select(F.col("b").alias("o"), F.col("r").alias("q")), "o").select("b", "o", "r", "q")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for b, o, r, q in pdf.itertuples(index=False):
                a, c = (np.array([(v["x"], v["y"]) for v in s]) for s in (r, q))
                d = np.hypot(a[:, None, 0] - c[None, :, 0], a[:, None, 1] - c[None, :, 1])
                if b == o:
                    d[np.triu_indices(len(a))] = np.inf
                best = d.min(axis=1)
                yield pd.DataFrame({"id": [v["id"] for v in r], "irank": [v["irank"] for v in r], "d": np.where(np.isinf(best), np.nan, best)})

    got = pairs.mapInPandas(run, "id long, irank int, d double")
    return got.groupBy("id", "irank").agg(F.min(F.when(~F.isnan("d"), F.col("d"))).alias("d"))


# -- rivers -----------------------------------------------------------------------

def river_edges(lines: DataFrame) -> DataFrame:
    """(way_id, width, a, b): the segments of lines (way_id, width, pts), ends as struct<x,y>."""
    n = F.size("pts")
    seg = F.zip_with(F.slice("pts", 1, n - 1), F.slice("pts", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return lines.where(n >= 2).select("way_id", "width", F.explode(seg).alias("s")).select("way_id", "width", "s.a", "s.b").where("a <> b")


def river_merge(edges: DataFrame) -> DataFrame:
    """Edges with the number of segments at each end: where exactly two meet, a chain goes on."""
    ends = edges.select(F.col("a").alias("p")).union(edges.select(F.col("b").alias("p"))).groupBy("p").agg(F.count("*").alias("degree"))
    return edges.join(ends.select(F.col("p").alias("a"), F.col("degree").alias("from_degree")), "a").join(ends.select(F.col("p").alias("b"), F.col("degree").alias("to_degree")), "b")


def river_chains(lines: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(way_id, width, pts): segments of lines (way_id, width, pts) joined wherever one ends, one begins and no other meets.

    A chain has the id of its first segment's way and the largest width (null: 0).
    A ring without a branch begins at its smallest point. Chains are found by
    doubling: in round k a segment knows the one 2^k before it, so rounds grow
    with the logarithm of the longest chain; ``store`` writes a round's table
    under a name and reads it back. Empty: empty.
    """
    n = F.size("pts")
    seg = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k"), F.element_at("pts", k).alias("a"), F.element_at("pts", k + 1).alias("b")))
    segs = lines.where(n >= 2).select("way_id", F.coalesce("width", F.lit(0.0)).alias("width"), F.explode(seg).alias("s"))
    segs = store(segs.select(F.struct("way_id", "s.k").alias("id"), "width", "s.a", "s.b").where("a <> b"), "segments")
    ends = segs.select(F.col("a").alias("p"), F.lit(1).alias("out")).unionAll(segs.select("b", F.lit(0)))
    through = ends.groupBy("p").agg(F.count("*").alias("n"), F.sum("out").alias("out")).where("n = 2 AND out = 1").select("p")
    before = segs.select(F.col("b").alias("p"), F.col("id").alias("prev")).join(through, "p")
    # at: the segment so many steps back; least: the smallest (point, id) from here to before it; done: at is the chain's first.
    start = F.struct("a", "id")
    now = segs.join(before.withColumnRenamed("p", "a"), "a", "left").select("id", F.coalesce("prev", "id").alias("at"), F.col("prev").isNotNull().cast("long").alias("steps"), start.alias("least"), F.col("prev").isNull().alias("done"))
    now, k = store(now, "links-0"), 0
    first = None
    while True:
        k += 1
        back = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        live = now.where("NOT done").join(back, "at").select(
            "id", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"), (F.col("least2") < F.col("least")).alias("fell"))
        now = store(now.where("done").withColumn("fell", F.lit(False)).unionByName(live), f"links-{k}")
        left = now.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("live"), F.count_if(F.col("fell") & ~F.col("done")).alias("fell")).first()
        now = now.drop("fell")
        if left["live"] == 0:
            break
        if left["done"] == first and left["fell"] == 0:  # only rings are left: each is cut before its smallest point
            ring = now.where("NOT done").select("id", F.col("least.id").alias("head")).join(before.join(segs.select("id", F.col("a").alias("p")), "p").select("id", "prev"), "id")
            cut = F.col("id") == F.col("head")
            ring = ring.select("id", F.when(cut, F.col("id")).otherwise(F.col("prev")).alias("at"), (~cut).cast("long").alias("steps"), F.struct(F.lit(None).cast(segs.schema["a"].dataType).alias("a"), "id").alias("least"), cut.alias("done"))
            now = store(now.where("done").unionByName(ring), f"rings-{k}")
        first = left["done"]
    joined = now.select("id", F.col("at").alias("head"), "steps").join(segs, "id")
    chain = joined.groupBy("head").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("steps", "a", "b"))).alias("s"))
    return chain.select("head.way_id", "width", F.concat(F.array(F.element_at("s", 1)["a"]), F.transform("s", lambda v: v["b"])).alias("pts"))


def rivers(lines: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(way_id, width, pts): chains of lines (way_id, width, pts), each as wide as the widest that flows into it."""
    c = store(river_chains(lines, store).withColumn("from", F.element_at("pts", 1)).withColumn("to", F.element_at("pts", -1)), "chains")
    wide = propagate_width(c.select("from", "to", "width"), lambda df, k: store(df, f"widths-{k}"))
    inflow = wide.groupBy(F.col("to").alias("from")).agg(F.max("width").alias("w"))
    return c.join(inflow, "from", "left").select("way_id", F.greatest("width", F.coalesce("w", "width")).alias("width"), "pts")


def propagate_width(edges: DataFrame, store: Callable[[DataFrame, int], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """(from, to, width) with each width raised to the largest upstream; loops settle, since widths only rise.

    Each round joins what rose with the edges that leave its end; ``store``
    writes a round's table (its number is given) and reads it back, which cuts
    the lineage.
    """
    best = store(edges.groupBy("from", "to").agg(F.max("width").alias("width")), 0)
    rose = best
    for k in range(1, max_rounds):
        at = rose.groupBy(F.col("to").alias("from")).agg(F.max("width").alias("w"))
        step = best.join(at, "from").where("w > width").select("from", "to", F.col("w").alias("width"))
        rose = store(step, 2 * k)
        if rose.isEmpty():
            return best
        best = store(best.join(rose.withColumnRenamed("width", "w"), ["from", "to"], "left").select("from", "to", F.coalesce("w", "width").alias("width")), 2 * k + 1)
    raise RuntimeError("widths did not settle")


def river_widths(lines: DataFrame, areas: DataFrame, size: float = 10.0) -> DataFrame:
    """(way_id, width) of lines (way_id, width, geom): where it is null, that of the areas (area_id, width, geom) which cover the line.

    A line of three points at least that the union of areas covers gets the mean
    of their widths, weighted by the length within each (areas may overlap, the
    sum is over the line's length) and leaving out areas that it also touches at
    a lone point. Areas without a width have twice the radius of their largest
    inscribed circle. Lines and areas meet by cells of ``size`` of their boxes;
    the kernel takes an area with all its lines of a batch at once. Lines that
    are not covered keep null.
    """
    from .spatial import cells

    def dealt(df):
        return df.withColumn("cell", F.explode(cells(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), size)))

    wide = areas.select("geom", F.coalesce("width", st.inscribed_width("geom")).alias("area_width"), st.bbox("geom").alias("b")).where("b IS NOT NULL")
    wide = dealt(wide).select("cell", F.col("b").alias("c"), F.col("geom").alias("area"), "area_width")
    boxes = "x0 double, y0 double, x1 double, y1 double"
    kind = lines.schema["way_id"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in batches:
            m = B.line_measures(v.column(1))
            more = pa.array(m[0] > 2)
            b = pa.StructArray.from_arrays([pa.array(c) for c in m[2:]], fields=list(B.BOX))
            yield pa.RecordBatch.from_arrays([c.filter(more) for c in (v.column(0), v.column(1), pa.array(m[1]), b)], names=["way_id", "geom", "len", "b"])

    asked = lines.where("width IS NULL").select("way_id", "geom").mapInArrow(measured, f"way_id {kind}, geom binary, len double, b struct<{boxes}>")
    hit = dealt(asked).join(wide, "cell").where("b.x0 <= c.x1 AND b.x1 >= c.x0 AND b.y0 <= c.y1 AND b.y1 >= c.y0")
    once = [F.col(f"cell.{i}") == F.floor(F.greatest(f"b.{v}", f"c.{v}") / size) for i, v in (("i", "x0"), ("j", "y0"))]
    met = hit.where(once[0] & once[1]).select("way_id", "len", "area_width", "geom", "area")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for v in batches:
            kept.append(v)
            if sum(map(len, kept)) >= 50_000 or sum(r.nbytes for r in kept) >= 64 << 20:
                yield from cut(kept)
                kept = []
        if kept:
            yield from cut(kept)

    def cut(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, length, width, geom, area = (pa.concat_arrays([v.column(k) for v in kept]) for k in range(5))
        area = area.dictionary_encode()
        of, known = area.indices.to_numpy(), [S.from_ewkb(v) for v in area.dictionary.to_pylist()]
        spans = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        got, rest = B.parse_lines(geom)
        for rows, pts in got:
            order = np.argsort(of[rows], kind="stable")
            for part in np.split(order, np.nonzero(np.diff(of[rows[order]]))[0] + 1):
                if len(part):
                    k, x, y = B.spans_of_lines(pts[part], known[of[rows[part[0]]]])
                    spans.append((rows[part][k], x, y))
        for k, v in zip(rest.tolist(), geom.take(pa.array(rest)).to_pylist(), strict=True):
            s = S.spans_within(S.from_ewkb(v), known[of[k]])
            spans.append((np.full(len(s), k), *np.array(s, float).reshape(-1, 2).T))
        row, x, y = (np.concatenate([v[k] for v in spans]) for k in range(3))
        order = np.argsort(row, kind="stable")
        row, x, y = row[order], x[order], y[order]
        first = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0] if len(row) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(first, len(row)).astype(np.int32))
        at = row[first]
        far = length.to_numpy(zero_copy_only=False)[at]
        lone = np.logical_or.reduceat(y - x <= far[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))] * 1e-9, first) if len(row) else np.zeros(0, bool)
        part = np.add.reduceat(y - x, first) if len(row) else np.zeros(0)
        w = width.to_numpy(zero_copy_only=False).astype(float)[at]
        share = pa.array(part * w, mask=lone | np.isnan(w))
        s = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"]))
        yield pa.RecordBatch.from_arrays([way.take(pa.array(at)), pa.array(far), share, s], names=["way_id", "len", "share", "s"])

    spans = met.mapInArrow(within, f"way_id {kind}, len double, share double, s array<struct<a:double,b:double>>")
    of = spans.groupBy("way_id").agg(F.max("len").alias("len"), F.sum("share").alias("sum"), F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    thin = F.col("len") * 1e-9
    reach = F.aggregate("s", F.lit(0.0), lambda v, p: F.when(p["a"] <= v + thin, F.greatest(v, p["b"])).otherwise(v))
    got = of.where(reach >= F.col("len") - thin).select("way_id", (F.col("sum") / F.col("len")).alias("w"))
    return lines.select("way_id", "width").join(got, "way_id", "left").select("way_id", F.coalesce("width", "w").alias("width"))


# -- drawing ------------------------------------------------------------------------

def fill(canvas: np.ndarray, rings: list[np.ndarray]) -> None:
    """Set the pixels whose centres lie within, even-odd."""
    n = canvas.shape[0]
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    rows = np.arange(max(0, int(np.floor(a[:, 1].min()))), min(n, int(np.ceil(a[:, 1].max())) + 1))
    y = rows[:, None] + 0.5
    cut = (a[:, 1] > y) != (b[:, 1] > y)
    rise = np.where(a[:, 1] == b[:, 1], 1.0, b[:, 1] - a[:, 1])
    xs = np.sort(np.where(cut, a[:, 0] + (y - a[:, 1]) / rise * (b[:, 0] - a[:, 0]), np.inf), axis=1)
    most = int(cut.sum(axis=1).max(initial=0))
    at = np.arange(n)
    for k in range(0, most, 2):
        u, v = xs[:, k, None], xs[:, k + 1, None]
        canvas[rows] |= (at >= np.ceil(u - 0.5)) & (at < np.floor(v - 0.5) + 1) & np.isfinite(v)


def fill_many(canvas: np.ndarray, rings: np.ndarray, block: int = 20_000) -> None:
    """``fill`` with each of many polygons of one ring [polygon, point, xy]: the ends of their rows' spans are counted, then added up."""
    n = canvas.shape[0]
    low, high = rings[:, :, 1].min(axis=1), rings[:, :, 1].max(axis=1)
    rings = rings[(high > 0) & (low < n)]
    if not len(rings):
        return
    first, last = max(0, int(np.floor(low.min()))), min(n, int(np.ceil(high.max())) + 1)
    y = np.arange(first, last) + 0.5
    ends, base = np.zeros((last - first) * (n + 1), np.int64), np.arange(last - first) * (n + 1)
    begun, ended, size = [], [], 0

    def count(at, u, v):
        nonlocal size
        a, b = np.clip(np.ceil(u - 0.5), 0, n), np.clip(np.floor(v - 0.5) + 1, 0, n)
        begun.append((at + a).astype(np.int64).ravel())
        ended.append((at + np.maximum(a, b)).astype(np.int64).ravel())
        size += len(begun[-1])
        if size > 1 << 20:
            add()

    def add():
        nonlocal size
        if begun:
            ends[:] += np.bincount(np.concatenate(begun), minlength=len(ends)) - np.bincount(np.concatenate(ended), minlength=len(ends))
        begun.clear()
        ended.clear()
        size = 0

    step = max(1, block // len(y))
    for k in range(0, len(rings), step):
        r = rings[k : k + step]
        u, v, met = np.full((len(r), len(y)), np.inf), np.full((len(r), len(y)), -np.inf), np.zeros((len(r), len(y)), np.int16)
        above = r[:, :, 1:] > y
        xs = []
        for e in range(r.shape[1] - 1):
            a0, a1, b0, b1 = r[:, e, :1], r[:, e, 1:], r[:, e + 1, :1], r[:, e + 1, 1:]
            cut = above[:, e] != above[:, e + 1]
            x = y - a1
            x /= np.where(a1 == b1, 1.0, b1 - a1)
            x *= b0 - a0
            x += a0
            np.minimum(u, x, out=u, where=cut)
            np.maximum(v, x, out=v, where=cut)
            met += cut
            x[~cut] = np.inf
            xs.append(x)
        most = int(met.max())
        if most > 2:
            at = np.nonzero(met > 2)
            more = np.sort(np.stack([x[at] for x in xs], axis=1), axis=1)
            for j in range(0, most, 2):
                o = np.isfinite(more[:, j + 1])
                count(base[at[1][o]], more[o, j], more[o, j + 1])
            v[at] = -np.inf
        count(base, u, v)
    add()
    canvas[first:last] |= ends.reshape(-1, n + 1).cumsum(axis=1)[:, :n] > 0


def dilate(c: np.ndarray, r: int) -> np.ndarray:
    """Square structuring element, by running sums along each axis."""
    for axis in (0, 1):
        pad = [(r + 1, r) if k == axis else (0, 0) for k in (0, 1)]
        s = np.pad(c.astype(np.int32), pad).cumsum(axis=axis)
        n = c.shape[axis]
        c = np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(s, range(0, n), axis) > 0
    return c


def erode(c: np.ndarray, r: int) -> np.ndarray:
    return ~dilate(~c, r)


def open_close(c: np.ndarray, r: int) -> np.ndarray:
    """Close gaps, then drop what is thinner: dilate, erode twice as far, dilate."""
    return dilate(erode(dilate(c, r), 2 * r), r) if r else c


def trace(c: np.ndarray, least: int = 0) -> list[list[list[tuple[float, float]]]]:
    """Polygons along the pixels' edges; rings of fewer than ``least`` pixels are dropped."""
    p = np.pad(c, 1)
    h, v = p[1:, :] != p[:-1, :], p[:, 1:] != p[:, :-1]
    lines = [[(float(x - 1), float(y)), (float(x), float(y))] for y, x in zip(*np.nonzero(h), strict=True)]
    lines += [[(float(x), float(y - 1)), (float(x), float(y))] for y, x in zip(*np.nonzero(v), strict=True)]
    out = []
    for poly in S.assemble(lines, most_splits=1 << 30) or []:
        rings = [_straight(r) for r in poly if abs(S._shoelace(r)) >= least]
        if rings and abs(S._shoelace(poly[0])) >= least:
            out.append(rings)
    return out


def _straight(r):
    pts = r[:-1]
    keep = [p for k, p in enumerate(pts) if S._cross(pts[k - 1], p, pts[(k + 1) % len(pts)]) != 0]
    return [*keep, keep[0]]


RASTER = "tx int, ty int, grp string, geom binary, area double"


def raster_union(tiles: DataFrame, zoom: int, extent: int = 256, margin: float = 0.1, buffer: int = 2, least: int = 0, builtup: bool = False) -> DataFrame:
    """(tx, ty, grp, geom, area) of shapes (tx, ty, grp, layer, geom in 3857): a union for each tile and group.

    Shapes are drawn on a canvas of the tile and its margin, gaps closed and thin
    parts dropped, and the rest traced along pixel edges, which approximates the
    outline within a pixel. With ``builtup`` each layer is opened and closed by
    itself and the layers are joined. Shapes are drawn where they lie; canvases,
    not shapes, are dealt by tile (``drawn``).
    """
    width = EARTH / (1 << zoom)
    pad = int(extent * margin)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty, grp = key
        x0, y1 = tx * width - EARTH / 2, EARTH / 2 - ty * width
        whole = _union(_layers(pdf, extent + 2 * pad), buffer)
        inner = whole[pad : pad + extent, pad : pad + extent]
        out = []
        for rings in trace(inner, least):
            back = [[(x0 + x / extent * width, y1 - y / extent * width) for x, y in r] for r in rings]
            g = S.Geom("POLYGON", back, 3857)
            out.append((tx, ty, grp, S.to_ewkb(g), S.area(g)))
        return pd.DataFrame(out, columns=["tx", "ty", "grp", "geom", "area"])

    return drawn(tiles, zoom, extent, pad, builtup).groupBy("tx", "ty", "grp").applyInPandas(run, RASTER)


def drawn(tiles: DataFrame, zoom: int, extent: int, pad: int, apart: bool, rows: int = 100_000, canvases: int = 200) -> DataFrame:
    """(tx, ty, grp, layer, top, left, height, width, bits): what each task drew of a tile, group and layer (without ``apart``: of all layers).

    About ``rows`` shapes are drawn at a time, each canvas by itself. A task
    holds at most so many ``canvases`` and hands the rest on, cut to what is set
    in them, a bit a pixel.
    """
    width, n = EARTH / (1 << zoom), extent + 2 * pad

    def crop(c: np.ndarray) -> tuple[int, int, int, int, bytes]:
        ys, xs = np.nonzero(c.any(axis=1))[0], np.nonzero(c.any(axis=0))[0]
        if not len(ys):
            return 0, 0, 0, 0, b""
        part = c[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
        return int(ys[0]), int(xs[0]), *part.shape, np.packbits(part).tobytes()

    def draw(canvas: np.ndarray, tx: int, ty: int, raw: pa.Array) -> None:
        x0, y1 = tx * width - EARTH / 2, EARTH / 2 - ty * width
        place = lambda x, y: ((x - x0) / width * extent + pad, (y1 - y) / width * extent + pad)
        got, rest = B.parse_polygons(raw)
        for _, _, r in got:
            fill_many(canvas, np.stack(place(r[..., 0], r[..., 1]), axis=-1))
        for v in raw.take(pa.array(rest)).to_pylist():
            for p in S.from_ewkb(v).parts:
                for poly in p.parts:
                    if poly.kind == "POLYGON":
                        one = np.zeros((n, n), bool)
                        fill(one, [np.array([place(x, y) for x, y in r]) for r in poly.data])
                        canvas |= one

    def hand_on(held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for k in range(0, len(keys), 64):
            made = [(*key, *crop(held.pop(key))) for key in keys[k : k + 64]]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, m, strict=True)) for m in made], schema)

    schema = pa.schema([("tx", pa.int32()), ("ty", pa.int32()), ("grp", pa.string()), ("layer", pa.string()), ("top", pa.int32()), ("left", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("bits", pa.binary())])

    def take(kept: list[pa.RecordBatch], held: dict) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(kept).combine_chunks()
        codes, values = np.zeros(len(t), np.int64), []
        for c in t.columns[:4]:
            d = c.combine_chunks().dictionary_encode("encode")
            d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
            values.append(d.dictionary.to_pylist())
            codes = np.unique(codes * len(values[-1]) + d.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        geom = t.column(4).combine_chunks()
        geom = geom.chunk(0) if isinstance(geom, pa.ChunkedArray) else geom
        for rows in np.split(order, np.nonzero(np.diff(codes[order]))[0] + 1) if len(order) else ():
            key = tuple(t.column(k)[int(rows[0])].as_py() for k in range(4))
            if key not in held and len(held) >= canvases:
                yield from hand_on(held)
            draw(held.setdefault(key, np.zeros((n, n), bool)), key[0], key[1], geom.take(pa.array(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kept: list = []
        for b in batches:
            kept.append(b)
            if sum(len(v) for v in kept) >= rows or sum(v.nbytes for v in kept) >= 64 << 20:
                yield from take(kept, held)
                kept = []
        if kept:
            yield from take(kept, held)
        yield from hand_on(held)

    layer = F.col("layer").cast("string") if apart else F.lit("")
    df = tiles.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.col("grp").cast("string").alias("grp"), layer.alias("layer"), "geom")
    return df.mapInArrow(run, "tx int, ty int, grp string, layer string, top int, left int, height int, width int, bits binary")


def _layers(pdf: pd.DataFrame, n: int) -> list[np.ndarray]:
    """A tile's parts of ``drawn`` put together, a canvas for each layer."""
    layers: dict = {}
    for layer, top, left, height, width, bits in pdf[["layer", "top", "left", "height", "width", "bits"]].itertuples(index=False):
        canvas = layers.setdefault(layer, np.zeros((n, n), bool))
        canvas[top : top + height, left : left + width] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)
    return list(layers.values()) or [np.zeros((n, n), bool)]


def _union(layers: list[np.ndarray], buffer: int) -> np.ndarray:
    return np.logical_or.reduce([open_close(c, buffer) for c in layers])


def png(c: np.ndarray) -> bytes:
    """A canvas as a grey image of eight bits, set pixels white."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.pad(c.astype(np.uint8) * 255, ((0, 0), (1, 0))).tobytes()  # before each line the number of its filter: none
    head = struct.pack(">IIBBBBB", c.shape[1], c.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _corner(tx: int, ty: int, zoom: int, extent: int, pad: int) -> tuple[float, float, float]:
    """A pixel's size, and the upper left corner of a tile with its margin."""
    pixel = EARTH / (1 << zoom) / extent
    return pixel, tx * extent * pixel - EARTH / 2 - pad * pixel, EARTH / 2 - ty * extent * pixel + pad * pixel


def world_file(tx: int, ty: int, zoom: int, extent: int, pad: int) -> str:
    """The text beside an image that places it: pixel sizes, no rotation, the centre of the upper left pixel."""
    pixel, x, y = _corner(tx, ty, zoom, extent, pad)
    return f"{pixel}\n0.0\n0.0\n-{pixel}\n{x + pixel / 2}\n{y - pixel / 2}\n"


def raster_wkb(c: np.ndarray, tx: int, ty: int, zoom: int, pad: int) -> bytes:
    """A canvas in the binary format of spatial databases: a header, one band of eight bits without a missing value."""
    n = c.shape[0]
    pixel, x, y = _corner(tx, ty, zoom, n - 2 * pad, pad)
    return struct.pack("<BHH6diHHBB", 1, 0, 1, pixel, -pixel, x, y, 0.0, 0.0, 3857, n, n, 4, 0) + (c.astype(np.uint8) * 255).tobytes()


def raster_files(tiles: DataFrame, zoom: int, extent: int = 256, margin: float = 0.1, buffer: int = 2, builtup: bool = False) -> DataFrame:
    """(tx, ty, grp, name, png, wld, wkb): what raster_union drew, to look at: before it closed gaps (names end in i) and after (o).

    A name is tile, group and stage; a writer adds folder and ending.
    """
    pad = int(extent * margin)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty, grp = key
        layers = _layers(pdf, extent + 2 * pad)
        name = f"{tx}-{ty}-{grp}-" if isinstance(grp, str) and grp else f"{tx}-{ty}-"
        two = (("i", np.logical_or.reduce(layers)), ("o", _union(layers, buffer)))
        return pd.DataFrame([(tx, ty, grp, name + v, png(c), world_file(tx, ty, zoom, extent, pad), raster_wkb(c, tx, ty, zoom, pad)) for v, c in two], columns=["tx", "ty", "grp", "name", "png", "wld", "wkb"])

    return drawn(tiles, zoom, extent, pad, builtup).groupBy("tx", "ty", "grp").applyInPandas(run, "tx int, ty int, grp string, name string, png binary, wld string, wkb binary")


def vector_union(tiles: DataFrame, zoom: int, margin: float = 0.0, buffer: int = 1, extent: int = 512) -> DataFrame:
    """As raster_union on a finer canvas: there is no exact buffering here, so the outline is approximated within a pixel."""
    return raster_union(tiles, zoom, extent, margin, buffer)


# -- by tile ---------------------------------------------------------------------------

def extent_tiles(spark: SparkSession, box: DataFrame, zoom: int) -> DataFrame:
    """(tx, ty) of all tiles of a box (x0, y0, x1, y1 in 3857; one row)."""
    from .spatial import tile_join

    return tile_join(box, zoom).select("tx", "ty").distinct()


def tile_batch(dirty: DataFrame, zoom: int, size: int | None = None) -> DataFrame:
    """The next tiles of a zoom from a table of expired ones, oldest first."""
    rows = dirty.where(F.col("zoom") == zoom).orderBy("first", "x", "y")
    return (rows.limit(size) if size else rows).select(F.col("x").alias("tx"), F.col("y").alias("ty"))


def tile_sql(spark: SparkSession, template: str, tiles: DataFrame, zoom: int, params: dict | None = None) -> DataFrame:
    """One set-based query for all tiles: ``{tiles}`` stands for a table with their numbers and boxes, other names for parameters."""
    b = tile_box(F.col("tx"), F.col("ty"), F.lit(zoom))
    tiles.withColumn("b", b).select("tx", "ty", "b.*").createOrReplaceTempView("gen_tiles")
    return spark.sql(template.format(tiles="gen_tiles", ZOOM=zoom, **(params or {})))


def run_sql(spark: SparkSession, sql: str, if_has_rows: DataFrame | None = None, append: bool = False) -> DataFrame | None:
    """A query; with ``if_has_rows`` and in append mode only if that has any."""
    return None if append and if_has_rows is not None and if_has_rows.isEmpty() else spark.sql(sql)


def replace_tiles(old: DataFrame, tiles: DataFrame, new: DataFrame) -> DataFrame:
    """A tile table without the rows of some tiles, and with the new ones."""
    return old.join(tiles.select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct(), ["x", "y"], "left_anti").unionByName(new)


STRATEGIES = {"vector-union": vector_union, "raster-union": raster_union, "builtup": raster_union, "rivers": rivers, "discrete-isolation": discrete_isolation, "tile-sql": tile_sql}


def strategy(name: str) -> Callable:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}")
    return STRATEGIES[name]
