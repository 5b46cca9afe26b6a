"""Which map tiles a geometry touches, and what becomes of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.coords import EARTH, quadkey, tile_coord
from ..functions.st import arrow_fn

TILES = "array<struct<x:int,y:int>>"


@dataclass(frozen=True)
class ExpireConfig:
    """mode: full_area, boundary_only or hybrid; buffer in tiles; area limit in mercator units (hybrid)."""

    mode: str = "full_area"
    buffer: float = 0.1
    full_area_limit: float = 0.0

    def __post_init__(self):
        if self.mode not in ("full_area", "boundary_only", "hybrid"):
            raise ValueError(f"expire mode {self.mode!r}")


@dataclass(frozen=True)
class ExpireOutput:
    """Where tiles go, their zooms, and the most tiles of one geometry change and of a run."""

    filename: str = ""
    table: str = ""
    maxzoom: int = 15
    minzoom: int | None = None
    max_tiles_geometry: int = 10_000_000
    max_tiles_overall: int = 50_000_000

    def __post_init__(self):
        low = self.maxzoom if self.minzoom is None else self.minzoom
        if not (self.filename or self.table):
            raise ValueError("a filename or a table is needed")
        if not 1 <= self.maxzoom <= 20 or not 1 <= low <= self.maxzoom:
            raise ValueError("zooms are 1 to 20, the least not above the most")
        if not all(1 <= v <= 4 << 20 or v in (10_000_000, 50_000_000) for v in (self.max_tiles_geometry, self.max_tiles_overall)):
            raise ValueError("tile limits")


def point_tiles(mx: Column, my: Column, zoom: int, buffer: float = 0.1) -> Column:
    """Tiles within a buffer of a point, cut off towards zero; x wraps round the date line, y is held within the map."""
    width = 1 << zoom
    tx, ty = tile_coord(mx, zoom, "x"), tile_coord(my, zoom, "y")
    whole = lambda c: c.cast("int")
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(width - 1), c))
    xs = F.sequence(whole(tx - buffer), whole(tx + buffer))
    ys = F.sequence(hold(whole(ty - buffer)), hold(whole(ty + buffer)))
    return F.array_distinct(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(F.pmod(x, F.lit(width)).alias("x"), y.alias("y"))))))


def _to_tile(p, width):
    return width * (0.5 + p[0] / EARTH), width * (0.5 - p[1] / EARTH)


def _box(out: set, x0, y0, x1, y1, width, buffer):
    for x in range(int(min(x0, x1) - buffer), int(max(x0, x1) + buffer) + 1):
        for y in range(max(0, min(width - 1, int(min(y0, y1) - buffer))), max(0, min(width - 1, int(max(y0, y1) + buffer))) + 1):
            out.add((x % width, y))


def _line(out: set, pts, width, buffer):
    """Steps of 0.4 tiles along each segment; a segment over half the map crosses the date line."""
    for a, b in zip(pts, pts[1:], strict=False):
        (x0, y0), (x1, y1) = sorted((_to_tile(a, width), _to_tile(b, width)))
        if x1 - x0 > width / 2:
            x0, y0, x1, y1 = x1, y1, x0 + width, y0
        far = math.hypot(x1 - x0, y1 - y0)
        if far == 0:
            _box(out, x0, y0, x0, y0, width, buffer)
            continue
        sx, sy = (x1 - x0) / far * 0.4, (y1 - y0) / far * 0.4
        n = int(far / 0.4)
        for k in range(n + 1):
            ax, ay = x0 + k * sx, y0 + k * sy
            bx, by = (ax + sx, ay + sy) if k < n else (x1, y1)
            _box(out, ax, ay, bx, by, width, buffer)


def _fill(out: set, rings, width):
    """Even-odd spans of the rows of tiles between the crossings of their edges."""
    ts = [[_to_tile(p, width) for p in r] for r in rings]
    ys = [p[1] for r in ts for p in r]
    for row in range(max(0, int(min(ys))), min(width - 1, int(max(ys))) + 1):
        for line in (row, row + 1):
            xs = sorted(a[0] + (line - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for r in ts for a, b in zip(r, r[1:], strict=False) if (a[1] > line) != (b[1] > line))
            for u, v in zip(xs[::2], xs[1::2], strict=False):
                out.update((x % width, row) for x in range(int(math.floor(u)), int(math.floor(v)) + 1))


def tiles_of(g: S.Geom, zoom: int, config: ExpireConfig = ExpireConfig()) -> set[tuple[int, int]]:
    """Tiles of a geometry in 3857."""
    out: set = set()
    width = 1 << zoom
    if g.kind == "POINT":
        x, y = _to_tile(g.data, width)
        _box(out, x, y, x, y, width, config.buffer)
    elif g.kind == "LINESTRING":
        _line(out, g.data, width, config.buffer)
    elif g.kind in ("POLYGON", "MULTIPOLYGON"):
        parts = [g] if g.kind == "POLYGON" else g.parts
        for p in parts:
            for r in p.data:
                _line(out, r, width, config.buffer)
        b = S.bbox(g)  # the mode is decided once, on the whole
        if len(out) > 1 and (config.mode == "full_area" or (config.mode == "hybrid" and max(b[2] - b[0], b[3] - b[1]) <= config.full_area_limit)):
            for p in parts:
                _fill(out, p.data, width)
    else:
        for p in g.parts:
            out |= tiles_of(p, zoom, config)
    return out


def geometry_tiles(geom: Column | str, zoom: int, config: ExpireConfig = ExpireConfig()) -> Column:
    """Tiles of EWKB geometries in 3857, as a UDF."""
    return F.coalesce(arrow_fn(lambda raw: [{"x": x, "y": y} for x, y in sorted(tiles_of(S.from_ewkb(raw), zoom, config))], TILES)(geom), F.array().cast(TILES))


def line_tiles(pts: Column, zoom: int, buffer: float = 0.0, step: float = 0.4) -> Column:
    """Tiles of a line (array<struct<x,y>> in 3857) by Catalyst alone: the boxes of steps of 0.4 tiles, from the western end on.

    A segment over half the map crosses the date line: its western end goes round.
    """
    from ..functions.coords import segments

    width = 1 << zoom
    at = F.transform(pts, lambda p: F.struct(tile_coord(p["x"], zoom, "x").alias("x"), tile_coord(p["y"], zoom, "y").alias("y")))
    hold = lambda c: F.greatest(F.lit(0), F.least(F.lit(width - 1), c))

    def ends(s: Column) -> Column:
        low, high = F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])
        over = high["x"] - low["x"] > width / 2
        a = F.when(over, high).otherwise(low)
        b = F.when(over, F.struct((low["x"] + width).alias("x"), low["y"].alias("y"))).otherwise(high)
        far = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        return F.struct(a.alias("a"), b.alias("b"), far.alias("far"))

    def boxes(s: Column) -> Column:
        n = (s["far"] / step).cast("int")
        move = lambda c: F.when(s["far"] > 0, (s["b"][c] - s["a"][c]) / s["far"] * step).otherwise(0.0)

        def one(k: Column) -> Column:
            begin = {c: s["a"][c] + k * move(c) for c in "xy"}
            end = {c: F.when(k < n, begin[c] + move(c)).otherwise(s["b"][c]) for c in "xy"}
            lo = lambda c: F.least(begin[c], end[c]) - buffer
            hi = lambda c: F.greatest(begin[c], end[c]) + buffer
            xs = F.sequence(lo("x").cast("int"), hi("x").cast("int"))
            ys = F.sequence(hold(lo("y").cast("int")), hold(hi("y").cast("int")))
            return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(F.pmod(x, F.lit(width)).alias("x"), y.alias("y")))))

        return F.flatten(F.transform(F.sequence(F.lit(0), n), one))

    return F.array_distinct(F.flatten(F.transform(F.transform(segments(at), ends), boxes)))


def _step_tiles(line, ax, ay, bx, by, width: int, buffer: float, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, x, y), distinct, of segments (the number of their line, ends in tiles): what ``line_tiles`` does, on arrays."""
    turn = (ax > bx) | ((ax == bx) & (ay > by))
    ax, ay, bx, by = np.where(turn, bx, ax), np.where(turn, by, ay), np.where(turn, ax, bx), np.where(turn, ay, by)
    over = bx - ax > width / 2
    ax, ay, bx, by = np.where(over, bx, ax), np.where(over, by, ay), np.where(over, ax + width, bx), np.where(over, ay, by)
    far = np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    n = (far / step).astype(np.int64)
    some = np.where(far > 0, far, 1.0)
    mx, my = (bx - ax) / some * step, (by - ay) / some * step
    of = np.repeat(np.arange(len(n)), n + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    last = k == n[of]
    ends = []
    for begin, move, end in ((ax, mx, bx), (ay, my, by)):
        m = move[of]
        u = begin[of] + k * m
        v = np.where(last, end[of], u + m)
        ends += [(np.minimum(u, v) - buffer).astype(np.int64), (np.maximum(u, v) + buffer).astype(np.int64)]
    x0, x1, y0, y1 = ends
    y0, y1 = np.clip(y0, 0, width - 1), np.clip(y1, 0, width - 1)
    new = np.ones(len(of), bool)  # a step in the same box as the one before adds nothing
    new[1:] = (of[1:] != of[:-1]) | (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1]) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1])
    x0, x1, y0, y1, of = x0[new], x1[new], y0[new], y1[new], line[of[new]]
    codes = []
    for dx in range(int((x1 - x0).max(initial=-1)) + 1):
        for dy in range(int((y1 - y0).max(initial=-1)) + 1):
            o = (x0 + dx <= x1) & (y0 + dy <= y1)
            codes.append((of[o] * width + (x0[o] + dx) % width) * width + y0[o] + dy)
    code = np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    return code // (width * width), code // width % width, code % width


def line_tile_rows(lines: DataFrame, key: str, line: str, zoom: int, buffer: float = 0.0, step: float = 0.4, block: int = 200_000) -> DataFrame:
    """(key, x, y): the tiles of ``line_tiles`` as rows, each line's once; steps are made about ``block`` at a time in numpy."""
    width = 1 << zoom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l = b.column(1)
            p, size = l.flatten(), np.diff(l.offsets.to_numpy())
            x, y = (p.field(c).to_numpy(zero_copy_only=False) for c in "xy")
            x, y = width * (0.5 + x / EARTH), width * (0.5 - y / EARTH)
            of = np.repeat(np.arange(len(size)), size)
            a = np.nonzero(of[1:] == of[:-1])[0]
            # Blocks end where a line does: a line's tiles are made distinct at once.
            dx = np.abs(x[a + 1] - x[a])
            steps = np.cumsum((np.where(dx > width / 2, width - dx, dx) + np.abs(y[a + 1] - y[a])) / step + 1)
            until = np.searchsorted(steps, np.arange(block, (steps[-1] if len(a) else 0) + block, block))
            until = np.unique(np.searchsorted(of[a], of[a][np.minimum(until, len(a) - 1)], "right")) if len(a) else []
            begin = 0
            for end in until:
                s = a[begin:end]
                begin = end
                at, tx, ty = _step_tiles(of[s], x[s], y[s], x[s + 1], y[s + 1], width, buffer, step)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(tx.astype(np.int32)), pa.array(ty.astype(np.int32))], names=[key, "x", "y"])

    df = lines.select(key, line).where(F.col(line).isNotNull())
    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, x int, y int")


def deleted_tiles(objects: DataFrame, deleted: DataFrame, zoom: int, config: ExpireConfig = ExpireConfig(), geom: str = "geom") -> DataFrame:
    """(id, x, y): tiles of what objects (id, geometry in 3857) were, of those that are ``deleted`` (id)."""
    gone = objects.join(deleted.select("id").distinct(), "id", "left_semi")
    return gone.select("id", F.explode(geometry_tiles(geom, zoom, config)).alias("t")).select("id", "t.x", "t.y")


def limit_tiles(tiles: DataFrame, by: str, most: int) -> DataFrame:
    """Without all tiles of those changes (``by``) that touch more than ``most``; counts are combined before the shuffle."""
    n = tiles.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(by)
    return tiles.join(n, by, "left_anti")


def limit_overall(tiles: DataFrame, by: str, most: int) -> DataFrame:
    """Changes in order of ``by`` until they have ``most`` tiles; tile counts by change, not tiles, are added up."""
    n = tiles.groupBy(by).agg(F.count("*").alias("__n"))
    dealt = n.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id())
    dealt = dealt.withColumn("__in", F.expr(f"sum(__n) OVER (PARTITION BY __part ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    parts = dealt.groupBy(F.col("__part").alias("__p")).agg(F.sum("__n").alias("__all"))  # a row for each range
    parts = parts.withColumn("__before", F.expr("sum(__all) OVER (ORDER BY __p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - __all"))
    kept = dealt.join(F.broadcast(parts), F.col("__part") == F.col("__p")).where(F.col("__before") + F.col("__in") <= most)
    return tiles.join(kept.select(by), by, "left_semi")


def roll_up(tiles: DataFrame, minzoom: int, maxzoom: int) -> DataFrame:
    """(zoom, x, y) of the tiles (x, y at maxzoom) and their parents; each zoom's are made distinct before the shuffle."""
    z = tiles.select("x", "y").distinct().withColumn("zoom", F.explode(F.sequence(F.lit(minzoom), F.lit(maxzoom))))
    up = lambda c: F.expr(f"shiftright({c}, {maxzoom} - zoom)")
    return z.select("zoom", up("x").alias("x"), up("y").alias("y")).distinct()


def by_quadkey(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("quadkey", quadkey(F.col("x"), F.col("y"))).orderBy("quadkey")


def changed_parts(old: DataFrame, new: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """Rows of only one side (points, or segments with their ends in order), of keys that both sides have."""
    both = old.select(*key).distinct().join(new.select(*key).distinct(), key, "left_semi")
    a, b = old.join(both, key, "left_semi").select(*key, *what).distinct(), new.join(both, key, "left_semi").select(*key, *what).distinct()
    cols = [*key, *what]
    return a.join(b, cols, "left_anti").unionByName(b.join(a, cols, "left_anti"))


def legacy_zooms(text: str) -> tuple[int, int]:
    """'13-16' or '16' to (least, most)."""
    low, _, high = text.partition("-")
    a, b = int(low), int(high or low)
    if not 0 <= a <= b <= 31:
        raise ValueError(f"expire zooms {text!r}")
    return a, b


def tool_geometry(kind: str, tags: dict, closed: bool = False) -> str | None:
    """The geometry that the expire tool makes of an object; none without tags."""
    if not tags:
        return None
    if kind == "n":
        return "point"
    if kind == "w":
        return "polygon" if closed else "linestring"
    return {"multipolygon": "multipolygon", "boundary": "multipolygon", "route": "multilinestring", "multilinestring": "multilinestring"}.get(tags.get("type"), "geometrycollection")


