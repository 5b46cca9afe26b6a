"""Kernels of ``shapes`` on many geometries at once: arrays of rings with the same number of points.

Each does the arithmetic of the kernel for one geometry in the same order, and
so has its results. What has no such form is handed to that kernel.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import shapes as S

#: Elements of the largest array that a kernel makes.
BLOCK = 400_000


def _same(sizes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, rows) of rows with the same size, about ``most`` elements at a time."""
    order = np.argsort(sizes, kind="stable")
    ends = np.nonzero(np.diff(sizes[order]))[0] + 1
    for rows in np.split(order, ends) if len(order) else []:
        size = int(sizes[rows[0]])
        step = max(1, most // max(1, size))
        for k in range(0, len(rows), step):
            yield size, rows[k : k + step]


# -- bytes ------------------------------------------------------------------------

def parse_polygons(raw: pa.Array) -> tuple[list[tuple[np.ndarray, int, np.ndarray]], np.ndarray]:
    """[(rows, srid, rings [row, point, xy])] of EWKB polygons of one ring, and the rows that hold anything else but null."""
    raw = raw.cast(pa.binary())
    if not len(raw):
        return [], np.zeros(0, np.int64)
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    start, end = offsets[:-1], offsets[1:]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    there = raw.is_valid().to_numpy(zero_copy_only=False)
    out, rest = [], []
    for size, rows in _same(np.where(there, end - start, -1), BLOCK * 8):
        if size < 0:
            continue
        n, odd = divmod(size - 17, 16)
        if n < 4 or odd:
            rest.append(rows)
            continue
        whole = data[start[rows][:, None] + np.arange(size)]
        head = np.ascontiguousarray(whole[:, 1:17]).view("<u4")
        ok = (whole[:, 0] == 1) & (head[:, 0] == (3 | 0x20000000)) & (head[:, 2] == 1) & (head[:, 3] == n)
        rest.append(rows[~ok])
        for srid in np.unique(head[ok, 1]).tolist():
            of = ok & (head[:, 1] == srid)
            out.append((rows[of], srid, np.ascontiguousarray(whole[of, 17:]).view("<f8").reshape(-1, n, 2)))
    return out, np.sort(np.concatenate(rest)) if rest else np.zeros(0, np.int64)


def write_bytes(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A binary array of n rows of parts (rows, bytes [row, byte]); other rows are null."""
    size = np.full(n, -1)
    for rows, b in parts:
        size[rows] = b.shape[1]
    end = np.cumsum(np.maximum(size, 0))
    data = np.empty(int(end[-1]) if n else 0, np.uint8)
    for rows, b in parts:
        data[(end[rows] - b.shape[1])[:, None] + np.arange(b.shape[1])] = b
    offsets = np.concatenate([[0], end]).astype(np.int32)
    mask = np.packbits(size >= 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), n, [pa.py_buffer(mask.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def polygon_bytes(rings: np.ndarray, srid: int) -> np.ndarray:
    n, k, _ = rings.shape
    head = np.frombuffer(struct.pack("<BIIII", 1, 3 | 0x20000000, srid, 1, k), np.uint8)
    return np.concatenate([np.broadcast_to(head, (n, 17)), np.ascontiguousarray(rings, "<f8").view(np.uint8).reshape(n, 16 * k)], axis=1)


def point_bytes(pts: np.ndarray, srid: int) -> np.ndarray:
    head = np.frombuffer(struct.pack("<BII", 1, 1 | 0x20000000, srid), np.uint8)
    return np.concatenate([np.broadcast_to(head, (len(pts), 9)), np.ascontiguousarray(pts, "<f8").view(np.uint8).reshape(len(pts), 16)], axis=1)


def one_by_one(rows: np.ndarray, values: list, fn: Callable[[object], bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts for ``write_bytes`` of rows and their values from a kernel for one geometry; no bytes: null."""
    made: dict[int, tuple[list, list]] = {}
    for k, v in zip(rows.tolist(), values, strict=True):
        if b := fn(v):
            of = made.setdefault(len(b), ([], []))
            of[0].append(k)
            of[1].append(b)
    return [(np.array(k), np.frombuffer(b"".join(b), np.uint8).reshape(len(k), -1)) for k, b in made.values()]


# -- polygons of ways -----------------------------------------------------------------

def _crosses(a, b, c, d):
    """``shapes._crosses`` of arrays of (x, y)."""
    def cross(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    def between(p, u, v):
        return (np.minimum(u[0], v[0]) <= p[0]) & (p[0] <= np.maximum(u[0], v[0])) & (np.minimum(u[1], v[1]) <= p[1]) & (p[1] <= np.maximum(u[1], v[1]))

    def same(p, q):
        return (p[0] == q[0]) & (p[1] == q[1])

    far = (np.maximum(a[0], b[0]) < np.minimum(c[0], d[0])) | (np.maximum(c[0], d[0]) < np.minimum(a[0], b[0])) | (np.maximum(a[1], b[1]) < np.minimum(c[1], d[1])) | (np.maximum(c[1], d[1]) < np.minimum(a[1], b[1]))
    d1, d2, d3, d4 = cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)
    out = (d1 * d2 < 0) & (d3 * d4 < 0)
    for k, p, u, v, o in ((d1, c, a, b, (a, b)), (d2, d, a, b, (a, b)), (d3, a, c, d, (c, d)), (d4, b, c, d, (c, d))):
        out |= (k == 0) & ~same(p, o[0]) & ~same(p, o[1]) & between(p, u, v)
    return out & ~far


def simple_rings(pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of closed ways [way, point, xy]: which are rings of distinct points without crossings, and all as ``assemble`` gives such."""
    x, y = pts[:, :-1, 0], pts[:, :-1, 1]
    m, n = x.shape
    ok = np.isfinite(pts).all(axis=(1, 2)) & (pts[:, 0] == pts[:, -1]).all(axis=1)
    p, q = (x, y), (np.roll(x, -1, axis=1), np.roll(y, -1, axis=1))
    turn = (p[0] > q[0]) | ((p[0] == q[0]) & (p[1] > q[1]))
    low, high = (tuple(np.where(turn, s, f) for f, s in zip(*v, strict=True)) for v in ((p, q), (q, p)))
    for i in range(n):
        for j in range(i):
            ok &= (x[:, i] != x[:, j]) | (y[:, i] != y[:, j])
            a, b, c, d = ((v[0][:, k], v[1][:, k]) for k in (i, j) for v in (low, high))
            less = np.zeros(m, bool)  # the later segment comes first, as in the sweep
            for u, v in ((b[1], d[1]), (b[0], d[0]), (a[1], c[1]), (a[0], c[0])):
                less = (u < v) | ((u == v) & less)
            a, b, c, d = (tuple(np.where(less, v, u) for u, v in zip(s, t, strict=True)) for s, t in ((a, c), (b, d), (c, a), (d, b)))
            ok &= ~_crosses(a, b, c, d)
    first = np.lexsort((y, x), axis=1)[:, 0] if n else np.zeros(m, int)
    at = (first[:, None] + np.arange(n + 1)) % n
    ring = np.take_along_axis(pts[:, :-1], at[:, :, None], axis=1)
    size = np.zeros(m)
    for k in range(n):
        size = size + (ring[:, k, 0] * ring[:, k + 1, 1] - ring[:, k + 1, 0] * ring[:, k, 1])
    ring = np.where((size > 0)[:, None, None], ring, ring[:, ::-1])
    thin = np.abs(size) <= 1e-12 * np.abs(ring).max(axis=(1, 2)) ** 2  # the direction may be a matter of rounding
    return ok & ~thin, ring


def polygons_of_ways(ways: pa.Array) -> pa.Array:
    """``polygon_of_way`` of array<struct<x,y>>, as EWKB."""
    if isinstance(ways, pa.ChunkedArray):
        ways = ways.combine_chunks()
    p, off = ways.values, ways.offsets.to_numpy().astype(np.int64)
    x, y = (p.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    gap = (p.is_null().to_numpy(zero_copy_only=False) | p.field("x").is_null().to_numpy(zero_copy_only=False) | p.field("y").is_null().to_numpy(zero_copy_only=False)).astype(np.int64)
    gaps = np.concatenate([[0], np.cumsum(gap)])
    there = ways.is_valid().to_numpy(zero_copy_only=False)
    whole = there & (gaps[off[1:]] == gaps[off[:-1]])
    parts, rest = [], [np.nonzero(there & ~whole)[0]]
    for size, rows in _same(np.where(whole, np.diff(off), -1), BLOCK):
        if size < 0:
            continue
        if not 4 <= size <= 40:  # pairs of segments are compared, for long ways the sweep does less
            rest.append(rows)
            continue
        at = off[rows][:, None] + np.arange(size)
        ok, ring = simple_rings(np.stack([x[at], y[at]], axis=2))
        parts.append((rows[ok], polygon_bytes(ring[ok], 4326)))
        rest.append(rows[~ok])
    rows = np.concatenate(rest)
    pts = lambda w: [(v["x"], v["y"]) for v in w if v is not None and v["x"] is not None and v["y"] is not None]
    return write_bytes(len(ways), parts + one_by_one(rows, ways.take(pa.array(rows)).to_pylist(), lambda w: S.to_ewkb(S.polygon_of_way(pts(w)))))


# -- projection ---------------------------------------------------------------------------

def to_mercator(rings: np.ndarray) -> np.ndarray:
    """``shapes.mercator`` of all points; logarithms are those of the library for one number."""
    y, at = np.unique(rings[..., 1], return_inverse=True)
    y = np.array([S.A * math.log(math.tan(math.pi / 4 + math.radians(max(-89.99, min(89.99, v))) / 2)) for v in y.tolist()])
    return np.stack([S.A * (rings[..., 0] * (math.pi / 180)), y[at.reshape(rings.shape[:-1])]], axis=-1)


# -- poles ----------------------------------------------------------------------------------

def _centroids(r: np.ndarray) -> np.ndarray:
    x0, y0 = r[:, 0, 0], r[:, 0, 1]
    cs, wx, wy, w = [], 0.0, 0.0, 0.0
    size = np.zeros(len(r))
    for k in range(r.shape[1] - 1):
        size = size + (r[:, k, 0] * r[:, k + 1, 1] - r[:, k + 1, 0] * r[:, k, 1])
    sign = np.where(size >= 0, 1.0, -1.0)
    for k in range(r.shape[1] - 1):
        ax, ay, bx, by = r[:, k, 0] - x0, r[:, k, 1] - y0, r[:, k + 1, 0] - x0, r[:, k + 1, 1] - y0
        c = sign * (ax * by - bx * ay) / 2
        wx, wy, w = wx + c * (ax + bx) / 3, wy + c * (ay + by) / 3, w + c
    some = np.where(w == 0, 1.0, w)
    return np.stack([np.where(w == 0, x0, x0 + wx / some), np.where(w == 0, y0, y0 + wy / some)], axis=1)


def _signed_distance(px: np.ndarray, py: np.ndarray, e: tuple) -> np.ndarray:
    """Of points [ring, point] from the boundary of their ring, negative outside."""
    least, inside = np.full(px.shape, np.inf), np.zeros(px.shape, bool)
    for ax, ay, bx, by, dx, dy, n in zip(*e, strict=True):
        ux, uy = px - ax, py - ay
        f = np.clip((ux * dx + uy * dy) / n, 0.0, 1.0)
        hx, hy = ux - f * dx, uy - f * dy
        np.minimum(least, hx * hx + hy * hy, out=least)
        over = (ay > py) != (by > py)
        inside ^= over & (px < dx * uy / np.where(dy == 0, 1.0, dy) + ax)
    d = np.sqrt(least)
    return np.where(inside, d, -d)


def poles(rings: np.ndarray) -> np.ndarray:
    """``pole_of_inaccessibility`` of polygons of one ring: all searches go on together, each with its own heap."""
    out = np.empty((len(rings), 2))
    xs, ys = rings[:, :, 0], rings[:, :, 1]
    x0, y0 = xs.min(axis=1), ys.min(axis=1)
    w, h = xs.max(axis=1) - x0, ys.max(axis=1) - y0
    cell = np.minimum(w, h)
    out[:, 0], out[:, 1] = x0, y0
    live = np.nonzero(cell > 0)[0]
    if not len(live):
        return out
    x0, y0, w, h, cell, rings = x0[live], y0[live], w[live], h[live], cell[live], rings[live]
    precision, root2 = np.maximum(w, h) / 1000, math.sqrt(2)
    a, b = rings[:, :-1], rings[:, 1:]
    d = b - a
    n = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]
    n[n == 0] = np.inf
    edges = np.stack([a[..., 0], a[..., 1], b[..., 0], b[..., 1], d[..., 0], d[..., 1], n]).transpose(0, 2, 1)[..., None]  # [what, edge, ring, 1]
    best = np.full((3, len(live)), -np.inf)

    def better(best, d, x, y):
        """The larger of two (distance, x, y)."""
        o = (d > best[0]) | ((d == best[0]) & ((x > best[1]) | ((x == best[1]) & (y > best[2]))))
        return np.where(o, np.stack([d, x, y]), best)

    def measure(px, py, edges):
        return _signed_distance(px, py, edges)

    c = _centroids(rings)
    for x, y in ((c[:, 0], c[:, 1]), (x0 + w / 2, y0 + h / 2)):
        best = better(best, measure(x[:, None], y[:, None], edges)[:, 0], x, y)
    nx, ny = np.ceil(w / cell).astype(np.int64), np.ceil(h / cell).astype(np.int64)
    cells = np.full((5, len(live), int((nx * ny).max())), -np.inf)  # bound, x, y, half, distance
    for k in range(cells.shape[2]):
        o = np.nonzero(k < nx * ny)[0]
        x, y, half = x0[o] + (k // ny[o] + 0.5) * cell[o], y0[o] + (k % ny[o] + 0.5) * cell[o], cell[o] / 2
        d = measure(x[:, None], y[:, None], edges[:, :, o])[:, 0]
        cells[:, o, k] = d + half * root2, x, y, half, d
        best[:, o] = better(best[:, o], d, x, y)
    at, row = live, np.arange(len(live))
    sx, sy = np.array([-1.0, -1.0, 1.0, 1.0]), np.array([-1.0, 1.0, -1.0, 1.0])
    while True:
        pick = cells[0].argmax(axis=1)
        top = cells[0][row, pick]
        # As in the heap: of equal bounds the smallest x, then y.
        tied = np.nonzero((cells[0] == top[:, None]).sum(axis=1) > 1)[0]
        for k in tied.tolist() if len(tied) else ():
            if top[k] > -np.inf:
                o = np.nonzero(cells[0, k] == top[k])[0]
                pick[k] = o[np.lexsort((cells[4, k, o], cells[3, k, o], cells[2, k, o], cells[1, k, o]))[0]]
        on = top - best[0] > precision
        if not on.all():
            done = ~on
            out[at[done]] = best[1:, done].T
            if done.all():
                return out
            keep = np.nonzero(on)[0]
            at, row, pick, best, precision = at[keep], np.arange(len(keep)), pick[keep], best[:, keep], precision[keep]
            edges, cells = edges[:, :, keep], cells[:, keep]
        x, y, half = (cells[k][row, pick] for k in (1, 2, 3))
        px, py = x[:, None] + sx * half[:, None] / 2, y[:, None] + sy * half[:, None] / 2
        d = measure(px, py, edges)
        for k in range(4):
            best = better(best, d[:, k], px[:, k], py[:, k])
        bound = d + half[:, None] / 2 * root2
        bound[bound - best[0][:, None] <= precision[:, None]] = -np.inf  # could only end the search
        cells[0][row, pick] = -np.inf
        # Children go to free places; where there are none, places are added.
        free = np.sort(np.argpartition(cells[0], min(3, cells.shape[2] - 1), axis=1)[:, :4], axis=1) if cells.shape[2] >= 4 else None
        if free is None or (np.take_along_axis(cells[0], free, 1) > -np.inf).any():
            free = np.broadcast_to(cells.shape[2] + np.arange(4), bound.shape)
            cells = np.concatenate([cells, np.full((5, len(row), 8), -np.inf)], axis=2)
        for k, v in enumerate((bound, px, py, np.broadcast_to(half[:, None] / 2, bound.shape), d)):
            cells[k][row[:, None], free] = v


def poles_of(raw: pa.Array) -> pa.Array:
    """``pole_of_inaccessibility`` of EWKB."""
    got, rest = parse_polygons(raw)
    parts = []
    for rows, srid, rings in got:
        step = max(1, BLOCK // 4 // rings.shape[1] // 8)
        parts += [(rows[k : k + step], point_bytes(poles(rings[k : k + step]), srid)) for k in range(0, len(rows), step)]
    return write_bytes(len(raw), parts + one_by_one(rest, raw.take(pa.array(rest)).to_pylist(), lambda v: S.to_ewkb(S.pole_of_inaccessibility(S.from_ewkb(v)))))


# -- other measures of EWKB ----------------------------------------------------------------

def mercator_of(raw: pa.Array) -> pa.Array:
    """``transform`` of EWKB to 3857."""
    got, rest = parse_polygons(raw)
    parts = [(rows, polygon_bytes(to_mercator(r) if srid == 4326 else r, 3857)) for rows, srid, r in got if srid in (4326, 3857)]
    rest = np.concatenate([rest, *[rows for rows, srid, _ in got if srid not in (4326, 3857)]])
    return write_bytes(len(raw), parts + one_by_one(rest, raw.take(pa.array(rest)).to_pylist(), lambda v: S.to_ewkb(S.transform(S.from_ewkb(v), 3857))))


BOX = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])


def boxes_of(raw: pa.Array) -> pa.Array:
    """``bbox`` of EWKB as struct<x0,y0,x1,y1>."""
    got, rest = parse_polygons(raw)
    out, there = np.zeros((4, len(raw))), np.zeros(len(raw), bool)
    for rows, _, r in got:
        out[:2, rows], out[2:, rows], there[rows] = r.min(axis=1).T, r.max(axis=1).T, True
    for k, v in zip(rest.tolist(), raw.take(pa.array(rest)).to_pylist(), strict=True):
        b = S.bbox(S.from_ewkb(v))
        if b is not None:
            out[:, k], there[k] = b, True
    return pa.StructArray.from_arrays([pa.array(v) for v in out], fields=list(BOX), mask=pa.array(~there))


# -- lines -----------------------------------------------------------------------------------

def parse_lines(raw: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """[(rows, points [row, point, xy])] of EWKB lines, and the rows that hold anything else but null."""
    raw = raw.cast(pa.binary())
    if not len(raw):
        return [], np.zeros(0, np.int64)
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    out, rest = [], [np.zeros(0, np.int64)]
    for size, rows in _same(np.where(raw.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1), BLOCK * 8):
        n, odd = divmod(size - 13, 16)
        if size < 0:
            continue
        if n < 2 or odd:
            rest.append(rows)
            continue
        whole = data[offsets[rows][:, None] + np.arange(size)]
        head = np.ascontiguousarray(whole[:, 1:13]).view("<u4")
        ok = (whole[:, 0] == 1) & (head[:, 0] == (2 | 0x20000000)) & (head[:, 2] == n)
        rest.append(rows[~ok])
        out.append((rows[ok], np.ascontiguousarray(whole[ok, 13:]).view("<f8").reshape(-1, n, 2)))
    return out, np.sort(np.concatenate(rest))


def line_bytes(pts: np.ndarray) -> np.ndarray:
    n, k, _ = pts.shape
    head = np.frombuffer(struct.pack("<BIII", 1, 2 | 0x20000000, 4326, k), np.uint8)
    return np.concatenate([np.broadcast_to(head, (n, 13)), np.ascontiguousarray(pts, "<f8").view(np.uint8).reshape(n, 16 * k)], axis=1)


def lines_of(ways: pa.Array) -> pa.Array:
    """``line`` of array<struct<x,y>>, as EWKB."""
    p, off = ways.values, ways.offsets.to_numpy().astype(np.int64)
    x, y = (p.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    gap = p.is_null().to_numpy(zero_copy_only=False) | p.field("x").is_null().to_numpy(zero_copy_only=False) | p.field("y").is_null().to_numpy(zero_copy_only=False)
    there = ways.is_valid().to_numpy(zero_copy_only=False)
    parts, rest = [], [np.zeros(0, np.int64)]
    for size, rows in _same(np.where(there, np.diff(off), -1), BLOCK):
        if size < 2:
            continue
        at = off[rows][:, None] + np.arange(size)
        ok = ~gap[at].any(axis=1) & ((x[at[:, 1:]] != x[at[:, :-1]]) | (y[at[:, 1:]] != y[at[:, :-1]])).all(axis=1)
        parts.append((rows[ok], line_bytes(np.stack([x[at[ok]], y[at[ok]]], axis=2))))
        rest.append(rows[~ok])
    rows = np.concatenate(rest)
    pts = lambda w: [(v["x"], v["y"]) for v in w if v is not None and v["x"] is not None and v["y"] is not None]
    return write_bytes(len(ways), parts + one_by_one(rows, ways.take(pa.array(rows)).to_pylist(), lambda w: S.to_ewkb(S.line(pts(w)))))


def line_measures(raw: pa.Array) -> np.ndarray:
    """[number of points, length, x0, y0, x1, y1] by row; no points: none of it."""
    got, rest = parse_lines(raw)
    out = np.zeros((6, len(raw)))
    for rows, r in got:
        d = np.diff(r, axis=1)
        size = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])
        out[:, rows] = np.concatenate([[np.full(len(rows), r.shape[1]), size.sum(axis=1)], r.min(axis=1).T, r.max(axis=1).T])
    for k, v in zip(rest.tolist(), raw.take(pa.array(rest)).to_pylist(), strict=True):
        g = S.from_ewkb(v)
        b = S.bbox(g)
        if b is not None:
            out[:, k] = S.n_points(g), S.length(g), *b
    return out


def spans_of_lines(pts: np.ndarray, g: S.Geom) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, from, to) in order: ``spans_within`` of lines of the same number of points [line, point, xy] in one area."""
    rings = [np.asarray(r, float) for p in g.parts if p.kind == "POLYGON" for r in p.data]
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    if not rings or not len(pts):
        return none
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    near, block = 1e-9, max(1, 100_000 // len(a))
    extent = 1e-9 * np.maximum(np.ptp(pts, axis=1).max(axis=1), 1e-300)
    (e0, e1), d = (b - a).T, np.diff(pts, axis=1)
    squares, size = np.maximum(e0 * e0 + e1 * e1, 1e-300), np.hypot(d[..., 0], d[..., 1])
    at = (np.cumsum(size, axis=1) - size).ravel()
    line = np.repeat(np.arange(len(pts)), pts.shape[1] - 1)
    p, d, size = pts[:, :-1].reshape(-1, 2), d.reshape(-1, 2), size.ravel()
    some = size > 0
    p, d, at, size, line = p[some], d[some], at[some], size[some], line[some]
    eps = extent[line]
    got = []
    for k in range(0, len(p), block):
        q, f, s = p[k : k + block], d[k : k + block], size[k : k + block, None]
        f0, f1 = f[:, :1], f[:, 1:]
        w0, w1 = a[:, 0] - q[:, :1], a[:, 1] - q[:, 1:]
        turn, off = f0 * e1 - f1 * e0, (w0 * f1 - w1 * f0) / s
        flat = np.abs(turn) <= 1e-12 * s * np.sqrt(squares)
        safe = np.where(flat, 1.0, turn)
        t, u = (w0 * e1 - w1 * e0) / safe, off * s / safe
        cut = ~flat & (u >= -near) & (u <= 1 + near) & (t >= -near) & (t <= 1 + near)
        along = flat & (np.abs(off) <= eps[k : k + block, None])
        begin = (w0 * f0 + w1 * f1) / (s * s)
        end = begin + (e0 * f0 + e1 * f1) / (s * s)
        seg = np.concatenate([np.nonzero(cut)[0], np.repeat(np.nonzero(along)[0], 2)])
        met = np.concatenate([t[cut], np.stack([begin[along], end[along]], axis=1).ravel()])
        seg, met = (v[(met >= -near) & (met <= 1 + near)] for v in (seg, met))
        met = np.clip(met, 0.0, 1.0)
        touch = at[k + seg] + met * size[k + seg]
        got.append((line[k + seg], touch, touch))
        seg, ts = np.concatenate([np.repeat(np.arange(len(q)), 2), seg]), np.concatenate([np.tile([0.0, 1.0], len(q)), met])
        order = np.lexsort((ts, seg))
        seg, ts = seg[order], ts[order]
        o = np.nonzero((seg[1:] == seg[:-1]) & (ts[1:] > ts[:-1]))[0]
        m = q[seg[o]] + (ts[o] + ts[o + 1])[:, None] / 2 * f[seg[o]]
        m0, m1 = m[:, :1] - a[:, 0], m[:, 1:] - a[:, 1]
        over = (m1 < 0) != (m[:, 1:] < b[:, 1])
        odd = (over & (m0 < e0 * m1 / np.where(e1 == 0, 1.0, e1))).sum(axis=1) % 2 == 1
        g0 = np.clip((m0 * e0 + m1 * e1) / squares, 0.0, 1.0)
        o = o[odd | (((m0 - g0 * e0) ** 2 + (m1 - g0 * e1) ** 2).min(axis=1) <= eps[k + seg[o]] ** 2)]
        i = k + seg[o]
        got.append((line[i], at[i] + ts[o] * size[i], at[i] + ts[o + 1] * size[i]))
    of, x, y = (np.concatenate([v[k] for v in got]) for k in range(3)) if got else none
    if not len(of):
        return none
    order = np.lexsort((y, x, of))
    of, x, y = of[order], x[order], y[order]
    # Spans that meet are joined, all lines' k-th at once.
    first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
    n, reach, new = np.diff(np.append(first, len(of))), y[first], np.ones(len(of), bool)
    for k in range(1, int(n.max())):
        g = np.nonzero(n > k)[0]
        i = first[g] + k
        new[i] = x[i] > reach[g] + extent[of[i]]
        reach[g] = np.where(new[i], y[i], np.maximum(reach[g], y[i]))
    begin = np.nonzero(new)[0]
    return of[begin], x[begin], np.maximum.reduceat(y, begin)
