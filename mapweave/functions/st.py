"""Geometry functions on EWKB columns: Arrow UDFs over the kernels in ``shapes``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from . import batch as B
from . import shapes as S

POINT = "struct<x:double,y:double>"


def arrow_fn(fn: Callable, kind: str) -> Callable[..., Column]:
    """A UDF of columns, a batch at a time without pandas; a null argument gives null."""
    def call(*cols: Column | str) -> Column:
        got = _parse_datatype_string(kind)
        out = to_arrow_type(got if isinstance(got, DataType) else got)

        if len(cols) == 1:
            def run(a: pa.Array) -> pa.Array:
                return pa.array([None if v is None else fn(v) for v in a.to_pylist()], out)
        else:
            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return pa.array([None if v is None or w is None else fn(v, w) for v, w in zip(a.to_pylist(), b.to_pylist(), strict=True)], out)

        run.__annotations__ = {k: pa.Array for k in run.__annotations__}
        return F.arrow_udf(run, kind)(*cols)

    return call


def _arrow_batch(fn: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column | str], Column]:
    """A UDF by a kernel for whole arrays."""
    def call(col: Column | str) -> Column:
        def run(a: pa.Array) -> pa.Array:
            return fn(a)

        run.__annotations__ = {k: pa.Array for k in run.__annotations__}
        return F.arrow_udf(run, kind)(col)

    return call


def _scalar(fn: Callable, kind: str) -> Callable[..., Column]:
    """A UDF of EWKB and constants."""
    def call(geom: Column | str, *args) -> Column:
        return arrow_fn(lambda raw: fn(S.from_ewkb(raw), *args), kind)(geom)

    call.__doc__ = fn.__doc__
    return call


def _geom(fn: Callable) -> Callable[..., Column]:
    def run(g: S.Geom, *args):
        return S.to_ewkb(fn(g, *args)) or None

    run.__doc__ = fn.__doc__
    return _scalar(run, "binary")


def _pair(fn: Callable, kind: str) -> Callable[[Column | str, Column | str], Column]:
    return arrow_fn(lambda a, b: fn(S.from_ewkb(a), S.from_ewkb(b)), kind)


area, length = _scalar(S.area, "double"), _scalar(S.length, "double")
spherical_area, spherical_length = _scalar(S.spherical_area, "double"), _scalar(S.spherical_length, "double")
centroid, reverse, line_merge = _geom(S.centroid), _geom(S.reverse), _geom(S.line_merge)
segmentize, simplify, _transform = _geom(S.segmentize), _geom(S.simplify), _geom(S.transform)
geometry_n, _stretched_pole, _poles = _geom(S.geometry_n), _geom(S.pole_of_inaccessibility), _arrow_batch(B.poles_of, "binary")
n_points, num_geometries = _scalar(S.n_points, "int"), _scalar(lambda g: len(g.parts), "int")
geometry_type, srid, is_null = _scalar(lambda g: g.kind, "string"), _scalar(lambda g: g.srid, "int"), _scalar(lambda g: g.kind == "NULL", "boolean")
bbox, _mercator = _arrow_batch(B.boxes_of, "struct<x0:double,y0:double,x1:double,y1:double>"), _arrow_batch(B.mercator_of, "binary")
is_valid = _scalar(S.is_valid, "boolean")
split_multi = _scalar(lambda g: [S.to_ewkb(S.Geom(p.kind, p.data, g.srid)) for p in g.parts], "array<binary>")
intersects, equals = _pair(S.intersects, "boolean"), _pair(lambda a, b: a == b, "boolean")
symmetric_difference = _pair(lambda a, b: [S.to_ewkb(p) for p in S.difference_tiles_of(a, b)], "array<binary>")


inscribed_width = _scalar(S.inscribed_width, "double")
spans_within = _pair(lambda a, b: [{"a": x, "b": y} for x, y in S.spans_within(a, b)], "array<struct<a:double,b:double>>")


def pole_of_inaccessibility(geom: Column | str, stretch: float = 1.0) -> Column:
    return _stretched_pole(geom, stretch) if stretch > 0 and stretch != 1 else _poles(geom)


def transform(geom: Column | str, srid: int) -> Column:
    return _mercator(geom) if srid == 3857 else _transform(geom, srid)


def as_hex(geom: Column | str) -> Column:
    return F.hex(geom)


def _points(v) -> list:
    return [(p["x"], p["y"]) for p in v if p is not None and p["x"] is not None and p["y"] is not None]


def _from_points(fn: Callable) -> Callable[[Column | str], Column]:
    """From array<struct<x,y>>; null entries are locations that are missing."""
    return arrow_fn(lambda v: S.to_ewkb(fn(_points(v))) or None, "binary")


def _from_lines(fn: Callable) -> Callable[[Column | str], Column]:
    """From array<array<struct<x,y>>>, the lines of a relation's ways."""
    return arrow_fn(lambda v: S.to_ewkb(fn([_points(l) for l in v if l is not None])) or None, "binary")


as_linestring = _arrow_batch(B.lines_of, "binary")
as_polygon = _arrow_batch(B.polygons_of_ways, "binary")
as_point = _from_points(lambda p: S.point(*p[0]) if p else S.NULL)
as_multipoint = _from_points(lambda p: S.collect("MULTIPOINT", [S.point(*q) for q in p]))
as_multilinestring = _from_lines(lambda ls: S.collect("MULTILINESTRING", [S.line(l) for l in ls]))
as_multipolygon = _from_lines(S.multipolygon)
as_geometrycollection = _from_lines(lambda ls: S.collect("GEOMETRYCOLLECTION", [S.point(*l[0]) if len(l) == 1 else S.line(l) for l in ls if l], unwrap=False))
