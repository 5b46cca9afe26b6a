"""User programs: tables are defined, and objects go to them through functions on DataFrames.

A callback receives an ``Objects`` (a DataFrame of nodes, ways or relations with
helpers for tags and geometries) and inserts columns, not single rows. What a
row-by-row program keeps in variables between calls, here is a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import st, tags as T
from ..operators import resolve as R
from .tables import ColumnDef, IndexDef, TableDef


@dataclass
class Objects:
    kind: str
    df: DataFrame
    program: Program

    def where(self, condition) -> Objects:
        return Objects(self.kind, self.df.where(condition), self.program)

    def tag(self, key: str) -> Column:
        return T.tag(F.col("tags"), key)

    def grab_tag(self, key: str) -> tuple[Column, Objects]:
        value, rest = T.grab_tag(F.col("tags"), key)
        name = f"__tag_{key}"
        return F.col(name), Objects(self.kind, self.df.withColumn(name, value).withColumn("tags", rest), self.program)

    def clean(self, patterns: list[str]) -> Objects:
        return Objects(self.kind, self.df.withColumn("tags", T.clean_tags(F.col("tags"), patterns)), self.program)

    def tagged(self) -> Objects:
        return self.where(F.size("tags") > 0)

    def untagged(self) -> Objects:
        return self.where(F.size("tags") <= 0)

    def _need(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise TypeError(f"not for objects of kind {self.kind!r}")

    def as_point(self) -> Column:
        self._need("n")
        return st.as_point(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))

    def as_linestring(self) -> Column:
        self._need("w")
        return st.as_linestring("pts")

    def as_polygon(self) -> Column:
        self._need("w")
        return st.as_polygon("pts")

    def _lines(self) -> Column:
        return F.array("pts") if self.kind == "w" else F.transform(F.filter("resolved", lambda m: m["type"] == "w"), lambda m: m["pts"])

    def as_multilinestring(self) -> Column:
        self._need("w", "r")
        return st.as_multilinestring(self._lines())

    def as_multipolygon(self) -> Column:
        self._need("w", "r")
        return st.as_multipolygon(self._lines())

    def as_multipoint(self) -> Column:
        self._need("n", "r")
        return self.as_point() if self.kind == "n" else st.as_multipoint(F.flatten(F.transform(F.filter("resolved", lambda m: m["type"] == "n"), lambda m: m["pts"])))

    def as_geometrycollection(self) -> Column:
        self._need("r")
        return st.as_geometrycollection(F.transform("resolved", lambda m: m["pts"]))

    def insert(self, table: str, **values: Column) -> None:
        self.program.add(table, self.kind, self.df, values)


@dataclass
class Program:
    """Tables and callbacks; ``run`` gives each table's rows."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    callbacks: dict[str, list[Callable[[Objects], None]]] = field(default_factory=dict)
    rejected: dict[str, list[DataFrame]] = field(default_factory=dict)
    _rows: dict[str, list[DataFrame]] = field(default_factory=dict)

    def define_table(self, name: str, kind: str = "any", columns=(), ids: tuple[str, ...] | None = None, **options) -> TableDef:
        cols = [c if isinstance(c, ColumnDef) else ColumnDef(**c) for c in columns]
        indexes = [i if isinstance(i, IndexDef) else IndexDef(**i) for i in options.pop("indexes", ())]
        id_column, type_column = (ids or (None,))[0], (ids[1] if ids and len(ids) > 1 else None)
        if name in self.tables:
            raise ValueError(f"table {name} twice")
        self.tables[name] = TableDef(name, kind, cols, id_column, type_column, indexes=indexes, **options)
        return self.tables[name]

    def define_node_table(self, name, columns=(), **o):
        return self.define_table(name, "node", columns, ("node_id",), **o)

    def define_way_table(self, name, columns=(), **o):
        return self.define_table(name, "way", columns, ("way_id",), **o)

    def define_relation_table(self, name, columns=(), **o):
        return self.define_table(name, "relation", columns, ("relation_id",), **o)

    def define_area_table(self, name, columns=(), **o):
        return self.define_table(name, "area", columns, ("area_id",), **o)

    def on(self, event: str):
        """Decorator. Events: process_node, process_way, process_relation, and each with untagged_ or deleted_ before the kind;
        after_nodes, after_ways and after_relations come once, after all objects of a kind, and get all of them.
        """
        names = {f"process_{u}{k}" for u in ("", "untagged_", "deleted_") for k in ("node", "way", "relation")} | {"after_nodes", "after_ways", "after_relations"}
        if event not in names:
            raise ValueError(f"no event {event!r}")

        def put(fn):
            self.callbacks.setdefault(event, []).append(fn)
            return fn
        return put

    def add(self, table: str, kind: str, df: DataFrame, values: dict[str, Column]) -> None:
        good, bad = self.tables[table].rows(df, kind, values)
        self._rows.setdefault(table, []).append(good)
        self.rejected.setdefault(table, []).append(bad)

    def run(self, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
        """Rows of each table. Coordinates and members are resolved only for objects whose callback exists."""
        self._rows, self.rejected = {}, {}
        frames = {"node": nodes, "way": None, "relation": None}
        uses = lambda k: any((e.endswith(k) or e == f"after_{k}s") and "deleted" not in e for e in self.callbacks)
        if uses("way") or uses("relation"):
            located = R.locate(R.way_edges(ways), nodes)
            frames["way"] = ways.join(located.withColumnRenamed("way_id", "id"), "id", "left")
        if uses("relation"):
            resolved = R.members(R.member_edges(relations), nodes, located).select(F.col("rel_id").alias("id"), F.col("members").alias("resolved"))
            frames["relation"] = relations.join(resolved, "id", "left")
        for kind in ("node", "way", "relation"):
            for event, split in ((f"process_{kind}", "tagged"), (f"process_untagged_{kind}", "untagged"), (f"process_deleted_{kind}", None)):
                for fn in self.callbacks.get(event, []):
                    df = frames[kind] if frames[kind] is not None else {"node": nodes, "way": ways, "relation": relations}[kind]
                    seen = df.where("visible") if split and "visible" in df.columns else df.where("NOT visible") if not split else df
                    o = Objects(kind[0], seen, self)
                    fn(getattr(o, split)() if split else o)
            for fn in self.callbacks.get(f"after_{kind}s", []):
                df = frames[kind] if frames[kind] is not None else {"node": nodes, "way": ways, "relation": relations}[kind]
                fn(Objects(kind[0], df.where("visible") if "visible" in df.columns else df, self))
        out = {}
        for name, parts in self._rows.items():
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            out[name] = df
        return out
