"""Declared tables: columns, ids, indexes, and rows coerced to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as K
from ..functions import st
from ..functions.tags import check_identifier
from ..model import map_id

#: Declared type to Spark's.
TYPES = {
    "text": "string", "boolean": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "real": "float", "double": "double",
    "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "hstore": "map<string,string>", "json": "string", "jsonb": "string", "direction": "smallint",
    "id_type": "string", "id_num": "bigint", "geometry": "binary", "point": "binary", "linestring": "binary", "polygon": "binary",
    "multipoint": "binary", "multilinestring": "binary", "multipolygon": "binary", "geometrycollection": "binary",
}
GEOMETRIES = frozenset(k for k, v in TYPES.items() if v == "binary")
KINDS = ("node", "way", "relation", "area", "any", "tile", "none")
ACCEPTS = {"node": "n", "way": "wr", "relation": "r", "area": "wr", "any": "nwr", "tile": "", "none": ""}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str = "text"
    not_null: bool = False
    create_only: bool = False
    projection: int | str = 3857
    sql_type: str | None = None
    expire: tuple = ()

    def __post_init__(self):
        check_identifier(self.name)
        kind = K.ALIASES.get(self.type.lower(), self.type.lower())
        if kind not in TYPES:
            raise ValueError(f"column {self.name}: no type {self.type!r}")
        object.__setattr__(self, "type", kind)
        named = {"merc": 3857, "mercator": 3857, "latlong": 4326, "latlon": 4326, "wgs84": 4326}
        object.__setattr__(self, "projection", int(named.get(self.projection, self.projection)))
        if self.expire and (self.projection != 3857 or kind not in GEOMETRIES):
            raise ValueError(f"column {self.name}: only geometries in 3857 expire tiles")

    @property
    def spark_type(self) -> str:
        return self.sql_type or TYPES[self.type]

    def value(self, c: Column) -> Column:
        """The column's value from a string column, a geometry (EWKB in 4326), or a value that has its type already."""
        if self.type in GEOMETRIES:
            return self._geometry(c)
        return K.coerce(c, self.type)

    def _geometry(self, c: Column) -> Column:
        from ..functions import shapes as S

        want, srid = self.type.upper(), self.projection
        return st.arrow_fn(lambda raw: typed_geometry(S.from_ewkb(raw), want, srid), "binary")(c)


def typed_geometry(g, want: str, srid: int) -> bytes | None:
    """As EWKB in a column's kind and system: multi kinds take single ones, wrapped; another kind is an error."""
    from ..functions import shapes as S

    if g.kind == "NULL":
        return None
    if want != "GEOMETRY" and g.kind != want:
        if S.SINGLE.get(want) != g.kind:
            raise ValueError(f"a {g.kind} in a column of type {want}")
        g = S.Geom(want, [g], g.srid)
    return S.to_ewkb(S.transform(g, srid))


@dataclass(frozen=True)
class IndexDef:
    columns: tuple[str, ...] = ()
    method: str = "btree"
    expression: str | None = None
    include: tuple[str, ...] = ()
    unique: bool = False
    where: str | None = None
    fillfactor: int | None = None

    def __post_init__(self):
        if bool(self.columns) == bool(self.expression):
            raise ValueError("an index is on columns or on an expression")
        if self.fillfactor is not None and not 10 <= self.fillfactor <= 100:
            raise ValueError("fillfactor is 10 to 100")

    def violations(self, df: DataFrame) -> DataFrame:
        """For unique indexes: keys that are not alone, (keys, n); null keys never clash."""
        rows = df.where(self.where) if self.where else df
        keys = [F.col(c) for c in self.columns] or [F.expr(self.expression).alias("key")]
        out = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return out.dropna(subset=[c for c in out.columns if c != "n"]) if self.unique else out.limit(0)


@dataclass
class TableDef:
    name: str
    kind: str
    columns: list[ColumnDef] = field(default_factory=list)
    id_column: str | None = None
    type_column: str | None = None
    create_index: str = "auto"
    indexes: list[IndexDef] = field(default_factory=list)
    schema: str = "public"
    cluster: bool = True

    def __post_init__(self):
        check_identifier(self.name)
        if self.kind not in KINDS:
            raise ValueError(f"table {self.name}: no kind {self.kind!r}")
        if self.create_index not in ("auto", "always", "unique", "primary_key"):
            raise ValueError(f"table {self.name}: create_index {self.create_index!r}")
        if self.kind == "tile":
            self.columns = [ColumnDef("x", "int", not_null=True), ColumnDef("y", "int", not_null=True), *self.columns]
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError(f"table {self.name}: a column twice")
        if not self.indexes and (g := next((c.name for c in self.columns if c.type in GEOMETRIES), None)):
            self.indexes = [IndexDef((g,), "gist")]

    def accepts(self, kind: str) -> bool:
        return kind in ACCEPTS[self.kind]

    def ddl(self) -> str:
        ids = ([f"{self.type_column} STRING"] if self.type_column else []) + ([f"{self.id_column} BIGINT"] if self.id_column else [])
        return ", ".join(ids + [f"{c.name} {c.spark_type}" + (" NOT NULL" if c.not_null else "") for c in self.columns])

    def id_index(self, updatable: bool = False) -> IndexDef | None:
        """The index on ids, or on x and y of tile tables: with ``auto`` only where the table is to be updated."""
        keys = ("x", "y") if self.kind == "tile" else tuple(c for c in (self.type_column, self.id_column) if c)
        if not keys or (self.create_index == "auto" and not updatable):
            return None
        return IndexDef(keys, unique=self.create_index in ("unique", "primary_key"))

    def finish(self, df: DataFrame, path: str, updatable: bool = False, partitions: int | None = None) -> DataFrame:
        """Write rows to Parquet and read them back, in the order of the id index where there is one.

        Ranges of keys then lie in few files and row groups, whose statistics
        stand in for the index. Keys that repeat under a unique index, or are null
        under a primary key, are an error, before anything is written.
        """
        index = self.id_index(updatable)
        if index and index.unique and not index.violations(df).isEmpty():
            raise ValueError(f"table {self.name}: keys repeat")
        if index and self.create_index == "primary_key" and not df.where(" OR ".join(f"{c} IS NULL" for c in index.columns)).isEmpty():
            raise ValueError(f"table {self.name}: a key is null")
        out = df
        if index:
            out = (df.repartitionByRange(partitions, *index.columns) if partitions else df.repartitionByRange(*index.columns)).sortWithinPartitions(*index.columns)
        out.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def rows(self, objects: DataFrame, kind: str, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) rows of objects (with ``id``) of a kind (n, w, r); columns not given are null."""
        if not self.accepts(kind):
            raise ValueError(f"table {self.name} takes no {kind}")
        unknown = set(values) - {c.name for c in self.columns}
        if unknown:
            raise ValueError(f"table {self.name} has no columns {sorted(unknown)}")
        out = []
        if self.type_column:
            out.append(F.lit({"n": "N", "w": "W", "r": "R"}[kind]).alias(self.type_column))
        if self.id_column:
            out.append(map_id(kind, self.kind, has_type=bool(self.type_column)).alias(self.id_column))
        for c in self.columns:
            if not c.create_only:
                out.append((c.value(values[c.name]) if c.name in values else F.lit(None).cast(c.spark_type)).alias(c.name))
        got = objects.select(*out)
        return K.accepted_rejected(got, [c.name for c in self.columns if c.not_null and not c.create_only])


def valid_only(df: DataFrame, table: TableDef) -> DataFrame:
    """What a bulk load keeps: rows whose geometries outside 4326 that are no points are valid or null."""
    for c in table.columns:
        if c.type in GEOMETRIES and c.type not in ("point", "multipoint") and c.projection != 4326 and not c.create_only:
            df = df.where(F.coalesce(st.is_valid(c.name), F.lit(True)))
    return df
