"""Schemas of nodes, ways, relations and changes, and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE = "id bigint, version int, ts timestamp, changeset bigint, uid int, user string, visible boolean, tags map<string,string>"
NODES = BASE + ", x int, y int"
WAYS = BASE + ", nodes array<bigint>"
RELATIONS = BASE + ", members array<struct<type:string,ref:bigint,role:string>>"
#: Fixed point of coordinates, the value of an undefined one, the most members a relation may have.
SCALE, UNDEFINED, MAX_MEMBERS = 10_000_000, 2147483647, 32767
#: Taken from the id of a relation in a table of all kinds.
RELATION_SHIFT = 10**17


def check_input(df: DataFrame, order: list[str], by: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """Counts of negative, repeated and unordered ids of a stream in file order: (negative, duplicate, unordered)."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.lag(id_col).over(w)
    c = F.col(id_col)
    return df.select(c, last.alias("last")).agg(F.count_if(c < 0).alias("negative"), F.count_if(c == F.col("last")).alias("duplicate"), F.count_if(c < F.col("last")).alias("unordered"))


def unique_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is negative or not alone, without any global order: (keys, n)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col(keys[-1]) < 0))


def no_deleted(df: DataFrame) -> DataFrame:
    """Fails at run time where an object is deleted: an import takes none."""
    return df.where(F.when(F.col("visible"), True).otherwise(F.raise_error(F.lit("deleted object in an import"))))


def latest_versions(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Of each object the last version, by a combinable maximum rather than a window, so that no object's versions are sorted."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    return df.groupBy(*keys).agg(top).select(*keys, "row.*")


def merge_files(frames: list[DataFrame], keys: list[str], version: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return latest_versions(out, keys, version)


def valid_locations(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("x") != UNDEFINED) & F.col("x").between(-180 * SCALE, 180 * SCALE) & F.col("y").between(-90 * SCALE, 90 * SCALE))


def in_bbox(nodes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Nodes of a box; ways and relations are never filtered by it."""
    x = lambda v: round(v * SCALE)
    return nodes.where(F.col("x").between(x(west), x(east)) & F.col("y").between(x(south), x(north)))


def members_within(relations: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    return relations.where(F.size("members") <= most)


def map_id(kind: str, table: str, id_col="id", has_type: bool = False):
    """The id an object has in a table: areas from relations are negative; in tables of all kinds ways are, and relations further down."""
    c = F.col(id_col)
    if table == "any" and not has_type:
        return {"n": c, "w": -c, "r": -c - F.lit(RELATION_SHIFT)}[kind]
    return -c if kind == "r" and table in ("area", "way") else c


def last_timestamp(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        one = f.agg(F.max("ts").alias("ts"))
        out = one if out is None else out.union(one)
    return out.agg(F.max("ts").alias("ts"))


@dataclass(frozen=True)
class ImportOptions:
    """What the command line sets; checked as a whole."""

    append: bool = False
    slim: bool = False
    drop: bool = False
    output: str = "flex"
    prefix: str = "planet"
    schema: str = "public"
    bbox: tuple[float, float, float, float] | None = None
    extra_attributes: bool = False
    hstore: str = "none"
    hstore_prefixes: tuple[str, ...] = ()
    hstore_match_only: bool = False
    keep_coastlines: bool = False
    projection: int = 3857
    multi_geometry: bool = False
    reproject_area: bool = False
    expire_zoom: tuple[int, int] | None = None
    expire_bbox_size: float = 20000.0
    cache: int = 800

    def __post_init__(self):
        if self.append and not self.slim:
            raise ValueError("append needs slim")
        if self.drop and not self.slim:
            raise ValueError("drop needs slim")
        if self.append and self.drop:
            raise ValueError("append and drop exclude each other")
        if self.output not in ("flex", "pgsql", "null"):
            raise ValueError(f"output {self.output!r}")
        if self.output == "flex" and (self.hstore != "none" or self.hstore_prefixes or self.hstore_match_only or self.multi_geometry or self.keep_coastlines):
            raise ValueError("options of the older output don't go with flex")
        if self.hstore not in ("none", "norm", "all"):
            raise ValueError(f"hstore {self.hstore!r}")
        if self.cache < 0 or (self.cache == 0 and not self.slim):
            raise ValueError("cache 0 needs slim; less is an error")
        if self.expire_zoom and not 0 <= self.expire_zoom[0] <= self.expire_zoom[1] <= 31:
            raise ValueError("expire zooms are 0 to 31")
        if self.expire_zoom and self.projection != 3857:
            raise ValueError("tiles expire in 3857 only")
        if self.bbox and not (self.bbox[0] < self.bbox[2] and self.bbox[1] < self.bbox[3]):
            raise ValueError("bbox is west, south, east, north")
