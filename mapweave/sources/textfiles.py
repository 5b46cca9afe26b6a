"""Readers of object files as text: OPL lines, XML, change XML, tile lists, style files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.st import arrow_fn
from ..model import SCALE


def _plain(text: str) -> str:
    return re.sub(r"%([0-9a-fA-F]+)%", lambda m: chr(int(m[1], 16)), text)


def _unescape(c) -> Column:
    return arrow_fn(_plain, "string")(c)


def _unescape_all(c) -> Column:
    return arrow_fn(lambda vs: [_plain(v) for v in vs], "array<string>")(c)


def read_opl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of line files: ``n1 v1 dV c2 t2020-01-01T00:00:00Z i3 uname Tk=v,.. x1.5 y2.5``; ways N n1,n2; relations M w1@role,n2@."""
    return from_opl(spark.read.text(path))


def from_opl(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = F.col("value")
    rows = lines.where(line.rlike("^[nwr][0-9-]"))
    field = lambda c: F.regexp_extract(line, rf"(?:^| ){c}([^ ]*)", 1)
    some = lambda c: F.when(field(c) != "", field(c))
    tags = F.when(field("T") == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform(F.split(field("T"), ","), lambda t: F.struct(F.split(t, "=")[0].alias("k"), F.split(t, "=", 2)[1].alias("v")))))
    base = rows.select(
        F.substring(line, 1, 1).alias("type"), F.regexp_extract(line, "^.(-?[0-9]+)", 1).cast("long").alias("id"), F.coalesce(some("v").cast("int"), F.lit(0)).alias("version"),
        some("t").try_cast("timestamp").alias("ts"), some("c").cast("long").alias("changeset"), some("i").cast("int").alias("uid"), some("u").alias("user"),
        (F.coalesce(some("d"), F.lit("V")) == "V").alias("visible"), tags.alias("tags"), some("x").alias("sx"), some("y").alias("sy"), field("N").alias("refs"), field("M").alias("mem"))
    escaped = base.withColumn("user", _unescape("user"))
    plain = escaped.withColumn("tags", F.when(F.size("tags") > 0, F.map_from_arrays(_unescape_all(F.map_keys("tags")), _unescape_all(F.map_values("tags")))).otherwise(F.col("tags")))
    fixed = lambda c: F.round(F.col(c).cast("decimal(20,10)") * SCALE).cast("int")
    head = ["id", "version", "ts", "changeset", "uid", "user", "visible", "tags"]
    nodes = plain.where("type = 'n'").select(*head, F.coalesce(fixed("sx"), F.lit(2147483647)).alias("x"), F.coalesce(fixed("sy"), F.lit(2147483647)).alias("y"))
    ways = plain.where("type = 'w'").select(*head, F.when(F.col("refs") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("refs", ","), lambda r: F.regexp_extract(r, "^n(-?[0-9]+)", 1).cast("long"))).alias("nodes"))
    member = lambda m: F.struct(F.substring(m, 1, 1).alias("type"), F.regexp_extract(m, "^.(-?[0-9]+)", 1).cast("long").alias("ref"), F.regexp_extract(m, "@(.*)$", 1).alias("role"))
    rels = plain.where("type = 'r'").select(*head, F.when(F.col("mem") == "", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).otherwise(F.transform(F.split("mem", ","), member)).alias("members"))
    return nodes, ways, rels


_TAG = "tag array<struct<_k:string,_v:string>>"
_ATTR = "_id bigint, _version int, _timestamp timestamp, _changeset bigint, _uid int, _user string, _visible boolean"


def _xml(spark: SparkSession, path: str, row: str, more: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(f"{_ATTR}, {_TAG}, {more}").load(path)


def _head(df: DataFrame) -> list:
    tags = F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>"))
    return [F.col("_id").alias("id"), F.coalesce("_version", F.lit(0)).alias("version"), F.col("_timestamp").alias("ts"), F.col("_changeset").alias("changeset"), F.col("_uid").alias("uid"), F.col("_user").alias("user"), F.coalesce("_visible", F.lit(True)).alias("visible"), tags.alias("tags")]


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of XML files; compressed ones by their suffix."""
    n = _xml(spark, path, "node", "_lat double, _lon double")
    w = _xml(spark, path, "way", "nd array<struct<_ref:bigint>>")
    r = _xml(spark, path, "relation", "member array<struct<_type:string,_ref:bigint,_role:string>>")
    fixed = lambda c: F.coalesce(F.round(F.col(c) * SCALE).cast("int"), F.lit(2147483647))
    refs = F.coalesce(F.transform("nd", lambda x: x["_ref"]), F.array().cast("array<bigint>"))
    members = F.coalesce(F.transform("member", lambda m: F.struct(F.substring(m["_type"], 1, 1).alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))), F.array().cast("array<struct<type:string,ref:bigint,role:string>>"))
    return n.select(*_head(n), fixed("_lon").alias("x"), fixed("_lat").alias("y")), w.select(*_head(w), refs.alias("nodes")), r.select(*_head(r), members.alias("members"))


def read_changes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change XML: as read_xml, with ``visible`` false for what stands under delete; several versions of one object stay."""
    def find(pdf_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bz2
        import gzip
        import xml.etree.ElementTree as ET

        for pdf in pdf_iter:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(raw) if name.endswith(".gz") else bz2.decompress(raw) if name.endswith(".bz2") else raw
                out = []
                for block in ET.fromstring(data):
                    if block.tag in ("create", "modify", "delete"):
                        out += [(block.tag, ET.tostring(e, encoding="unicode")) for e in block]
                yield pd.DataFrame(out, columns=["op", "xml"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(find, "op string, xml string")
    split = {}
    for kind, more in (("node", "_lat double, _lon double"), ("way", "nd array<struct<_ref:bigint>>"), ("relation", "member array<struct<_type:string,_ref:bigint,_role:string>>")):
        split[kind] = rows.where(F.col("xml").startswith(f"<{kind}")).select("op", F.from_xml("xml", f"{_ATTR}, {_TAG}, {more}").alias("o")).select("op", "o.*")
    gone = (F.col("op") != "delete").alias("visible")
    head = lambda d: [c for c in _head(d)[:6]] + [gone, _head(d)[7]]
    n, w, r = split["node"], split["way"], split["relation"]
    fixed = lambda c: F.coalesce(F.round(F.col(c) * SCALE).cast("int"), F.lit(2147483647))
    return (n.select(*head(n), fixed("_lon").alias("x"), fixed("_lat").alias("y")),
            w.select(*head(w), F.coalesce(F.transform("nd", lambda x: x["_ref"]), F.array().cast("array<bigint>")).alias("nodes")),
            r.select(*head(r), F.coalesce(F.transform("member", lambda m: F.struct(F.substring(m["_type"], 1, 1).alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))), F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members")))


def read_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tiles, lines that are none) of files with a zoom/x/y a line."""
    from ..functions.coords import parse_tile

    rows = spark.read.text(path).withColumn("tile", parse_tile(F.col("value")))
    return rows.where("tile IS NOT NULL").select("tile.*"), rows.where("tile IS NULL").select("value")


@dataclass(frozen=True)
class StyleRule:
    kinds: str
    key: str
    type: str
    flags: frozenset

    @property
    def wildcard(self) -> bool:
        return "*" in self.key or "?" in self.key


def parse_style(text: str) -> tuple[list[StyleRule], bool]:
    """Rules of a style file, and whether areas get a column: ``kinds key type [flags]`` a line, # for comments."""
    rules, way_area = [], True
    for number, line in enumerate(text.splitlines(), 1):
        part = line.split("#", 1)[0].split()
        if not part:
            continue
        if len(part) < 3:
            raise ValueError(f"line {number}: three columns or more are needed")
        kinds, key, kind, *flags = part
        found = {k for k in kinds.split(",")}
        if not found <= {"node", "way"}:
            raise ValueError(f"line {number}: {kinds} is neither node nor way")
        marks = frozenset(f for f in (flags[0].split(",") if flags else []) if f)
        rule = StyleRule("".join(sorted(k[0] for k in found)), key, kind, marks)
        if rule.wildcard and "delete" not in marks:
            raise ValueError(f"line {number}: a wildcard needs the flag delete")
        if key == "way_area" and "delete" in marks:
            way_area = False
            continue
        rules.append(rule)
    if not rules:
        raise ValueError("no rules")
    return rules, way_area
