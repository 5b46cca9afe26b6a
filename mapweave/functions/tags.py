"""Tags (map<string,string>) and strings as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def grab_tag(tags: Column, key: str) -> tuple[Column, Column]:
    """(the value, the tags without it); an empty key is an error."""
    if not key:
        raise ValueError("grab_tag needs a key")
    return tag(tags, key), F.map_filter(tags, lambda k, v: k != key)


def _matches(key: Column, patterns: list[str]) -> Column:
    """'abc' exactly, 'abc*' as a prefix, '*abc' as a suffix; a pattern with a last '*' is a prefix first."""
    exact = [p for p in patterns if "*" not in p]
    out = key.isin(exact) if exact else F.lit(False)
    for p in patterns:
        if p.endswith("*"):
            out = out | key.startswith(p[:-1])
        elif p.startswith("*"):
            out = out | key.endswith(p[1:])
    return out


def clean_tags(tags: Column, patterns: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: ~_matches(k, patterns))


def is_empty(tags: Column) -> Column:
    return tags.isNull() | (F.size(tags) <= 0)


def has_prefix(s: Column, prefix: str) -> Column:
    return s.startswith(prefix)


def has_suffix(s: Column, suffix: str) -> Column:
    return s.endswith(suffix)


def check_values(s: Column, allowed: list[str], default: str | None = None) -> Column:
    return F.when(s.isin(allowed), s).otherwise(F.lit(default).cast("string"))


def clamp(v: Column, low, high) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))


def trim(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", "")


def split_unit(s: Column, default: str | None = None) -> Column:
    """'-1.5 ft' to struct<value,unit>; no number, or one of several dots: null."""
    pattern = r"^(-?[0-9.]+) ?([A-Za-z]*)$"
    value = F.regexp_extract(s, pattern, 1).try_cast("double")
    unit = F.regexp_extract(s, pattern, 2)
    return F.when(s.rlike(pattern) & value.isNotNull(), F.struct(value.alias("value"), F.when(unit != "", unit).otherwise(F.lit(default)).alias("unit")))


def split_string(s: Column, seps: str = ";") -> Column:
    """Cut at any of the characters, drop empty pieces, trim the others; null: no pieces."""
    cut = F.split(s, "[" + re.escape(seps) + "]")
    return F.coalesce(F.transform(F.filter(cut, lambda x: x != ""), trim), F.array().cast("array<string>"))


def wild_match(pattern: str, s: Column) -> Column:
    """'*' any run, '?' one character; case counts; the whole string."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return s.rlike("(?s)^" + body + r"\z")


def value_to_bool(v: Column, default: bool) -> Column:
    yes, no = v.isin("yes", "true", "1"), v.isin("no", "false", "0")
    return F.coalesce(~no if default else yes, F.lit(default))


def member_ids(members: Column, kind: str) -> Column:
    """Refs of the members of a type ('n', 'w', 'r'), in order."""
    return F.transform(F.filter(members, lambda m: m["type"] == kind), lambda m: m["ref"])


def with_attributes(tags: Column, row: dict[str, Column]) -> Column:
    """Tags and the object's attributes (user, uid, version, timestamp, changeset) as pseudo tags; null attributes are left out."""
    new = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f"osm_{k}").alias("key"), v.cast("string").alias("value")) for k, v in row.items()]), lambda e: e["value"].isNotNull()))
    return F.map_concat(F.map_filter(tags, lambda k, v: ~k.isin([f"osm_{n}" for n in row])), new)


def check_identifier(name: str) -> str:
    bad = set(name) & set("\"',.;$%&/()<>{}=?^*#")
    if bad:
        raise ValueError(f"characters not allowed in {name!r}: {''.join(sorted(bad))}")
    return name


# -- z order, relations, extra columns ------------------------------------------

#: A highway's offset in the drawing order, and whether it belongs to the roads.
HIGHWAYS = {
    "proposed": (1, False), "construction": (2, False), "steps": (10, False), "cycleway": (10, False), "bridleway": (10, False),
    "footway": (10, False), "path": (10, False), "track": (11, False), "service": (15, False), "tertiary_link": (24, False),
    "secondary_link": (25, True), "primary_link": (27, True), "trunk_link": (28, True), "motorway_link": (29, True), "raceway": (30, False),
    "pedestrian": (31, False), "living_street": (32, False), "road": (33, False), "unclassified": (33, False), "residential": (33, False),
    "tertiary": (34, False), "secondary": (36, True), "primary": (37, True), "trunk": (38, True), "motorway": (39, True),
}
#: The same for the tag transformation that users bring as a script.
SCRIPT_HIGHWAYS = {
    "minor": (3, False), "road": (3, False), "unclassified": (3, False), "residential": (3, False), "tertiary_link": (4, False), "tertiary": (4, False),
    "secondary_link": (6, True), "secondary": (6, True), "primary_link": (7, True), "primary": (7, True), "trunk_link": (8, True), "trunk": (8, True),
    "motorway_link": (9, True), "motorway": (9, True),
}


def prefix_int(s: Column) -> Column:
    """The integer that a string begins with, after blanks, kept to 64 bits and cut to the low 32; 0 where there is none."""
    digits = F.regexp_extract(s, r"^\s*([-+]?[0-9]+)", 1)
    low = F.coalesce(digits.try_cast("bigint"), F.when(digits == "", 0).when(digits.startswith("-"), 0).otherwise(-1)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(s.isNull(), 0).otherwise(F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int"))


def z_order(tags: Column, highways: dict[str, tuple[int, bool]] = HIGHWAYS) -> Column:
    """100 a layer and the highway's offset, 35 for railways, 100 for bridges, -100 for tunnels."""
    offset = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in highways.items() for x in (k, v)]), tag(tags, "highway")), F.lit(0))
    on = lambda k: F.when(F.coalesce(tag(tags, k).isin("yes", "true", "1"), F.lit(False)), 100).otherwise(0)
    rail = F.when(F.coalesce(F.length(tag(tags, "railway")) > 0, F.lit(False)), 35).otherwise(0)
    return (prefix_int(tag(tags, "layer")).cast("long") * 100 + offset + rail + on("bridge") - on("tunnel")).cast("int")


def is_road(tags: Column, highways: dict[str, tuple[int, bool]] = HIGHWAYS) -> Column:
    roads = tag(tags, "highway").isin([k for k, (_, r) in highways.items() if r])
    return F.coalesce(roads, F.lit(False)) | F.coalesce(F.length(tag(tags, "railway")) > 0, F.lit(False)) | F.coalesce(tag(tags, "boundary") == "administrative", F.lit(False))


NETWORKS = ("lcn", "rcn", "ncn", "lwn", "rwn", "nwn")


def relation_tags(tags: Column) -> Column:
    """struct<keep, boundary, polygon, tags> of a relation: routes, boundaries and multipolygons with any tag but ``type``; tags without ``type``.

    Routes get the name as route_name, their network's name as a key with the state
    (alternate, connection, else yes), the ref as network_ref, and
    route_pref_color, one digit from 0 to 4. Keys that are there already stay.
    """
    kind, network, state, color = (tag(tags, k) for k in ("type", "network", "state", "preferred_color"))
    bare = F.map_filter(tags, lambda k, v: k != "type")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    known = network.isin(*NETWORKS)
    more = [entry(F.when(known, network), F.when(state.isin("alternate", "connection"), state).otherwise("yes")), entry(F.when(known, F.concat(network, F.lit("_ref"))), tag(tags, "ref")),
            entry(F.lit("route_pref_color"), F.when(color.rlike(r"^[0-4]\z"), color).otherwise("0"))]
    name = tag(tags, "name")
    named = F.when(name.isNotNull(), F.map_concat(F.map_filter(bare, lambda k, v: k != "route_name"), F.create_map(F.lit("route_name"), name))).otherwise(bare)
    routed = F.map_concat(named, F.map_from_entries(F.filter(F.array(*more), lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.coalesce(F.map_contains_key(named, F.coalesce(e["key"], F.lit(""))), F.lit(False)))))
    boundary = (kind == "boundary") | ((kind == "multipolygon") & tag(tags, "boundary").isNotNull())
    return F.struct(F.coalesce(kind.isin("route", "boundary", "multipolygon") & (F.size(bare) > 0), F.lit(False)).alias("keep"), F.coalesce(boundary, F.lit(False)).alias("boundary"),
                    F.coalesce((kind == "multipolygon") & ~boundary, F.lit(False)).alias("polygon"), F.when(kind == "route", routed).otherwise(bare).alias("tags"))


def parse_tags(text: Column) -> Column:
    """Tags from a JSON object of strings, in order of keys; no object: null."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.from_json(text, "map<string,string>"))))


def parse_members(text: Column) -> Column:
    """Members from a JSON array of {"type": "N", "ref": 1, "role": ""}, the type's letter in either case."""
    raw = F.from_json(text, "array<struct<type:string,ref:bigint,role:string>>")
    return F.transform(raw, lambda m: F.struct(F.lower(m["type"]).alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role")))


def hstore(tags: Column, mode: str, columns: list[str], prefixes: tuple[str, ...] = ()) -> Column:
    """The tags column: mode 'none' null, 'norm' those without a column of their own, 'all' all; without z_order; empty is null."""
    if mode == "none":
        return F.lit(None).cast("map<string,string>")
    out = F.map_filter(tags, lambda k, v: (k != "z_order") & (~k.isin(columns) if mode == "norm" and columns else F.lit(True)))
    return F.when(F.size(out) > 0, out)


def prefix_store(tags: Column, prefix: str) -> Column:
    """Tags whose keys begin with a prefix, without it; none is null."""
    out = F.transform_keys(F.map_filter(tags, lambda k, v: k.startswith(prefix)), lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
    return F.when(F.size(out) > 0, out)


def hstore_text(tags: Column) -> Column:
    """Tags as text: "key"=>"value" in order of keys, with quotes and backslashes escaped."""
    esc = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(esc(e["key"]), F.lit("=>"), esc(e["value"]))), ",")


# -- durations and times -----------------------------------------------------------

def duration(seconds: Column) -> Column:
    """'75s (1m 15s)' and '3675s (1h 1m 15s)'; below a minute only seconds."""
    s = seconds.cast("long")
    h, m, r = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%ds (%dm %ds)", s, m, r)).otherwise(F.format_string("%ds (%dh %dm %ds)", s, h, m, r))


def pretty_delta(seconds: Column) -> Column:
    """Weeks, days, hours, minutes, seconds, from the largest that is not zero on."""
    s = seconds.cast("long")
    out = F.concat((s % 60).cast("string"), F.lit(" second(s)"))
    for size, more, unit in ((60, 60, "minute(s)"), (3600, 24, "hour(s)"), (86400, 7, "day(s)"), (604800, None, "week(s)")):
        v = F.floor(s / size).cast("long")
        out = F.when(s >= size, F.concat((v % more if more else v).cast("string"), F.lit(f" {unit} "), out)).otherwise(out)
    return out


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")
