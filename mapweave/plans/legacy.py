"""The older output: a style decides which tags are kept, and four tables take the objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as K
from ..functions import tags as T
from ..sources.textfiles import StyleRule
from .script import TagScript


def _rule_hit(rule: StyleRule, key: Column) -> Column:
    return T.wild_match(rule.key, key) if rule.wildcard else key == rule.key


def key_decision(rules: list[StyleRule], kind: str, key: Column, hstore: bool = False) -> Column:
    """'delete', 'column', 'hstore' or 'drop' for a key: the first rule of the kind, in the file's order, that hits."""
    out = F.lit("hstore" if hstore else "drop")
    for r in reversed([r for r in rules if kind in r.kinds]):
        out = F.when(_rule_hit(r, key), "delete" if "delete" in r.flags else "column").otherwise(out)
    return out


def filter_tags(tags: Column, rules: list[StyleRule], kind: str, hstore: str = "none", match_only: bool = False, keep_coastlines: bool = False) -> Column:
    """struct<keep, polygon, tags>: the tags kept, whether the object is, and whether it is an area.

    A polygon flag of a kept key makes an area, ``area`` overrules it, and a
    coastline (its tag dropped unless kept) is always one.
    """
    coast = (T.tag(tags, "natural") == "coastline") if kind == "w" else F.lit(False)
    base = tags if keep_coastlines or kind != "w" else F.map_filter(tags, lambda k, v: ~((k == "natural") & (v == "coastline")))
    stored = hstore != "none"
    kept = F.map_filter(base, lambda k, v: key_decision(rules, kind, k, stored).isin("column", "hstore"))
    named = F.map_filter(base, lambda k, v: key_decision(rules, kind, k, stored) == "column")
    counts = F.size(named if match_only or not stored else kept) > 0
    poly_keys = [r.key for r in rules if kind in r.kinds and "polygon" in r.flags and "delete" not in r.flags]
    flagged = F.exists(F.map_keys(base), lambda k: k.isin(poly_keys)) if poly_keys else F.lit(False)
    polygon = F.when(F.coalesce(coast, F.lit(False)), True).when(T.tag(tags, "area").isNotNull(), T.value_to_bool(T.tag(tags, "area"), False)).otherwise(F.coalesce(flagged, F.lit(False)))
    with_area = F.when(F.coalesce(coast, F.lit(False)) & T.tag(kept, "area").isNull(), F.map_concat(kept, F.create_map(F.lit("area"), F.lit("yes")))).otherwise(kept)
    return F.struct(counts.alias("keep"), polygon.alias("polygon"), with_area.alias("tags"))


def style_columns(rules: list[StyleRule], kinds: str) -> list[StyleRule]:
    return [r for r in rules if set(kinds) & set(r.kinds) and not r.wildcard and "delete" not in r.flags and "phstore" not in r.flags]


def typed(tags: Column, rule: StyleRule) -> Column:
    v = T.tag(tags, rule.key)
    return (K.legacy_int(v) if rule.type in ("int4", "int8", "integer") else K.legacy_real(v) if rule.type == "real" else v).alias(rule.key)


def tables(nodes: DataFrame, ways: DataFrame, relations: DataFrame, rules: list[StyleRule], hstore: str = "none", line_length: float = 100_000.0, script: TagScript | None = None, **options) -> dict[str, DataFrame]:
    """point, line, polygon, roads of nodes (id, tags, geom) and of ways and relations (id, tags, line and area as EWKB or null).

    Relations have negative ids. Boundaries give lines and polygons, routes only
    lines, multipolygons only polygons; an area that could not be built gives no
    row. A ``script`` decides on tags in place of the style, which then only names
    the columns; it sees relations' ``member_tags`` and ``roles`` where they have them.
    """
    from ..functions import st

    def prepare(df, kind):
        if script:
            f = (script.node if kind == "n" else script.way)(F.col("tags"))
        else:
            f = filter_tags(F.col("tags"), rules, kind, hstore, **options)
        df = df.withColumn("f", f).where("f.keep")
        more = {"polygon": F.col("f.polygon")} if kind == "w" or not script else {}
        return df.withColumns({"tags": F.col("f.tags"), "road": F.col("f.roads") if script and kind == "w" else T.is_road(F.col("f.tags")), **more})

    def shape(df, kinds, geom):
        cols = style_columns(rules, kinds)
        z = F.coalesce(K.legacy_int(T.tag(F.col("tags"), "z_order")), F.lit(0)) if script else T.z_order(F.col("tags"))
        more = [T.hstore(F.col("tags"), hstore, [r.key for r in cols]).alias("tags")] if hstore != "none" else []
        return df.where(F.col(geom).isNotNull()).select(F.col("oid").alias("osm_id"), *[typed(F.col("tags"), r) for r in cols if r.key != "z_order"], *more, z.alias("z_order"), F.col("road"), F.col(geom).alias("way"))

    point = shape(prepare(nodes, "n").withColumn("oid", F.col("id")), "n", "geom").drop("road", "z_order")
    w = prepare(ways, "w").withColumn("oid", F.col("id"))
    r = relations.withColumn("oid", -F.col("id"))
    if script:
        r = r.withColumn("rt", script.relation(F.col("tags"))).where("rt.keep")
        has = lambda c, kind: F.col(c) if c in relations.columns else F.array().cast(kind)
        r = r.withColumn("rt", script.member(F.col("rt.tags"), has("member_tags", "array<map<string,string>>"), has("roles", "array<string>"))).where("rt.keep")
        r = r.withColumn("road", F.col("rt.roads"))
    else:
        r = r.withColumn("rt", T.relation_tags(F.col("tags"))).where("rt.keep").withColumn("road", T.is_road(F.col("rt.tags")))
    r = r.withColumns({"boundary": F.col("rt.boundary"), "area_only": F.col("rt.polygon"), "tags": F.col("rt.tags")})
    cut = lambda df: df.withColumn("piece", F.explode(st.split_multi(st.segmentize("line", line_length)))).drop("line").withColumnRenamed("piece", "line")
    lines = shape(cut(w.where("NOT polygon AND line IS NOT NULL")), "w", "line").unionByName(shape(cut(r.where("NOT area_only AND line IS NOT NULL")), "w", "line"))
    polygons = shape(w.where("polygon"), "w", "area").unionByName(shape(r.where("boundary OR area_only"), "w", "area"))
    return {"point": point, "line": lines.drop("road"), "polygon": polygons.drop("road").withColumn("way_area", st.area("way")), "roads": lines.where("road").drop("road")}
