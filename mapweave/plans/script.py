"""Tag transformations that users bring for the older output, as functions of columns, and the standard one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tags as T

#: Ways with one of these keys are areas.
POLYGON_KEYS = (
    "aeroway", "amenity", "building", "harbour", "historic", "landuse", "leisure", "man_made", "military", "natural",
    "office", "place", "power", "public_transport", "shop", "sport", "tourism", "water", "waterway", "wetland",
)
#: Objects without any of these keys are dropped.
GENERIC_KEYS = (
    "access", "addr:housename", "addr:housenumber", "addr:interpolation", "admin_level", "aerialway", "aeroway", "amenity", "area", "barrier",
    "bicycle", "boundary", "brand", "bridge", "building", "capital", "construction", "covered", "culvert", "cutting",
    "denomination", "disused", "ele", "embarkment", "foot", "generation:source", "harbour", "highway", "historic", "hours",
    "intermittent", "junction", "landuse", "layer", "leisure", "lock", "man_made", "military", "motor_car", "name",
    "natural", "office", "oneway", "operator", "place", "population", "power", "power_source", "public_transport", "railway",
    "ref", "religion", "route", "service", "shop", "sport", "surface", "toll", "tourism", "tower:type",
    "tracktype", "tunnel", "type", "water", "waterway", "wetland", "width", "wood",
)
#: Keys that are deleted.
DELETED_KEYS = ("FIXME", "note", "source")


@dataclass(frozen=True)
class TagScript:
    """Four functions of map columns; what each returns has these fields.

    node(tags): keep, tags. way(tags): keep, polygon, roads, tags.
    relation(tags): keep, tags. member(tags, member_tags, roles), on the tags that
    ``relation`` kept, with arrays of the members' tags and roles: keep, boundary,
    polygon, roads, tags. ``z_order`` among the tags gives the column of that name.
    """

    node: Callable[[Column], Column]
    way: Callable[[Column], Column]
    relation: Callable[[Column], Column]
    member: Callable[[Column, Column, Column], Column]


def has_any(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.isin(*keys)), F.lit(False))


def is_value(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(T.tag(tags, key).isin(*values), F.lit(False))


def basic(tags: Column) -> Column:
    """struct<keep, tags>: without deleted keys; kept if any generic key is left."""
    left = F.map_filter(tags, lambda k, v: ~k.isin(*DELETED_KEYS))
    return F.struct(has_any(left, GENERIC_KEYS).alias("keep"), left.alias("tags"))


def script_z_order(tags: Column) -> Column:
    """10 a layer (0 where that is no decimal number) and the highway's offset, 5 for railways, 10 for bridges, -10 for tunnels; a fraction is cut off at the end."""
    layer = T.tag(tags, "layer")
    number = F.when(layer.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*\z"), F.trim(layer).try_cast("double"))
    offset = F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in T.SCRIPT_HIGHWAYS.items() for x in (k, v)]), T.tag(tags, "highway"))
    high = lambda k: is_value(tags, k, "yes", "true").cast("int")
    rail = T.tag(tags, "railway").isNotNull().cast("int")
    return F.coalesce(number * 10, F.lit(0.0)).try_cast("long") + F.coalesce(offset, F.lit(0)) + rail * 5 + high("bridge") * 10 - high("tunnel") * 10


def script_roads(tags: Column) -> Column:
    return T.tag(tags, "railway").isNotNull() | is_value(tags, "boundary", "administrative") | is_value(tags, "highway", *[k for k, (_, road) in T.SCRIPT_HIGHWAYS.items() if road])


def with_z_order(tags: Column) -> Column:
    other = F.map_filter(tags, lambda k, v: k != "z_order")
    return F.map_concat(other, F.create_map(F.lit("z_order"), script_z_order(tags).cast("string")))


def standard_way(tags: Column) -> Column:
    """``area`` decides on an area if it says yes or no, else any of the polygon keys does."""
    b = basic(tags)
    keep, left = b["keep"], b["tags"]
    area = F.when(is_value(left, "area", "yes", "1", "true"), True).when(is_value(left, "area", "no", "0", "false"), False).otherwise(has_any(left, POLYGON_KEYS))
    return F.struct(keep.alias("keep"), (keep & area).alias("polygon"), (keep & script_roads(left)).alias("roads"), F.when(keep, with_z_order(left)).otherwise(left).alias("tags"))


def standard_relation(tags: Column) -> Column:
    b = basic(tags)
    return F.struct((b["keep"] & is_value(b["tags"], "type", "route", "multipolygon", "boundary")).alias("keep"), b["tags"].alias("tags"))


def standard_member(tags: Column, member_tags: Column, roles: Column) -> Column:
    """Boundaries, and multipolygons that are one, give lines; other multipolygons areas. The members don't matter."""
    multi, border = is_value(tags, "type", "multipolygon"), T.tag(tags, "boundary").isNotNull()
    bare = F.map_filter(tags, lambda k, v: k != "type")
    return F.struct(F.lit(True).alias("keep"), (is_value(tags, "type", "boundary") | (multi & border)).alias("boundary"), (multi & ~border).alias("polygon"), script_roads(bare).alias("roads"), with_z_order(bare).alias("tags"))


STANDARD = TagScript(basic, standard_way, standard_relation, standard_member)
