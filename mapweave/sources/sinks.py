"""Writers: clustered tables, text of copies, tiles, GeoJSON, key/value properties, users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import tile_box


def write_clustered(df: DataFrame, path: str, quadkey: Column, partitions: int | None = None, **options) -> None:
    """Parquet in the order of a quadkey, so that neighbours share files and row groups."""
    key = df.withColumn("__key", quadkey)
    ranged = key.repartitionByRange(partitions, "__key") if partitions else key.repartitionByRange("__key")
    ranged.sortWithinPartitions("__key").drop("__key").write.options(**options).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "id") -> None:
    """A table in buckets by id: later joins on it don't shuffle this side."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def copy_text(*cols: Column) -> Column:
    """A row as text for bulk loading: tabs between, \\N for null, backslash escapes."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat_ws("\t", *[F.coalesce(esc(c), F.lit("\\N")) for c in cols])


def copy_array(c: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("}"))


def only_valid(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Rows whose geometry is valid or null."""
    from ..functions.st import is_valid

    return df.where(F.coalesce(is_valid(geom), F.lit(True)))


def replace_rows(old: DataFrame, gone: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Deletions first, then the new rows."""
    return old.join(gone.select(*key).distinct(), key, "left_anti").unionByName(new)


def upsert_tiles(old: DataFrame, tiles: DataFrame, now: Column) -> DataFrame:
    """(zoom, x, y, first, last): new tiles get both times, known ones a new last."""
    new = tiles.select("zoom", "x", "y").distinct().withColumn("hit", F.lit(True))
    j = old.join(new, ["zoom", "x", "y"], "full_outer")
    return j.select("zoom", "x", "y", F.coalesce("first", now).alias("first"), F.when(F.col("hit"), now).otherwise(F.col("last")).alias("last"))


def tile_lines(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.concat_ws("/", "zoom", "x", "y").alias("value"))


def tile_geojson(tiles: DataFrame) -> DataFrame:
    """A feature a row; ``feature_collection`` wraps them."""
    b = tile_box(F.col("x"), F.col("y"), F.col("zoom"))
    ring = F.array(*[F.array(b[x], b[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    props = F.struct("zoom", "x", "y")
    return tiles.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))


def feature_collection(features: list[str]) -> str:
    head = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:3857"}},"features":['
    return head + ",\n".join(features) + "]}"


def upsert_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """(property, value): new values win."""
    return old.join(new.select("property"), "property", "left_anti").unionByName(new)


def add_users(known: DataFrame, objects: DataFrame) -> DataFrame:
    """(uid, user): names that are known stay; of several new ones the least is kept."""
    new = objects.where("uid IS NOT NULL AND uid > 0").groupBy("uid").agg(F.min("user").alias("user"))
    return known.select("uid", "user").unionByName(new.join(known, "uid", "left_anti"))


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def scratch(spark, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only where the driver is the executor."""
    import re
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mapweave-")
    return f"{base.rstrip('/')}/mapweave/{name}-{uuid.uuid4().hex[:12]}"
