"""Shared plumbing: the cluster's shared folder, materialised tables, small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from sys import getsizeof

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share.

    The folder is what the session names in ``spark.checkpoint.dir``. Where that is
    unset, a temporary folder serves a driver that is its own executor (tests, a
    laptop); on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("mapweave.shared.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="mapweave-")
            spark.conf.set("mapweave.shared.dir", base)
    return f"{base.rstrip('/')}/mapweave/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what an Arrow batch of long texts takes in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def crc_fold(col: Column | str, folds: int) -> Column:
    """crc32 of a value's decimal text, modulo ``folds``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Recent(dict):
    """A dict of bounded size: beyond about ``most_bytes``, entries not used lately are forgotten.

    Entries live in two generations of half the size each. A key found in the old
    one moves to the new one; when that is full it becomes the old one. Keys and
    values are strings or bytes, which know their sizes.
    """

    def __init__(self, most_bytes: int, make):
        super().__init__()
        self.half, self.make, self.old = most_bytes // 2, make, {}
        self.left = self.half

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self.left -= getsizeof(key) + getsizeof(got) + 100  # 100: about a slot of the table
        if self.left < 0:
            self.old = dict(self)
            self.clear()
            self.left = self.half
        self[key] = got
        return got


_kept: dict = {}


def keep(key, make):
    """What this Python worker keeps from task to task under ``key``, made when it isn't there.

    Spark hands a worker from stage to stage. What it kept under other keys goes
    first, so a worker holds what one operator remembers and never their sum.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
