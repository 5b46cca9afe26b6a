"""Near-duplicate embeddings: int8 tile products with rigorous error bounds.

Vectors of one label are cut into blocks, blocks into pairs (tiles). A tile
multiplies int8 vectors, bounds each product's error by the two vectors'
quantisation errors, and recomputes in double precision only pairs that may reach
the threshold. It returns a count for each vector and a spanning forest of its
links, never the pairs. All pairs of a label are compared, which a threshold on
the cosine asks for; the work of a label is dealt over its tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .components import connected_components
from .groups import roots

BLOCKS = "label string, block long, ids array<long>, dim int, vectors binary"
LINKS = "a long, b long, add long"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to (int8 rows, scale, bound on the 2-norm of what rounding lost)."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None])
    err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, err * (1 + 1e-9) + 1e-12


def close_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float, step: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with cosine >= threshold; b None: pairs i < j within a.

    For unit x = s q + e: |x.y - s_x s_y q_x.q_y| <= |e_y| + |e_x| (1 + |e_y|).
    Products of int8 rows are exact in float32 below 1,040 dimensions, in float64 above.
    """
    same, b = b is None, a if b is None else b
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    (qa, sa, ea), (qb, sb, eb) = quantise(a / na[:, None]), quantise(b / nb[:, None])
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    maybe = product * (sa[:, None] * sb) + (eb + ea[:, None] * (1 + eb)) + 1e-9 >= threshold
    i, j = np.nonzero(np.triu(maybe, 1) if same else maybe)
    keep = [np.zeros(0, bool)]
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        keep.append(np.einsum("nd,nd->n", a[x], b[y]) / (na[x] * nb[y]) >= threshold)
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def _links(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    count = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    root = roots(i, j, n)
    some, child = np.nonzero(count)[0], np.nonzero(root != np.arange(n))[0]
    a = np.concatenate([ids[some], ids[child]])
    b = pa.array(np.concatenate([ids[some], ids[root[child]]]), mask=np.arange(len(a)) < len(some))
    add = pa.array(np.concatenate([count[some], count[child]]), mask=np.arange(len(a)) >= len(some))
    return pa.RecordBatch.from_arrays([pa.array(a), b.cast(pa.int64()), add.cast(pa.int64())], names=["a", "b", "add"])


def near_duplicates(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", threshold=0.93, block=1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, zero, or hold null or non-finite components, and those
    with a null label or null id, link with nothing: n_links 0, themselves their
    component. Vectors of different lengths link with nothing of another length.
    Rows that repeat an id are separate vectors; each shows the sum of their links.
    """
    small_batches(vectors.sparkSession, 2048)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    good = good.withColumn("label", F.concat_ws("|", F.size("v"), "label")).withColumn("h", F.xxhash64("id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        label, ids, vecs = None, [], []

        def out():
            nonlocal count, ids, vecs
            m = np.array(vecs, "<f8")
            m *= 1 / np.maximum(np.abs(m).max(axis=1), 1e-300)[:, None]  # squares of very large or small components stay finite
            row = pa.RecordBatch.from_arrays([pa.array([label]), pa.array([(part << 32) + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["label", "block", "ids", "dim", "vectors"])
            count, ids, vecs = count + 1, [], []
            return row

        for b in batches:
            for k, i, v in zip(b.column("label").to_pylist(), b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                if ids and (k != label or len(ids) >= block):
                    yield out()
                label = k
                ids.append(i)
                vecs.append(v)
        if ids:
            yield out()

    # Ranges over (label, hash) split a label with most of the vectors.
    blocks = materialise(good.repartitionByRange("label", "h").sortWithinPartitions("label", "h", "id").select("label", "id", "v").mapInArrow(pack, BLOCKS), "blocks")
    rank = blocks.select("label", "block").selectExpr("label AS label2", "block AS block2", "CAST(row_number() OVER (PARTITION BY label ORDER BY block) - 1 AS INT) AS r", "CAST(count(*) OVER (PARTITION BY label) AS INT) AS n")
    placed = blocks.join(rank, (F.col("label") == F.col("label2")) & (F.col("block") == F.col("block2"))).drop("label2", "block2")
    tiles = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("label", F.least("r", "o").alias("ti"), F.greatest("r", "o").alias("tj"), "r", "ids", "dim", "vectors")

    def tile(t: pa.Table) -> pa.Table:
        part = [(np.array(x["ids"]), np.frombuffer(x["vectors"], "<f8").reshape(-1, x["dim"])) for x in sorted(t.to_pylist(), key=lambda x: x["r"])]
        if len(part) == 1:
            return pa.Table.from_batches([_links(part[0][0], *close_pairs(part[0][1], None, threshold))])
        (ia, a), (ib, b) = part
        i, j = close_pairs(a, b, threshold)
        return pa.Table.from_batches([_links(np.concatenate([ia, ib]), i, j + len(ia))])

    links = materialise(tiles.groupBy("label", "ti", "tj").applyInArrow(tile, LINKS), "links")
    sums = links.where("add IS NOT NULL").groupBy("a").agg(F.sum("add").alias("n_links"))
    comp = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    found = materialise(sums.join(comp, sums["a"] == comp["id"], "left").select("a", "n_links", F.coalesce("component", "a").alias("component")), "linked")
    out = rows.select("id").join(found, F.col("id") == F.col("a"), "left")
    comp_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(True)).alias("kept"))
