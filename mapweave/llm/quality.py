"""A quality classifier: histogram gradient-boosted trees over document statistics.

Features are statistics of the whole text, in Python on Arrow batches. Trees are
grown on binned features, level by level, on a bounded sample of labelled rows,
and flattened into arrays that numpy walks for a batch of documents at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_fold, small_batches

NAMES = ("log_chars", "log_words", "word_length", "long_words", "distinct_words", "top_word", "top5_words", "upper", "letters", "digits", "space",
         "punctuation", "symbols", "symbol_words", "repeated_lines", "line_words", "pair_repeats", "top_pair", "bars", "stops", "compressed")
#: Labelled rows that the model is fitted on at most: those with the smallest md5 of the id.
SAMPLE = 20_000


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; null counts as empty."""
    t = text or ""
    words = t.split()
    n, m = max(1, len(t)), max(1, len(words))
    raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.minimum(raw, 127), minlength=128)
    digits, upper_a, lower_a = counts[48:58].sum(), counts[65:91].sum(), counts[97:123].sum()
    space = counts[9:14].sum() + counts[32]
    common = counts[[33, 34, 39, 44, 45, 46, 58, 59, 63, 40, 41]].sum()
    letters = upper_a + lower_a + counts[127]
    wide = sum(map(str.isupper, t)) if counts[127] else upper_a
    by = Counter(words)
    top = by.most_common(5)
    lines = [x for x in t.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    top_pair = max(pairs.values(), default=0)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ends = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
    packed = len(zlib.compress(t[:0].encode() if not t else t.encode("utf-8", "surrogatepass"), 1)) if len(t) < 20_000 else _packed(t)
    return [
        np.log1p(len(t)), np.log1p(len(words)), lengths.mean(), (lengths > 20).mean(), len(by) / m,
        (top[0][1] if top else 0) / m, sum(c for _, c in top) / m, wide / max(1, letters), letters / n, digits / n, space / n,
        common / n, (n - letters - digits - space - common) / n if t else 0.0, ends / m,
        1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)), 1 - len(pairs) / max(1, m - 1), top_pair / m,
        counts[124] / m, counts[46] / m, packed / n,
    ]


def _packed(t: str) -> int:
    """Compressed size of a long text, in pieces, so that memory stays flat."""
    z, size = zlib.compressobj(1), 0
    for k in range(0, len(t), 1 << 16):
        size += len(z.compress(t[k : k + (1 << 16)].encode("utf-8", "surrogatepass")))
    return size + len(z.flush())


@dataclass
class Forest:
    """Trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, at]] > self.limit[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.value[trees, at - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees=80, depth=4, rate=0.15, bins=64, ridge=1.0, least=20) -> Forest:
    """Boost logistic loss. No rows: a forest that scores 0.5 everywhere; one class: that class's smoothed rate."""
    inner = 2**depth - 1
    n = len(x)
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if n < 2 * least:
        return Forest(depth, base, feature, limit, value)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x <= edge k: bin <= k
    offset = np.arange(d) * bins
    score = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = ((at - first)[:, None] * d * bins + offset + binned).ravel()
            size = width * d * bins
            hist = [np.bincount(cell, np.repeat(w, d), size).reshape(width, d, bins).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = hist, (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(nl < least) | (na - nl < least)] = -1
            for k in range(width):
                f, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], limit[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > limit[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[t][leaf]
    return Forest(depth, base, feature, limit, value)


def _features(docs: DataFrame) -> DataFrame:
    """(y, x) of documents with a label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("y", "text").mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE, **options) -> Forest:
    """Fit on at most ``sample`` labelled documents outside fold 0 of crc32(doc_id). An id with several labels has the lowest."""
    small_batches(docs.sparkSession, 256)
    use = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).where("label_id IS NOT NULL AND y IS NOT NULL")
    use = use.where(crc_fold("label_id", folds) != 0).groupBy("label_id").agg(F.min("y").alias("y"))
    use = use.orderBy(F.md5(F.col("label_id").cast("string"))).limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(use), F.col("doc_id") == F.col("label_id"))  # sample rows at most
    got = _features(rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    y = got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the rows' order doesn't matter
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, model: Forest, out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (null: as empty), 0 to 1, higher: rather quality 1.

    A column of that name is replaced. Repeated rows each have their score, equal
    texts equal ones; texts are read whole, however long; no rows: no rows.
    """
    small_batches(docs.sparkSession, 256)
    docs = docs.drop(out_col) if out_col in docs.columns and out_col != "text" else docs
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{out_col} double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)
