"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(adds) those of its trigrams, a language's prototype those of its texts. A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, keep, small_batches

#: Texts that a language's prototype is bundled from at most: those with the smallest md5 of the id.
SAMPLE = 8_000
DIM = 1024
_classes = np.zeros(0x110000, np.uint32)  # letter to lower case, 0: no letter, 1: not yet known
_classes[:] = 1


def _letter(code: int) -> np.ndarray:
    letters = keep("langid", dict)
    got = letters.get(code)
    if got is None:
        if len(letters) > 20_000:
            letters.clear()
        got = letters[code] = np.random.default_rng([11, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return got


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct letter trigrams of a whole text, and how often each occurs.

    Letters are in lower case; between words stands one space. Three 21-bit code points make a code.
    """
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    cls = _classes[raw]
    if (cls == 1).any():
        for c in np.unique(raw[cls == 1]):
            ch = chr(c)
            _classes[c] = ord(ch.lower()[0]) if ch.isalpha() else 0
        cls = _classes[raw]
    cls = np.concatenate([[0], cls, [0]]).astype(np.int64)
    cls = cls[(cls > 0) | np.concatenate([[True], cls[:-1] > 0])]
    if len(cls) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls[cls == 0] = 32
    return np.unique(cls[:-2] << 42 | cls[1:-1] << 21 | cls[2:], return_counts=True)


def bundle(texts: list[str | None]) -> np.ndarray:
    """The vectors of some texts, a row each; zero where there is no letter."""
    grams = [trigrams(t) for t in texts]
    out = np.zeros((len(texts), DIM), np.float32)
    if not sum(len(g) for g, _ in grams):
        return out
    codes, where = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
    counts = np.concatenate([c for _, c in grams]).astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), [len(g) for g, _ in grams])
    order = np.argsort(where, kind="stable")
    where, counts, doc = where[order], counts[order], doc[order]
    parts = [(codes >> 42) & 0x1FFFFF, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]
    known = np.unique(np.concatenate(parts))
    base = np.stack([_letter(int(c)) for c in known])
    turned = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
    for lo in range(0, len(codes), 4096):
        hi = min(lo + 4096, len(codes))
        bound = turned[0][np.searchsorted(known, parts[0][lo:hi])]
        for k in (1, 2):
            bound = bound * turned[k][np.searchsorted(known, parts[k][lo:hi])]
        x, y = np.searchsorted(where, [lo, hi])
        m = np.zeros((len(texts), hi - lo), np.float32)
        m[doc[x:y], where[x:y] - lo] = counts[x:y]
        out += m @ bound.astype(np.float32)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros(m.shape), where=n > 0)


def train(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Language to unit prototype, from at most ``sample`` ids of each language outside fold ``held``; whole texts are bundled with equal weight."""
    small_batches(docs.sparkSession, 128)
    use = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(crc_fold("doc_id", folds) != held)
    ids = use.select(F.col("doc_id").alias("id"), F.col("lang").alias("of")).distinct()
    ids = ids.withColumn("k", F.expr("row_number() OVER (PARTITION BY of ORDER BY md5(CAST(id AS STRING)), id)")).where(F.col("k") <= sample).drop("k")
    rows = use.select("doc_id", "lang", "text").join(ids, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            unit, langs = _unit(bundle(b.column("text").to_pylist())), b.column("lang").to_pylist()
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + unit[[x == lang for x in langs]].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    sums: dict[str, np.ndarray] = {}
    for r in sorted(rows.select("lang", "text").repartition(16).mapInArrow(run, "lang string, v array<double>").collect()):
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.array(r["v"])
    sums = {k: v for k, v in sums.items() if v.any()}
    if not sums:
        return {}
    names, protos = sorted(sums), _unit(np.stack([sums[k] for k in sorted(sums)]))
    return dict(zip(names, protos, strict=True))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], none: str = "und") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``none`` with score 0 where there is no letter or no prototype. Ties: first by name. Repeated rows each have theirs; no rows: no rows."""
    small_batches(docs.sparkSession, 128)
    names = sorted(prototypes)
    protos = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = bundle(b.column("text").to_pylist())
            lang, score = [none] * len(vec), np.zeros(len(vec))
            if names and len(vec):
                cos = _unit(vec) @ protos.T
                best, some = cos.argmax(axis=1), vec.any(axis=1)
                lang = [names[k] if s else none for k, s in zip(best, some, strict=True)]
                score = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
