"""Near-duplicate documents: a MinHash LSH forest over word shingles, then exact verification.

1. A pass over the texts gives each document the hash of its words and its labels:
   in each tree a sequence of min-hashes, as long as the longest prefix (``max_depth``).
   Documents with the same words become one class.
2. The forest is the classes' labels, sorted by tree and label, so that a tree's trie
   lies in order: classes below one node are neighbours. Comparing neighbours gives
   the longest prefix that each class shares with any other; those that share less
   than the shortest prefix ever used are alone in that tree and go.
3. Matched prefixes start at full length and are shortened until the expected recall
   of pairs at or above the threshold reaches the target. The expectation comes from
   the data: the pairs that meet at full length, each with the similarity that all
   its min-hashes tell, weighted by the inverse of its chance to meet there. Where
   nothing meets, and in any case at last, stands the length at which even pairs
   right at the threshold are found with the target probability.
4. Classes below one node at that length are candidates; groups of candidates are
   found as components over a star for each node.
5. The texts of classes with candidates are read again, sorted by group and packed
   into blocks of shingle sets. Blocks that share a node form tiles. A tile counts
   the common shingles of its candidate pairs exactly and returns link counts and
   a spanning forest, so a group of thousands of near copies never becomes pairs.

Words are runs of letters, digits and underscores in lower case; a text of one to
four words is one shingle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, keep, materialise, small_batches
from .components import connected_components
from .groups import roots

SIG = "doc_id long, k1 long, k2 long, n int, labels binary"
TREES = "tree int, label binary, rep long"
BLOCK = "block long, reps array<long>, copies array<long>, sizes array<int>, hashes binary, prefixes binary"
LINKS = "a long, b long, add long"
WORDS = re.compile(r"\w+")
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-=+/"
hash_word = xxhash.xxh3_64_digest
#: Bytes of words and their hashes that a worker remembers.
CACHE = 48 << 20


def _hash_words(piece: str) -> bytes:
    """The 64-bit hashes of the words in a white-space-free piece of text."""
    low = piece.lower()
    bare = low if low.isalnum() else low.strip(PUNCTUATION)
    return hash_word(bare.encode()) if bare.isalnum() else b"".join(hash_word(w.encode()) for w in WORDS.findall(low))


def word_hashes(text: str | None) -> np.ndarray:
    words = keep("jaccard_join", lambda: Recent(CACHE, _hash_words))
    return np.frombuffer(b"".join(map(words.__getitem__, (text or "").split())), "<u8")


def shingles(w: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words, ascending."""
    if not len(w):
        return w
    width = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - width + 1, width, "<u8")
        for k in range(width):
            h = (h ^ w[k : len(w) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def found(similarity, depth: int, trees: int):
    """The probability that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, recall: float, max_depth: int) -> int:
    """The longest prefix at which pairs right at the threshold still meet with probability ``recall``."""
    for depth in range(max_depth, 0, -1):
        if found(threshold, depth, trees) >= recall:
            return depth
    raise ValueError("no prefix reaches this recall; plant more trees")


class Forest:
    """Labels of shingle sets: 16 bits of each min-hash. Permutations x -> a x + b mod 2**32 are drawn from a fixed seed."""

    def __init__(self, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def labels(self, s: np.ndarray) -> bytes:
        """Tree after tree, each min-hash as two bytes."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(0, len(x), 1024):
                np.minimum(low, (self.a[:, None] * x[k : k + 1024] + self.b[:, None]).min(axis=1), out=low)
        return low.astype("<u2").tobytes()

    def nodes(self, labels: bytes, depth: int) -> np.ndarray:
        """A hash of each tree's node at a depth."""
        label = np.frombuffer(labels, "<u2").reshape(self.trees, self.depth).astype(np.uint64)
        h = np.arange(1, self.trees + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(depth):
                h = (h ^ label[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        return h.view(np.int64)


def _signatures(docs: DataFrame, forest: Forest, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, n, labels = [], [], [], []
            for t in b.column("text").to_pylist():
                w = word_hashes(t)
                d = np.frombuffer(xxhash.xxh3_128_digest(w.tobytes()), "<i8")
                s = shingles(w, width)
                k1.append(d[0])
                k2.append(d[1])
                n.append(len(s))
                labels.append(forest.labels(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(labels, pa.binary())], names=["doc_id", "k1", "k2", "n", "labels"])

    return docs.mapInArrow(run, SIG)


def _tries(classes: DataFrame, forest: Forest, least: int) -> DataFrame:
    """(tree, label, rep), sorted, of the labels that share ``least`` min-hashes or more with a neighbour.

    Ranges are drawn over (tree, label, rep), so one with very many classes can be
    split. The first and the last node of each range stay whatever they share,
    because their neighbours may lie in another range.
    """
    size = 2 * forest.depth
    rows = classes.select("rep", "labels", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(labels, tree * {size} + 1, {size})").alias("label"), "rep")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labels(b):
            raw = np.frombuffer(b"".join(b.column("label").to_pylist()), "<u2").reshape(-1, forest.depth)[:, :least]
            return np.concatenate([np.asarray(b.column("tree"))[:, None], raw], axis=1)

        held, first, last, alike = None, None, None, False  # the row not yet decided on; whether it is like the one before it
        for b in batches:
            if not b.num_rows:
                continue
            x = labels(b)
            first = x[0] if first is None else first
            up = np.concatenate([[last is not None and bool((x[0] == last).all())], (x[1:] == x[:-1]).all(axis=1)])
            if held is not None and (alike or up[0] or (last == first).all()):
                yield held
            keep_it = (up | np.append(up[1:], False) | (x == first).all(axis=1))[:-1]
            if keep_it.any():
                yield b.slice(0, b.num_rows - 1).filter(pa.array(keep_it))
            held, last, alike = b.slice(b.num_rows - 1), x[-1], bool(up[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").mapInArrow(shared, TREES)


def _stars(tries: DataFrame, depth: int) -> DataFrame:
    """(node, rep, least): classes below a node at this depth, and the least of them; nodes of one class are left out."""
    nodes = tries.select(F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * depth})")).alias("node"), "rep")
    full = nodes.groupBy("node").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select(F.col("node").alias("node2"), "least")
    return nodes.join(full, F.col("node") == F.col("node2")).select("node", "rep", "least")


def expected_recall(classes: DataFrame, pairs: DataFrame, forest: Forest, threshold: float, depths: list[int]) -> dict[int, float]:
    """Of the pairs at or above the threshold, the share that each depth is expected to find.

    ``pairs`` (a, b) are classes that meet at full depth. A pair of similarity s,
    told by all min-hashes, stands for 1 / found(s, full depth) pairs like it.
    No such pair: no expectation.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(depths))
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("la", "lb"))
            s = (x == y).mean(axis=1)
            s = s[s >= threshold]
            weight = 1 / found(s, forest.depth, forest.trees)
            total += [weight.sum(), *((weight * found(s, d, forest.trees)).sum() for d in depths)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["w"])

    side = lambda k: classes.select(F.col("rep").alias(f"r{k}"), F.col("labels").alias(f"l{k}"))
    both = pairs.join(side("a"), F.col("a") == F.col("ra")).join(side("b"), F.col("b") == F.col("rb")).select("la", "lb")
    got = both.mapInArrow(weigh, "w array<double>").agg(*[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(1 + len(depths))]).first()
    return {d: got[k + 1] / got[0] for k, d in enumerate(depths)} if got[0] else {}


def _pack(rows: DataFrame, width: int, forest: Forest, depth: int, max_docs: int, max_shingles: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, last = TaskContext.get().partitionId(), 0, None
        reps, copies, sets, pre, total = [], [], [], [], 0

        def out():
            nonlocal count, reps, copies, sets, pre, total
            row = [[(part << 32) + count], [reps], [copies], [[len(s) for s in sets]], [np.concatenate(sets).tobytes()], [np.concatenate(pre).tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["block", "reps", "copies", "sizes", "hashes", "prefixes"])
            count, reps, copies, sets, pre, total = count + 1, [], [], [], [], 0
            return batch

        for b in batches:
            for rep, k1, k2, n, p, text in zip(*(b.column(c).to_pylist() for c in ("rep", "k1", "k2", "copies", "labels", "text")), strict=True):
                w = word_hashes(text)
                if (rep, k1, k2) == last or tuple(np.frombuffer(xxhash.xxh3_128_digest(w.tobytes()), "<i8")) != (k1, k2):
                    continue  # a repeated row, or another text under the same id
                last, s = (rep, k1, k2), shingles(w, width)
                if reps and (len(reps) >= max_docs or total + len(s) > max_shingles):
                    yield out()
                reps.append(rep)
                copies.append(n)
                sets.append(s)
                pre.append(forest.nodes(p, depth))
                total += len(s)
        if reps:
            yield out()

    return rows.mapInArrow(run, BLOCK)


def _unpack(x: dict, side: str, trees: int):
    sizes = np.array(x[f"sizes{side}"])
    return np.array(x[f"reps{side}"]), np.array(x[f"copies{side}"]), sizes, np.frombuffer(x[f"hashes{side}"], "<u8"), np.frombuffer(x[f"prefixes{side}"], "<i8").reshape(-1, trees)


def _verify(a, b, threshold: float) -> pa.RecordBatch:
    """Exact links among candidates of a tile; b None: within a."""
    same = b is None
    reps, copies, sizes, hashes, pre = a if same else tuple(np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
    n, na = len(reps), len(a[0])
    cand = np.zeros((na, n if same else n - na), bool)
    for t in range(pre.shape[1]):
        cand |= pre[:na, t][:, None] == pre[0 if same else na :, t]
    i, j = np.nonzero(np.triu(cand, 1) if same else cand)
    j = j if same else j + na
    if len(i):
        owner = np.repeat(np.arange(n), sizes)
        _, ids, times = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = times[ids] > 1  # only these can be common
        owner, ids = owner[shared], np.unique(ids[shared], return_inverse=True)[1]
        common = np.zeros((na, n if same else n - na), np.float32)
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
            x, y = np.searchsorted(ids, [lo, lo + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[owner[x:y], ids[x:y] - lo] = 1
            common += m[:na] @ m[0 if same else na :].T
        both = common[i, j if same else j - na].astype(np.int64)
        keep = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        i, j = i[keep], j[keep]
    add = np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
    root = roots(i, j, n)
    some, child = np.nonzero(add)[0], np.nonzero(root != np.arange(n))[0]
    first = np.arange(len(some) + len(child)) < len(some)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([reps[some], reps[child]]), pa.int64()),
        pa.array(np.concatenate([reps[some], reps[root[child]]]), pa.int64(), mask=first),
        pa.array(np.concatenate([add[some], add[child]]), pa.int64(), mask=~first)], names=["a", "b", "add"])


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold=0.8, width=5, trees=32, max_depth=9, recall=0.9999, max_docs=256, max_shingles=200_000) -> DataFrame:
    """(doc_id, component_id, n_links, class_id, copies, kept) for each row of ``docs``.

    ``class_id`` is the smallest id with the same words, ``copies`` their number,
    ``n_links`` the number of other documents linked directly, copies included,
    ``component_id`` the smallest id reachable. Texts without words (null, empty,
    punctuation) and rows with a null id link with nothing. Rows that repeat an id
    with the same words are copies; an id with several texts stands for them all.
    Every linked pair has a Jaccard similarity of ``threshold`` or more; of all such
    pairs, ``recall`` or more are expected to be found. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    forest, least = Forest(trees, max_depth), least_depth(threshold, trees, recall, max_depth)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialise(_signatures(rows, forest, width), "signatures")
    real = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels")), "classes")
    small_batches(spark, 8192)
    tries = materialise(_tries(classes, forest, least), "tries")
    small_batches(spark, 1024)
    met = _stars(tries, max_depth).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    share = expected_recall(classes, met, forest, threshold, list(range(max_depth, least, -1)))
    depth = next((d for d, x in share.items() if x >= recall), least)
    small_batches(spark, 256)
    members = materialise(_stars(tries, depth), "members")
    group = connected_components(members.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    active = classes.join(group, F.col("rep") == F.col("id")).select("rep", "k1", "k2", "copies", "labels", F.col("component").alias("grp"))
    texts = active.join(rows, F.col("rep") == F.col("doc_id")).drop("doc_id")
    blocks = materialise(_pack(texts.repartitionByRange("grp", "rep").sortWithinPartitions("grp", "rep", "k1", "k2"), width, forest, depth, max_docs, max_shingles), "blocks")
    place = blocks.select("block", F.explode("reps").alias("rep2"))
    held = members.join(place, F.col("rep") == F.col("rep2")).select("node", "block").distinct()
    tiles = held.toDF("node", "ti").join(held.toDF("node", "tj"), "node").where("ti < tj").select("ti", "tj").distinct()
    side = lambda s: blocks.select([F.col(c).alias(c + s) for c in blocks.columns])
    pairs = tiles.join(side("_a"), F.col("ti") == F.col("block_a")).join(side("_b"), F.col("tj") == F.col("block_b"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _verify(_unpack(b.slice(k, 1).to_pylist()[0], "", trees), None, threshold)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = b.slice(k, 1).to_pylist()[0]
                yield _verify(_unpack(x, "_a", trees), _unpack(x, "_b", trees), threshold)

    small_batches(spark, 16)
    links = materialise(blocks.mapInArrow(within, LINKS).union(pairs.drop("ti", "tj", "block_a", "block_b").mapInArrow(across, LINKS)), "links")
    small_batches(spark, 256)
    sums = links.where("add IS NOT NULL").groupBy("a").agg(F.sum("add").alias("linked"))
    comp = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    per = classes.select("k1", "k2", "rep", "copies").join(sums, F.col("rep") == F.col("a"), "left").drop("a").join(comp, F.col("rep") == F.col("id"), "left")
    per = materialise(per.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("rep").alias("class_id"), "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes-linked")
    keys = sig.select("doc_id", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), F.when(F.col("n") > 0, F.col("k2")).alias("k2"))
    out = keys.join(per, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & F.col("doc_id").isNotNull(), "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), cid.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, text_col="text", **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id. Rows with a null id stay.

    Where ids repeat, every row is numbered in order of its id and joined as a
    document of its own, so the texts that share an id are told apart. Of rows
    without words, those that repeat id and text are one.
    """
    some = docs.where("doc_id IS NOT NULL")
    if some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found, rows, key = near_duplicates(docs, text_col=text_col, **options), docs, "doc_id"
    else:
        order = some.withColumn("__hash", F.xxhash64(text_col)).repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash", text_col)
        rows, key = materialise(order.drop("__hash").withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
        found = near_duplicates(rows, id_col=key, text_col=text_col, **options)
    kept = materialise(found.where(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("__keep")), "kept")
    # What is kept grows with the documents: always a merge join, never a broadcast that goes away at scale.
    out = rows.join(kept.hint("merge"), rows[key] == F.col("__keep"), "left_semi")
    if key == "__row":
        out = out.drop(key).dropDuplicates(["doc_id", text_col])
    return out.unionByName(docs.where("doc_id IS NULL"))
