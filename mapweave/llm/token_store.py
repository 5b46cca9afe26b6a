"""Token ids as Parquet: sorted, delta and dictionary encoded, with page indexes.

A row is a document: its id, its part, where it starts within the part, its
length, and its ids. Ids are dictionary encoded (16 bits an id or less at these
vocabularies), the sorted numbers beside them delta encoded; small pages with
the writer's column and offset indexes let a reader fetch the columns and pages
of a few documents, and metadata alone without any ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shared_dir, small_batches

STORE = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Row groups, pages, encodings. Ids use the dictionary; the numbers beside them deltas (Parquet's second version).
WRITE = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "compression": "zstd",
}
#: Bytes of words and their ids that a worker remembers, and characters that are cut into words at once.
CACHE, GROUP = 128 << 20, 2 << 20
#: ASCII white space, signs, letters and digits, Latin letters that no normal form changes, and common dashes and quotes.
PLAIN = re.compile("[\t\n\r -~\u00c0-\u012f\u0132-\u017f\u2010-\u2027]*").fullmatch
#: The tokenizer's own split, for plain text in lower case.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]|[^\\sa-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f0-9]+").findall
#: Stands between words that go to the library together; no plain text holds it.
MARK = "\x01"
SPACE = re.compile(r"[ \t\n\r]").search
#: Of the characters of plain text in lower case: 0 white space, 1 letter, 2 digit, 3 other; and a random factor for the hash of a word.
KIND = np.full(0x2028, 3, np.uint8)
for _low, _high, _kind in ((9, 14, 0), (32, 33, 0), (48, 58, 2), (97, 123, 1), (0xC0, 0xD7, 1), (0xD8, 0xF7, 1), (0xF8, 0x180, 1)):
    KIND[_low:_high] = _kind
FACTOR = np.random.default_rng(5).integers(1, 1 << 63, len(KIND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR[KIND == 0] = 0
STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of plain text in lower case: where its words start, the distinct ones, and which of them each is.

    The same words as SPLIT finds: letters, single digits, other signs; an
    apostrophe alone takes s, t, m, d, re, ve or ll behind it along. Words are
    told apart by a hash and then compared character by character.
    """
    codes = np.frombuffer(text.encode("utf-16-le"), "<u2")
    n = len(codes)
    kind = np.zeros(n + 3, np.uint8)  # one before, two behind
    np.take(KIND, codes, out=kind[1 : n + 1])
    word = kind[1 : n + 1] != 0
    start = kind[1 : n + 1] != kind[:n]
    start |= kind[1 : n + 1] == 2
    start &= word
    at = np.flatnonzero(codes == 39)
    at = at[start[at] & (kind[at + 2] == 1)]
    if len(at):
        one = codes[at + 1]
        two = np.where(kind[at + 3] == 1, codes[np.minimum(at + 2, n - 1)], 0)
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        hit = long | np.isin(one, [115, 116, 109, 100])
        at, end = at[hit], (at + 2 + long)[hit]
        start[at + 1] = False
        start[end[kind[end + 1] == 1]] = True
    starts = np.flatnonzero(start).astype(np.int32)
    if not len(starts):
        return starts, [], starts
    inside = np.flatnonzero(word).astype(np.int32)
    # Characters inside words, one word after the other: where each word's begin among them, and each one's place.
    begin = np.flatnonzero(start[inside]).astype(np.int32)
    size = np.diff(begin, append=np.int32(len(inside)))
    place = np.arange(len(inside), dtype=np.int32) - np.repeat(begin, size)
    inner = codes[inside]
    power = np.cumprod(np.full(int(size.max()), STEP))
    hashes = np.add.reduceat(FACTOR[inner] * power[place], begin)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = np.zeros(1, bool)
    if (size == size[first][which]).all():
        same = inner[np.repeat(begin[first][which], size) + place] == inner
    ends = starts + size
    if not same.all():  # two words with one hash
        found = [text[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = {w: k for k, w in enumerate(dict.fromkeys(found))}
        return starts, list(number), np.array([number[w] for w in found])
    return starts, [text[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], which


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    The tokenizer lowers case and splits at white space, letters, digits and signs
    before it merges, so a text's ids are those of its words in turn. Plain text is
    lowered and cut into words here, many texts at a time; in other texts, by the
    tokenizer's own pattern,
    so are the plain pieces between U+0020 and U+000A, and the other pieces go to
    the library whole. It merges new words many at a time, with marks between them,
    without its normaliser. Texts that hold an added token's string, in any case,
    go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merger.encode_special_tokens = True
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE).search
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = np.frombuffer(self._ids(self.merger, [MARK])[0], "<u4")
        if len(self.mark) != 1:
            raise ValueError("the mark is not a token of its own in this vocabulary")
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, tok, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if PLAIN(text):
            return SPLIT(text.lower())
        return [w for p in text.replace("\n", " ").split(" ") for w in (SPLIT(p.lower()) if PLAIN(p) else (p,))]

    def _learn(self, new: list[str]) -> None:
        plain = sorted(filter(PLAIN, new))
        for k in range(0, len(plain), 5000):
            part = plain[k : k + 5000]
            raw = self._ids(self.merger, [f" {MARK} ".join(part)])[0]
            cut = (np.nonzero(np.frombuffer(raw, "<u4") == self.mark)[0] * 4).tolist()
            self.words.update(zip(part, [raw[x + 4 : y] for x, y in zip([-4, *cut], [*cut, len(raw)], strict=True)], strict=True))
        if len(plain) < len(new):
            others = list(set(new).difference(plain))
            self.words.update(zip(others, self._ids(self.tok, others), strict=True))

    def _ids_of(self, distinct: list[str]) -> list[bytes]:
        """The ids of distinct words, looked up or learned."""
        words, old = self.words, self.old
        got = list(map(words.get, distinct))
        new = [w for w, g in zip(distinct, got, strict=True) if g is None]
        if new:
            known = list(filter(old.__contains__, new))
            words.update(zip(known, map(old.__getitem__, known), strict=True))
            self._learn(list(set(new).difference(known)) if known else new)
            self.held += sum(map(len, new)) + 230 * len(new)  # a word, its ids and a slot of the table
            got = list(map(words.__getitem__, distinct))
        if self.held > CACHE // 2:
            self.words, self.old, self.held = {"": b""}, words, 0
        return got

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Plain texts in lower case, cut into words together."""
        starts, distinct, which = split_words("\n".join(texts))
        ids = self._ids_of(distinct)
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = np.cumsum(size) - size, size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = flat[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        edges = upto[np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))] * 4
        return [flat[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, group, held = [[] for _ in texts], [], 0
        whole = [k for k, t in enumerate(texts) if t and self.added(t)]

        def flush():
            nonlocal group, held
            if group:
                for (k, _), ids in zip(group, self._plain([t for _, t in group]), strict=True):
                    out[k].append(ids)
            group, held = [], 0

        for k, t in enumerate(texts):
            if not t or k in whole:
                continue
            if not PLAIN(t):
                out[k] = self._ids_of(self._cut(t))
                continue
            t, at = t.lower(), 0
            while at < len(t):  # a long text in pieces that end at white space
                m = SPACE(t, at + GROUP) if len(t) - at > GROUP else None
                end = m.end() if m else len(t)
                group.append((k, t[at:end]))
                held, at = held + end - at, end
                if held >= GROUP:
                    flush()
        flush()
        for k, ids in zip(whole, self._ids(self.tok, [texts[k] for k in whole]) if whole else (), strict=True):
            out[k] = [ids]
        return [b"".join(x) for x in out]


def encoder(path: str) -> PieceEncoder:
    return keep(("token_store", path), lambda: PieceEncoder(path))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None) -> None:
    """Encode every whole text (null: empty) of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order.

    Texts of one doc_id stand in the order of a hash of theirs; null ids come first.
    Ranges are drawn over (doc_id, hash), so rows that share an id can be split.
    """
    small_batches(docs.sparkSession, 512)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            raw = [x + tail for x in enc.encode(b.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in raw], np.int64)
            edges = np.concatenate([[0], np.cumsum(n)])
            ids = np.frombuffer(b"".join(raw), "<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + edges[:-1]), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
            at += int(edges[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h").mapInArrow(run, STORE).write.options(**WRITE).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_tokens: bool = True) -> DataFrame:
    """The documents with their place in the whole sequence (start). Without tokens, no id is read.

    The offsets of the parts are a row for each file that was written.
    """
    store = spark.read.schema(STORE).parquet(path)
    sums = sorted((r["part"], r["n"]) for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    if not with_tokens:
        store = store.drop("tokens")
    out = store.join(F.broadcast(offsets), "part")
    return out.withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start", "local_start", "part")


def token_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the store, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("tokens")
            edges, ids = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
