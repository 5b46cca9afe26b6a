"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the merges' result for a text exactly if every two
neighbours are what the merges make of their joint bytes. So the transducer's
states are sets of hypotheses (last token, place in the trie of token bytes);
reading a byte moves every hypothesis on, and where a token ends whose pair with
the last one is sound, that token becomes the last one there. States and moves
are made when first met and remembered. Tokens are emitted as soon as all live
hypotheses begin at one place, which is at most a token's length behind.

Decoding is a transducer too: its state is the bytes of an unfinished UTF-8
character, its moves (state, token) -> (state, text) are remembered.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, keep, small_batches

#: What is remembered at most; beyond it, it is forgotten and made anew: moves between states (some 250 bytes each,
#: states included), states after the first bytes of a piece (some 230 bytes each), bytes of pieces and their ids.
MOVES, HEADS, PIECES = 300_000, 150_000, 96 << 20
#: Patterns of which ``encode`` and ``chunk`` know that they cut at white space before a run, and cut words of ASCII
#: letters at no other place. Texts go through any other pattern as a whole.
SPACED = ("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+",)
#: A hypothesis is one number: the last token plus one above these bits, the place in the trie below.
NODE = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class ByteBpe:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.spaced = pattern in SPACED
        # A token that the merges never make can't end a hypothesis, only stand for a whole piece.
        self.trie: dict[int, int] = {}  # place << 8 | byte: next place
        self.trie_token, self.depth, self.inner = [-1], [0], bytearray(b"\1")
        self.parts: dict[int, tuple[int, int]] = {}  # of a token: the two that its last merge joined
        for b, i in ranks.items():
            two = self.merge(b, 2)
            if len(two) == 2:
                self.parts[i] = (two[0], two[1])
            if len(b) == 1 or len(two) == 2:
                at = 0
                for c in b:
                    to = self.trie.get(at << 8 | c)
                    if to is None:
                        to = self.trie[at << 8 | c] = len(self.depth)
                        self.inner[at] = 1
                        self.inner.append(0)
                        self.trie_token.append(-1)
                        self.depth.append(self.depth[at] + 1)
                    at = to
                self.trie_token[at] = i
        self.length = [0] * (max(self.bytes_of) + 2)  # of a token, by its number plus one
        for i, b in self.bytes_of.items():
            self.length[i + 1] = len(b)
        self.pieces = Recent(PIECES, self.chunk)
        self.forget()
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        # The moves from the state without unfinished bytes back to it; None: others.
        self.whole: list[str | None] = [None] * (max(self.bytes_of) + 1)
        for i, b in self.bytes_of.items():
            rest, text = utf8_move(b"", b)
            self.whole[i] = None if rest or "�" in text else text

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """The merges carried out literally, the lowest rank first, the leftmost of equals, until so many parts are left."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def sound(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b apart where b follows a.

        Undoes the merges of both, the latest first. At each time the two parts that
        meet at the boundary must not merge before either is merged inwards: a's
        part goes first at equal rank, being further left, b's part does not.
        """
        if a < 0:
            return True
        parts, bytes_of, rank = self.parts, self.bytes_of, self.ranks.get
        inner_a = inner_b = 1 << 60
        while True:
            r = rank(bytes_of[a] + bytes_of[b])
            if r is not None and r < inner_a and r <= inner_b:
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_b is not None and (of_a is None or b >= a):
                inner_b, b = b, of_b[0]
            elif of_a is not None:
                inner_a, a = a, of_a[1]
            else:
                return True

    # The encoder. A state is a tuple of hypotheses, the longest first.
    def forget(self) -> None:
        self.states = [(0,)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, int] = {}
        self.heads: dict[bytes, tuple[int, ...]] = {}  # where the first 8 bytes of a piece lead: the tail, then the state

    def move(self, state: int, byte: int) -> int:
        """next state << 40 | token that ends here, plus one (0: none) << 16 | bytes back to which all hypotheses agree, plus one (0: they don't)."""
        live, last = [], 0
        for h in self.states[state]:
            to = self.trie.get((h & NODE) << 8 | byte)
            if to is None:
                continue
            if self.inner[to]:
                live.append(h & ~NODE | to)
            token = self.trie_token[to]
            if not last and token >= 0 and self.sound((h >> 32) - 1, token):
                last = token + 1
        if not last and not live:
            raise ValueError("a byte is missing from the ranks")
        if last:
            live.append(last << 32)
        key = tuple(live)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        got = self.step[state << 8 | byte] = number << 40 | last << 16 | (self.depth[live[0] & NODE] + 1 if len(live) == 1 else 0)
        return got

    def transduce(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a stream of bytes, emitted after bounded lookahead."""
        state, tail = 0, []  # tail: the token that ends after each byte since the last emission, plus one
        for byte in data:
            got = self.step.get(state << 8 | byte) or self.move(state, byte)
            state, back = got >> 40, (got & 0xFFFF) - 1
            tail.append(got >> 16 & 0xFFFFFF)
            if back >= 0 and len(tail) > back + 64:
                yield from self._walk(tail[: len(tail) - back])
                del tail[: len(tail) - back]
                if len(self.step) > MOVES:
                    live = self.states[state]
                    self.forget()
                    state = self.number[live] = len(self.states)
                    self.states.append(live)
        yield from self._walk(tail)

    def _walk(self, tail: list[int]) -> list[int]:
        out, at, length = [], len(tail), self.length
        while at:
            token = tail[at - 1]
            out.append(token - 1)
            at -= length[token]
        return out[::-1]

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern."""
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            out = [whole]
        elif len(data) > 256:
            out = list(self.transduce(data))
        else:
            if len(self.step) > MOVES or len(self.heads) > HEADS:
                self.forget()
            step, move = self.step.get, self.move
            head = self.heads.get(data[:8])
            if head is None:
                state, tail = 0, []
                for byte in data[:8]:
                    got = step(state << 8 | byte) or move(state, byte)
                    state = got >> 40
                    tail.append(got >> 16 & 0xFFFFFF)
                self.heads[data[:8]] = (*tail, state)
            else:
                tail = list(head)
                state = tail.pop()
            for byte in data[8:]:
                got = step(state << 8 | byte) or move(state, byte)
                state = got >> 40
                tail.append(got >> 16 & 0xFFFFFF)
            out = self._walk(tail)
        return struct.pack(f"<{len(out)}I", *out)

    def chunk(self, text: str) -> bytes:
        """The ids of a run without white space at its end, with its leading space."""
        if text.isascii() and text[:1] == " " and len(text) > 2:  # plain words, as the pattern would cut them
            body = text[1:]
            if body.isalpha():
                return self.piece(text)
            if body[:-1].isalpha() and body[-1] in ".,;:!?":
                return self.pieces[text[:-1]] + self.pieces[text[-1]]
        cut = self.split(text)
        return self.piece(text) if len(cut) == 1 else b"".join(map(self.pieces.__getitem__, cut))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids. Null is empty.

        Where single spaces stand between runs without white space at their ends, a
        match of the pattern never passes such a run's end, so each run with its
        leading space is looked up as a whole.
        """
        if not text:
            return b""
        known, out, k = self.pieces, [], 0
        if not self.spaced:
            return b"".join(map(self.piece, self.split(text)))
        parts = text.split(" ")
        if "" not in parts and " ".join(map(str.strip, parts)) == text:
            return known[parts[0]] + b"".join([known[" " + p] for p in parts[1:]])
        while k < len(parts):
            p, j = parts[k], k + 1
            while j < len(parts) and (not p or p[-1].isspace() or not parts[j] or parts[j][0].isspace()):
                p += " " + parts[j]  # white space of several characters: left to the pattern
                j += 1
            p = " " + p if k else p
            out.append(known[p])
            k = j
        return b"".join(out)

    # The decoder.
    def decode_move(self, state: bytes, token: int) -> tuple[bytes, str]:
        if len(self.moves) > HEADS:
            self.moves.clear()
        got = self.moves[state, token] = utf8_move(state, self.bytes_of[token])
        return got

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as it is complete; bytes that are no UTF-8 become U+FFFD."""
        state = b""
        for i in ids:
            state, text = self.moves.get((state, i)) or self.decode_move(state, i)
            yield text
        if state:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        """The text of all ids: tokens of whole characters by a table, the others by the state machine."""
        out = list(map(self.whole.__getitem__, ids))
        k, left = -1, out.count(None)
        while left > 0:
            k = out.index(None, k + 1)
            state = b""
            while k < len(ids):
                left -= out[k] is None
                state, out[k] = self.moves.get((state, ids[k])) or self.decode_move(state, ids[k])
                if not state:
                    break
                k += 1
            if state:
                out.append("�")
        return "".join(out)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def utf8_move(state: bytes, more: bytes) -> tuple[bytes, str]:
    """Feed bytes to the UTF-8 state machine: (unfinished bytes, finished text).

    The state, the bytes of an unfinished character, fixes how many bytes must
    follow and, after E0, ED, F0 and F4, the narrower range of the first of them.
    """
    out, held = [], state
    for c in more:
        byte = bytes([c])
        if held:
            lead = held[0]
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
            if low <= c <= high:
                held += byte
                if len(held) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    out.append(held.decode())
                    held = b""
                continue
            out.append("�")
            held = b""
        if c < 0x80:
            out.append(chr(c))
        elif 0xC2 <= c <= 0xF4:
            held = byte
        else:
            out.append("�")
    return held, "".join(out)


def coder(path: str, pattern: str) -> ByteBpe:
    return keep(("bbpe", path, pattern), lambda: ByteBpe(load_ranks(path), pattern))


def encode_column(docs: DataFrame, vocabulary: str, pattern: str, text_col="text", out_col="ids") -> DataFrame:
    """``docs`` with the ids of its whole texts in ``out_col`` (null text: no ids); a column of that name is replaced.

    Repeated rows each have their ids; texts are encoded whole, however long, in memory in proportion to them; no rows: no rows.
    """
    small_batches(docs.sparkSession, 256)
    docs = docs.drop(out_col) if out_col in docs.columns and out_col != text_col else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, pattern)
        for b in batches:
            raw = [c.encode(t) for t in b.column(text_col).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, _with(docs, f"{out_col} array<int>"))


def decode_column(rows: DataFrame, vocabulary: str, pattern: str, ids_col="ids", out_col="decoded") -> DataFrame:
    """``rows`` with the text that the ids of ``ids_col`` stand for (null: empty); a column of that name is replaced. No rows: no rows."""
    rows = rows.drop(out_col) if out_col in rows.columns and out_col != ids_col else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, pattern)
        for b in batches:
            text = [c.decode(x or []) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, _with(rows, f"{out_col} string"))


def _with(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; what is decoded comes from the ids."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, pattern)
        for b in batches:
            raw = [c.encode(t) for t in b.column("text").to_pylist()]
            back = [c.decode(np.frombuffer(x, "<u4").tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
