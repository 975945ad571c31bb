"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

Bytes are read as Latin-1 characters, so that pyahocorasick finds, in one pass over a pre-token, the longest vocabulary
entry from each of its positions. Going left to right, the longest entry is taken if it can stand next to the one
before it: a pair of entries is compatible if BPE, given their joined bytes, ends with exactly these two. If not, its
next shorter prefix is tried, and where none is left the step before is undone and its position marked as dead. A
sequence in which all neighbours are compatible is the one that the merges yield, so ids equal those of the library.

Compatibility is memoised per pair and pre-tokens per chunk; both tables are bounded and only save time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.pretokens import Memo, chunks, compiled

MEMO_CHUNKS, MEMO_PAIRS = 800_000, 300_000


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file by rank (a base64 string and a number a line). The file's size is that of a vocabulary."""
    with open(path, "rb") as f:
        rows = sorted((int(n), base64.b64decode(entry)) for entry, n in map(bytes.split, f))
    if [n for n, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [entry for _, entry in rows]


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries = entries
        self.sizes = list(map(len, entries))
        self.rank = {e: i for i, e in enumerate(entries)}
        self.pattern = compiled(pattern)
        self.automaton = ahocorasick.Automaton()
        for i, e in enumerate(entries):
            self.automaton.add_word(e.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((r for n in range(len(e) - 1, 0, -1) if (r := self.rank.get(e[:n])) is not None), -1) for e in entries]
        #: (left, right) -> the entry that merging them makes; and for each entry the two that it is made of
        self.made: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(entries)
        for i, e in enumerate(entries):  # by rank, so that only earlier merges are known
            for n in range(1, len(e)):
                left, right = self.rank.get(e[:n], i), self.rank.get(e[n:], i)
                if left < i and right < i and self._compatible(left, right):
                    self.made[left, right] = i
                    self.halves[i] = (left, right)
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = Memo(self._chunk, MEMO_CHUNKS)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two entries.

        Undoes merges beside the border, the latest first. A crossing merge happened if its rank is below that of the
        merge just undone; or equal to it if that one lies to the right, since equal ranks merge from the left.
        """
        limit = len(self.entries)
        while True:
            crossing = self.made.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            a, b = self.halves[left], self.halves[right]
            if a and (left > right or not b):
                limit, left = left, a[1]
            elif b:
                limit, right = right + 1, b[0]
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n, sizes, pairs = len(data), self.sizes, self.pairs
        longest = [0] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end - sizes[i] + 1] = i  # ends rise, so the last one from a start is the longest
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, entry = 0, longest[0]
        while at < n:
            end = at + sizes[entry]
            if alive[end]:
                if not out:
                    fits = True
                else:
                    pair = (out[-1], entry)
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= MEMO_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._compatible(*pair)
                if fits:
                    out.append(entry)
                    at = end
                    if at < n:
                        entry = longest[at]
                    continue
            if self.shorter[entry] >= 0:
                entry = self.shorter[entry]
            else:
                alive[at] = 0
                entry = out.pop()
                at -= sizes[entry]
        return out

    def _chunk(self, text: str) -> bytes:
        ids = [i for token in self.pattern.findall(text) for i in self.piece(token.encode("utf-8", "replace"))]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, chunks(text, self.pattern)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(entries: list[bytes], pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    name = (hashlib.sha256(b"\n".join(entries)).hexdigest(), pattern)
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(entries, pattern)
    return _CODECS[name]


def encode_documents(docs: DataFrame, entries: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, as in ``Codec.encode``).

    Null texts are empty and have no ids; null ids and repeated rows keep their rows. Nothing is shuffled: the
    vocabulary is broadcast (its size does not depend on the data), and a task holds one batch of texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def round_trip_digests(docs: DataFrame, entries: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (the ids decoded again) of each row, without passing ids on."""
    sent = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
