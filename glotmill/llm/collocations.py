"""Phrase collocations: merged count-min sketches choose what is counted exactly, then phrases are scored and subsumed.

1. Every chunk of texts hashes its n-grams (language, 1 to ``longest`` words) to cells of a sketch of ``DEPTH`` rows and
   sends the cells it touched, cut into slices. A slice's counts are added up in one stream, and only one bit a cell
   goes on: whether ``least`` is reached. Counts of a sketch are never too low, so no frequent phrase is lost.
2. A second pass counts the n-grams whose cells and parts all pass, exactly and by their text. What the sketch let
   through in vain falls out there. Tasks take several partitions each and add up the counts of their chunks before
   they send them, as most phrases that pass are rare and would leave once for nearly every occurrence.
3. Scores and subsumption are joins of the frequent phrases.

A chunk is ``CHUNK`` bytes of text (one text at least) and a task holds at most ``HELD`` counts besides those of a
chunk, so memory does not grow with the table. Words are told apart by
Arrow's dictionary within a chunk and by their text between chunks; hashes only address cells. With far more distinct
n-grams than cells the sketch prunes little: results stay the same, and the second pass counts more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage

#: Cells of a sketch row (a power of two), rows, slices of a row, bytes of text in a chunk.
CELLS, DEPTH, SLICES, CHUNK = 1 << 27, 2, 512, 4 << 20
#: Partitions that a task of the second pass takes, counts that it holds to add up.
TOGETHER, HELD = 4, 2_000_000

#: What a byte is to the splitter: part of a word, a gap between words, an end of a piece.
WORD, GAP, END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = GAP
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """The words of some texts of one language: the distinct ones, an index for each occurrence, and its piece."""

    def __init__(self, lang: str, texts: pa.Array):
        self.lang = lang
        raw = pa.concat_arrays([texts.cast(pa.large_binary())])
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        text = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
        kind = _CLASS[text]
        fresh = np.zeros(len(text) + 1, bool)  # a text begins here
        fresh[offsets - offsets[0]] = True
        inside = kind == WORD
        before = np.concatenate([[False], inside[:-1]])[: len(text)]
        starts = np.flatnonzero(inside & (~before | fresh[:-1]))
        sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.piece = np.cumsum((kind == END) | fresh[:-1], dtype=np.int32)[starts]
        letters = _LOWER[text[inside]]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self) -> tuple[np.uint64, np.ndarray]:
        """The hash that a phrase of no words has, and one for each distinct word."""
        empty = _mixed(pd.util.hash_array(np.array([self.lang], dtype=object), categorize=False))[0]
        return empty, pd.util.hash_array(np.array(self.words.to_pylist() or [""], dtype=object), categorize=False)

    def adjacent(self, n: int) -> np.ndarray:
        """Whether the n words from each position on lie in one piece."""
        return self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]


def _extended(phrase, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    with np.errstate(over="ignore"):
        return _mixed(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    """Batches of (lang, text) without nulls as chunks of one language."""
    for b in batches:
        coded = b.column(0).dictionary_encode()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            texts = b.column(1).filter(pc.equal(coded.indices, i))
            filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                until = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + size, "right")))
                yield Chunk(lang, texts.slice(at, until - at))
                pa.default_memory_pool().release_unused()  # else Arrow keeps what the chunks before have used
                at = until


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (h >> np.uint64(32 * row)) & np.uint64(cells - 1)


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted places and their counts (to 255) in few bytes: gaps by byte planes, then counts."""
    gaps = np.diff(at.astype(np.uint32), prepend=np.uint32(0))
    planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + n.astype(np.uint8).tobytes()
    return len(at).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    flat = np.frombuffer(pa.decompress(data[4:], 5 * n, "zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(flat[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.int64), flat[4 * n :]


def _sketched(longest: int, cells: int, slices: int, size: int):
    """Per chunk, sketch row and slice: the cells touched and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, size):
            phrase, word = c.hashes()
            every, word = [], word[c.ids]
            for n in range(1, longest + 1):
                m = len(c.ids) - n + 1
                if m <= 0:
                    break
                phrase = _extended(phrase[:m] if n > 1 else phrase, word[n - 1 :])
                every.append(phrase[c.adjacent(n)])
            if not every:
                continue
            h, keys, data = np.concatenate(every), [], []
            del c, phrase, word, every
            for row in range(DEPTH):
                at = np.sort(_cells(h, row, cells))
                new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                n, at = np.minimum(np.diff(np.append(new, len(at))), 255), at[new].astype(np.int64)
                bounds = np.searchsorted(at, np.arange(slices + 1) * (cells // slices))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    lo, hi = bounds[s], bounds[s + 1]
                    keys.append(row * slices + s)
                    data.append(_packed(at[lo:hi] - s * (cells // slices), n[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["slice", "cells"])

    return run


def _merged(least: int, width: int):
    """Adds up sorted slices in a stream; of each the cells that reach ``least``, one bit a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                if key != now:
                    if now is not None:
                        yield done()
                    now, total = key, np.zeros(width, np.int64)
                at, n = _unpacked(data.as_py())
                total[at] += n
        if now is not None:
            yield done()

    return run


def _passing(sketch: np.ndarray, h: np.ndarray, cells: int) -> np.ndarray:
    """Whether all cells of each hash are marked."""
    ok = np.ones(len(h), bool)
    for row in range(DEPTH):
        at = _cells(h, row, cells).astype(np.int64)
        ok &= (sketch[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def _counted(longest: int, cells: int, size: int, sketch):
    """Per chunk and size n: exact counts of n-grams that pass the sketch with all their parts, and of all words (size 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
        marked = np.frombuffer(sketch.value, np.uint8).reshape(DEPTH, -1)
        for c in _chunks(batches, size):
            empty, word = c.hashes()
            v = len(c.words)
            yield c.lang, 0, pa.array([b""], pa.large_binary()), np.array([len(c.ids)], np.int64)
            # at[i]: number of the passing phrase of n words that begins at position i, or -1; h, parts: of these phrases
            keys, at = np.arange(1), np.zeros(len(c.ids) + 1, np.int64)
            h, parts = np.array([empty]), None
            for n in range(1, longest + 1):
                m = len(c.ids) - n + 1
                if m <= 0:
                    break
                here = np.flatnonzero((at[:m] >= 0) & (at[1 : m + 1] >= 0) & c.adjacent(n))
                keys, inverse, times = np.unique(at[here] * v + c.ids[here + n - 1], return_inverse=True, return_counts=True)
                before, last = keys // max(v, 1), keys % max(v, 1)
                h = _extended(h[before], word[last])
                passing = _passing(marked, h, cells)
                h, before, last, times = h[passing], before[passing], last[passing], times[passing]
                number = np.where(passing, np.cumsum(passing) - 1, -1)
                at = np.full(m + 1, -1, np.int64)
                at[here] = number[inverse]
                tail = c.words.take(pa.array(last))
                parts = tail if n == 1 else pc.binary_join_element_wise(parts.take(pa.array(before)), tail, pa.scalar(b" ", pa.large_binary()))
                yield c.lang, n, parts, times

    return run


def _added_up(counts: Iterator[tuple[str, int, pa.Array, np.ndarray]], held: int) -> Iterator[pa.RecordBatch]:
    """Counts of equal phrases of a task added up, as far as ``held`` of them reach, as rows."""
    kept: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray]]] = {}

    def add(key: tuple[str, int]) -> int:
        """Adds up what is kept of one language and size; the number of phrases."""
        if len(kept[key]) > 1:
            coded = pa.chunked_array([p for p, _ in kept[key]]).dictionary_encode()
            f = np.zeros(len(coded.chunk(0).dictionary), np.int64)
            for c, (_, times) in zip(coded.chunks, kept[key], strict=True):
                np.add.at(f, c.indices.to_numpy(zero_copy_only=False), times)
            kept[key] = [(coded.chunk(0).dictionary, f)]
        return len(kept[key][0][1])

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, n in list(kept):
            add((lang, n))
            [(phrases, f)] = kept.pop((lang, n))
            for i in range(0, len(f), 20_000):
                text = phrases.slice(i, 20_000).cast(pa.large_string()).cast(pa.string())
                fixed = [pa.array([lang]), pa.array([n], pa.int32())]
                fixed = [x.take(pa.array(np.zeros(len(text), np.int64))) for x in fixed]
                yield pa.RecordBatch.from_arrays([*fixed, text, pa.array(f[i : i + 20_000])], names=["lang", "words", "phrase", "f"])

    for lang, n, phrases, f in counts:
        if not len(phrases):
            continue
        of = kept.setdefault((lang, n), [])
        of.append((phrases, f))
        if sum(len(x) for _, x in of[1:]) >= len(of[0][1]):  # so a count is added up few times
            add((lang, n))
        if sum(len(x) for o in kept.values() for _, x in o) >= held and sum(map(add, list(kept))) >= held / 2:
            yield from sent()
    yield from sent()


def _fewer(df: DataFrame, together: int) -> DataFrame:
    """``df`` with ``together`` partitions in one or more (fewer than twice as many), but no fewer than tasks run at once, and as many in each wave."""
    at_once = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(at_once * max(1, df.rdd.getNumPartitions() // (together * at_once)))


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS, slices: int = SLICES, chunk: int = CHUNK, held: int = HELD) -> DataFrame:
    """lang, words, phrase, f: phrases of up to ``longest`` words with at least ``least`` occurrences in a language.

    A row with ``words`` 0 holds the number of all words of a language. Texts are lower-cased (A-Z), cut into pieces at
    ``.,;:!?`` and line ends and into words at blanks and tabs; occurrences may overlap. Null texts are empty, a null
    language is ``und``, repeated rows count each time, and an empty table or one without words gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slices = min(slices, cells // 8)
    width = cells // slices
    touched = rows.mapInArrow(_sketched(longest, cells, slices, chunk), "slice int, cells binary")
    marks = touched.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged(least, width), "slice int, bits binary")
    sketch = bytearray(DEPTH * cells // 8)
    for r in marks.collect():  # DEPTH x cells bits in all, whatever the input
        sketch[r["slice"] * (width // 8) : (r["slice"] + 1) * (width // 8)] = r["bits"]
    known = spark.sparkContext.broadcast(bytes(sketch))
    counted = _counted(longest, cells, chunk, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added_up(counted(batches), held)

    counts = _fewer(rows, TOGETHER).mapInArrow(run, "lang string, words int, phrase string, f long")
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0) & (F.col("f") > 0))


def _exact(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, best: int = 2000, inside: int = 50, text_col: str = "text", lang_col: str = "lang", **sketch) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``longest`` words of every language.

    A phrase with a occurrences is cut after each of its words into parts with l and r occurrences; its score is the
    lowest floor(1000000 a a / (l r)), at the earliest cut that gives it. Phrases inside a longer frequent one that has
    at least ``inside`` percent of their occurrences go. Order: score, then a, descending, then the phrase's bytes.
    Decimals keep the products exact up to 10^15 occurrences. Edge cases: see ``frequent_phrases``.
    """
    found = cut_lineage(frequent_phrases(docs, longest, least, text_col, lang_col, **sketch))
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = found.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, at, n: F.array_join(F.slice(a, at, n), " ")
    known = found.where(F.col("words").between(1, longest - 1)).select("lang", "phrase", "f")
    cuts = phrases.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("w", F.lit(1), F.col("k")).alias("first"), part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("over", _exact(F.col("a")) * _exact(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", _exact(F.col("l")) * _exact(F.col("r")))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").cast("long").alias("score"), "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: part(F.col("w"), at, n))))
    longer = phrases.where("words > 2").select("lang", F.explode(starts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= best)
    return ranked.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
