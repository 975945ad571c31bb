"""Token counts without token ids: pieces per distinct pre-token, joined to per-document frequencies.

1. Tasks count pre-tokens over all their texts; the shuffle gets one row per task and distinct pre-token.
2. The tokeniser counts the pieces of every distinct pre-token once.
3. Each document's pre-token frequencies are joined to those counts and summed. The commonest pre-tokens, at most
   ``BROADCAST`` of them whatever the input, go to the tasks as a table and are summed on the spot; the others, which
   are rare, leave as (row, pre-token, frequency) and are joined by a shuffle. No hot key is left for that shuffle, and
   it carries a few rows of each document instead of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage
from glotmill.llm.pretokens import Memo, chunks, compiled

BROADCAST = 150_000
FLUSH, MEMO = 400_000, 500_000


def _tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def _segments(text: str, specials: tuple[str, ...]) -> tuple[list[str], int]:
    """The text between added special tokens, which the library recognises inside texts, and their number."""
    parts, n = [text], 0
    for s in specials:
        cut = [p.split(s) for p in parts]
        n += sum(len(c) - 1 for c in cut)
        parts = [x for c in cut for x in c]
    return parts, n


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def pretoken_frequencies(docs: DataFrame, pattern: str, specials: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(token, n): how often each distinct pre-token stands in all texts."""
    out = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = compiled(pattern)

        def tokens(counts: Counter) -> Iterator[tuple[str, int]]:
            total: Counter = Counter()
            for chunk, n in counts.items():
                for t in split.findall(chunk):
                    total[t] += n
            return iter(total.items())

        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    for s in _segments(text, specials)[0]:
                        counts.update(chunks(s, split))
            if len(counts) >= FLUSH:
                yield from _batches(tokens(counts), out)
                counts = Counter()
        yield from _batches(tokens(counts), out)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def count_pieces(vocabulary: DataFrame, definition: str) -> DataFrame:
    """Adds ``pieces``, the number of tokens that the library makes of each pre-token."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(sent.value)
        for b in batches:
            found = t.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in found], pa.int64())], names=["token", "n", "pieces"])

    return vocabulary.mapInArrow(run, "token string, n long, pieces long")


def commonest(vocabulary: DataFrame, most: int = BROADCAST) -> dict[str, int]:
    """Pieces of the pre-tokens above the lowest frequency that at most ``most`` of them reach."""
    steps = [2**k for k in range(0, 62)]
    reach = vocabulary.agg(*[F.count_if(F.col("n") >= s).alias(f"c{i}") for i, s in enumerate(steps)]).first()
    least = next((s for i, s in enumerate(steps) if reach[i] <= most), None)
    rows = vocabulary.where(F.col("n") >= (least or 0)).select("token", "pieces").toArrow()
    return dict(zip(rows.column("token").to_pylist(), rows.column("pieces").to_pylist()))


def token_counts(docs: DataFrame, definition: str, pattern: str, specials: tuple[str, ...] = (), limit: int = 512, most: int = BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``definition`` is the text of a byte-level BPE tokeniser file and ``pattern`` its pre-token pattern; ``specials``
    are its added tokens, each of which counts as one token wherever it stands. Null and empty texts have 0 bytes and
    tokens, null ids and repeated rows keep their rows, an empty table gives an empty result.
    """
    vocabulary = cut_lineage(count_pieces(pretoken_frequencies(docs, pattern, specials, text_col), definition))
    sent = docs.sparkSession.sparkContext.broadcast(commonest(vocabulary, most))
    item = pa.struct([("token", pa.string()), ("n", pa.int64())])
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rare", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = compiled(pattern), sent.value

        def split_known(chunk: str) -> tuple[int, tuple[str, ...]]:
            found = split.findall(chunk)
            return sum(pieces.get(t, 0) for t in found), tuple(t for t in found if t not in pieces)

        memo = Memo(split_known, MEMO)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes, known, rare = [], [], []
            for text in texts:
                parts, total = _segments(text or "", specials)
                odd: Counter = Counter()
                for p in parts:
                    for n, others in map(memo.__getitem__, chunks(p, split)):
                        total += n
                        if others:
                            odd.update(others)
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                known.append(total)
                rare.append([{"token": t, "n": n} for t, n in odd.items()])
            rows = range(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(rare, pa.list_(item))], schema=out)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(narrow.mapInArrow(run, "row long, doc_id long, n_bytes long, known long, rare array<struct<token:string,n:long>>"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    summed = rare.join(vocabulary, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    n = F.col("known") + F.coalesce("others", F.lit(0))
    return rows.join(summed, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
