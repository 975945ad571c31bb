"""Packing documents into training sequences by minimum bin slack.

A document's whole windows are sequences of their own; what remains (1 to capacity - 1 tokens) is packed. A window
starts with the longest remainder left, and a subset sum over the multiset of the other lengths, kept as a bitset (one
integer, bit s for a reachable sum s), finds the sum closest to the free space; backtracking gives how often each
length is used. With many lengths nearly every window fills to the last token.

Each task packs what it tokenises, in shards of at most ``SHARD`` remainders, so no text is shuffled, memory is bounded
and a lost executor's tasks give the same sequences again. Only the last window or two of a shard have padding; the
pieces of those of all shards (a few for each task, as numbers) are dealt again and packed once more.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Collection, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage_observed
from glotmill.llm.pretokens import Memo

CAPACITY, END_ID, SHARD = 2048, 1, 50_000
#: Windows with more padding than this share of the capacity are packed again; sequences of that second time have this bit.
SLACK, SECOND = 1 / 64, 1 << 62
#: Words kept with their ids, and as many from before; texts and characters that are split at once (one text at least).
MEMO, STEP, LETTERS = 250_000, 1000, 4 << 20
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: A comma or full stop after anything but a letter or digit; it starts with the mark, which the search skips to.
ODD = re.compile("[,.](?<![0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff][,.])")
#: Pre-tokens of lower-case ASCII words, as in the tokeniser's file.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Added tokens stand between these marks; the library looks for them before it lower-cases.
SPECIAL = "<|"

#: Latin-1 by its bytes: lower case, white space, comma and full stop, and what may stand before these.
_LATIN = bytes(range(256)).decode("latin-1")
_LOWER = _LATIN.lower().encode("latin-1")
_SPACE, _MARK = np.array([c.isspace() for c in _LATIN]), np.array([c in ",." for c in _LATIN])
_BEFORE = np.array([not ODD.search(f"{c},") for c in _LATIN])


def fill(counts: dict[int, int], order: list[int], space: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to ``space`` from below; ``order`` has the lengths, ascending."""
    reach, mask, steps = 1, (1 << (space + 1)) - 1, []
    for i in range(bisect_right(order, space) - 1, -1, -1):
        length = order[i]
        left, times = counts[length], 1
        while left and length * times <= space:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, times = left - take, times * 2
        if reach >> space & 1:
            break
    best, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] += take
            best -= length * take
    return used


def windows(lengths: dict[int, int], capacity: int = CAPACITY) -> Iterator[list[int]]:
    """Lengths of each window; ``lengths`` maps a length to its number."""
    left, order = dict(lengths), sorted(lengths)

    def drop(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            order.pop(bisect_left(order, length))

    while order:
        longest = order[-1]
        drop(longest, 1)
        used = fill(left, order, capacity - longest)
        for length, n in used.items():
            drop(length, n)
        yield [longest] + [length for length, n in sorted(used.items(), reverse=True) for _ in range(n)]


def piece_count(word: str) -> int:
    """How many pre-tokens the library makes of ``word`` where that is certain, else 0.

    Certain are lower-case words of Latin-1 letters alone (normal form and lower case leave them as they are, and letters
    are one pre-token) and lower-case ASCII words.
    """
    if word.isalpha() and word.isascii() and word.islower():
        return 1
    if word != word.lower() or SPECIAL in word:
        return 0
    if word.isascii():
        return 1 if word.isalpha() else len(PIECES.findall(word))
    return int(max(word) <= "\xff" and word.isalpha())


class WordTokens:
    """Ids of texts by a tokeniser that drops white space and never joins what it separates, a word at a time.

    Distinct words are kept with their ids; when the table is full, what is looked up again comes over to the next. New
    ones go to the library many at a time. Words whose number of pre-tokens is certain are joined by spaces and come back as one run of ids: each pre-token ends with an entry that has the
    end-of-word mark, so that number tells where a word's ids end. All other words are entries of their own.
    """

    def __init__(self, definition: str, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(definition)
        # lower-case Latin-1 letters are in normal form and one pre-token, so these steps are left out for them
        self.letters = Tokenizer(self.tokenizer.model)  # one model in memory
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(word_end)]] = True
        self.words, self.former = Memo(self.whole, MEMO), {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def prepare(self, words: Collection[str]) -> None:
        fresh = [w for w in words if w not in self.words]
        if len(self.words) + len(fresh) > self.words.bound:
            self.former = dict(self.words)
            self.words.clear()
            fresh = words
        known = {w: self.former[w] for w in fresh if w in self.former}
        self.words.update(known)
        fresh = [w for w in fresh if w not in known]
        new = [(w, piece_count(w)) for w in fresh if len(w) <= self.words.longest]
        others = [w for w, n in new if not n]
        letters = [x for x in new if x[1] == 1 and x[0].isalpha()]
        self.joined(letters, self.letters)
        self.joined([x for x in new if x[1] > 1 or x[1] and not x[0].isalpha()], self.tokenizer)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.words[w] = pack(f"<{len(e.ids)}I", *e.ids)

    def joined(self, certain: list[tuple[str, int]], tokenizer) -> None:
        """Keeps the ids of words whose number of pre-tokens is certain, 500 of them a text."""
        parts = [certain[i : i + 500] for i in range(0, len(certain), 500)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([" ".join([w for w, _ in p]) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            last = np.cumsum([n for _, n in part])
            run, at = ids.tobytes(), 0
            for (w, _), stop in zip(part, stops[last - 1].tolist()):
                self.words[w] = run[at:stop]
                at = stop

    @staticmethod
    def split(text: str) -> list[str] | None:
        """Words of a text; None if it has separators that Python's split knows and the library does not.

        Latin-1 texts are lower-cased here (beyond it, lower case and normal form may depend on each other), and commas
        and full stops after a letter or digit become words of their own, with what follows them. Texts that may hold
        added tokens are only split: lower case would turn other spellings into them.
        """
        if any(c in text for c in ODD_SPACE):
            return None
        if SPECIAL in text:
            return text.split()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        text = text.lower()
        if ODD.search(text):
            return text.split()
        return text.replace(",", " ,").replace(".", " .").split()

    @staticmethod
    def latin(text: str) -> bytes | None:
        """A text in Latin-1, a byte a character; None if it has others, separators of the odd kind or the marks of added tokens."""
        if SPECIAL in text or any(c in text for c in ODD_SPACE):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def encode_latin(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts in Latin-1, split as ``split`` does, but all at once; None where a mark stands after an odd character.

        Each distinct word is looked up once, then Arrow puts the ids of all words in their order.
        """
        text = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        inside, mark = ~_SPACE[text], _MARK[text]
        before = np.roll(text, 1)  # the last byte is a line feed, so the first has one before it
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(first, np.flatnonzero(mark & ~_BEFORE[before]), "right") - 1] = True
        begins = inside & (_SPACE[before] | mark)
        bounds = np.searchsorted(np.flatnonzero(begins), first)  # number of a text's first word
        ends = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text[inside])])
        coded = words.dictionary_encode()
        at = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        data = coded.dictionary.buffers()[2]
        spelled = str(data if data is not None else b"", "latin-1")
        distinct = [spelled[i:j] for i, j in zip(at, at[1:])]
        self.prepare(distinct)
        ids = pa.array(map(self.words.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        data, at = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(data if data is not None else b"")
        return [None if o else bytes(data[i:j]) for o, i, j in zip(odd.tolist(), at, at[1:])]

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        filled, i = np.cumsum([len(t) for t in texts]), 0
        while i < len(texts):
            until = int(np.searchsorted(filled, (filled[i - 1] if i else 0) + LETTERS, "right"))
            part = texts[i : min(max(i + 1, until), i + STEP)]
            i += len(part)
            latin = [self.latin(t) for t in part]
            known = iter(self.encode_latin([t for t in latin if t is not None]))
            ids = [None if t is None else next(known) for t in latin]
            split = [self.split(t) if d is None else None for t, d in zip(part, ids)]
            self.prepare(set().union(*[w for w in split if w]))
            for text, done, found in zip(part, ids, split):
                if done is None:
                    done = self.whole(text) if found is None else b"".join(map(self.words.__getitem__, found))
                yield done


_TOKENS: dict[str, WordTokens] = {}


def pack_documents(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``definition`` is the text of the tokeniser's file. A document's ids end with ``end_id``, so null and empty texts
    are one token. Null ids and repeated rows are packed like others; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loose")])
    schema = ", ".join(f"{f.name} long" for f in out)
    full = capacity * 4

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(out))], schema=out)

    def packed(rest: list[tuple], sequence: int) -> Iterator[list]:
        """Pieces with their place, and 1 where the window has much padding."""
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for piece in rest:
            by_length[piece[2]].append(piece)
        for k, lengths in enumerate(windows({n: len(p) for n, p in by_length.items()}, capacity)):
            offset, loose = 0, int(sum(lengths) < capacity * (1 - SLACK))
            for n in lengths:
                yield [*by_length[n].pop(), sequence + k, offset, loose]
                offset += n

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rest = SECOND | TaskContext.get().partitionId() << 32, []
        for b in batches:
            rest += zip(*[b.column(c).to_pylist() for c in out.names[:5]])
        yield table(list(packed(sorted(rest, key=str), sequence)))

    def encoded(b: pa.RecordBatch, tokens: WordTokens) -> Iterator[tuple[int | None, bytes]]:
        """Ids of documents and of their tokens; only so many texts are Python strings at once as a step takes."""
        for at in range(0, len(b), STEP):
            part = b.slice(at, STEP)
            yield from zip(part.column(0).to_pylist(), tokens.encode_batch([t or "" for t in part.column(1).to_pylist()]))
            pa.default_memory_pool().release_unused()  # else Arrow keeps what the steps and batches have used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.sha256(sent.value.encode()).hexdigest()
        if name not in _TOKENS:
            _TOKENS[name] = WordTokens(sent.value)
        tokens, end = _TOKENS[name], pack("<I", end_id)
        sequence, rest = TaskContext.get().partitionId() << 32, []

        for b in batches:
            rows = []
            for doc, ids in encoded(b, tokens):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), full):
                    part = ids[at : at + full]
                    piece = (doc, at // 4, len(part) // 4, zlib.crc32(part), total)
                    if len(part) == full:
                        rows.append([*piece, sequence, 0, 0])
                        sequence += 1
                    else:
                        rest.append(piece)
            if len(rest) >= SHARD:
                done = list(packed(rest, sequence))
                sequence, rest = done[-1][5] + 1, []
                rows += done
            yield table(rows)
        yield table(list(packed(rest, sequence)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first, seen = cut_lineage_observed(texts.mapInArrow(run, schema), F.sum("loose").alias("loose"))
    # the number of tasks follows the number of pieces, so that each has many lengths to choose from
    loose = first.where("loose = 1").repartition(math.ceil((seen["loose"] or 1) / SHARD)).mapInArrow(again, schema)
    return first.where("loose = 0").unionByName(loose).drop("loose")
