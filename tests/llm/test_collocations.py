"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from glotmill.llm import collocations as C

SMALL = {"cells": 1 << 12, "slices": 16, "chunk": 4000}


def by_hand(rows, longest=3, least=10, best=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:best]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "CAT", "ça", "É", "sat", "on", "a b", "日本", "x" * 30, "w1", "w2"]
    glue = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", ";"]
    return [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("longest,parts", [(2, 1), (3, 5), (4, 3)])
def test_equals_a_plain_count(spark, longest, parts):
    rows = texts(longest) + [("same words here again. " * 40, "en"), (None, "en"), ("", None), ("...", "de"), ("Only", "es")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    got = C.collocations(df, longest=longest, **SMALL)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, longest)


def test_a_full_sketch_loses_nothing(spark):
    """Every cell of eight is marked: all phrases are counted exactly."""
    rows = texts(9, 60)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, C.collocations(df, least=3, cells=8, slices=1, chunk=500).collect())) == by_hand(rows, least=3)


def test_long_text_repeats_and_names(spark):
    long = "lorem ipsum dolor " * 20_000
    df = spark.createDataFrame([(1, long, None, "x"), (1, long, None, "x"), (2, None, "en", "y")], "words int, text string, lang string, phrase string")
    got = {r.phrase: r for r in C.collocations(df, **SMALL).collect()}
    assert got["lorem ipsum dolor"].a == 40_000 and got["lorem ipsum dolor"].n == 120_000 and "lorem ipsum" not in got
    assert {r.lang for r in got.values()} == {"und"}


def test_best_and_empty(spark):
    df = spark.createDataFrame(texts(3), "text string, lang string")
    assert sorted(map(tuple, C.collocations(df, best=2, **SMALL).collect())) == by_hand(texts(3), best=2)
    assert C.collocations(df.where("false"), **SMALL).count() == 0


def test_packed_places():
    import numpy as np

    at, n = np.array([0, 5, 70_000, 262_143]), np.array([1, 255, 7, 1])
    back = C._unpacked(C._packed(at, n))
    assert back[0].tolist() == at.tolist() and back[1].tolist() == n.tolist()


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_a_task_adds_up_its_chunks(held):
    """Counts of equal phrases leave a task once if it can hold them; whatever it holds, the sums are the same."""
    import numpy as np
    import pyarrow as pa

    rng, total, counts = random.Random(held), Counter(), []
    for _ in range(40):
        lang, rows = rng.choice(["en", "fr"]), {f"w{rng.randrange(60)}": rng.randrange(1, 9) for _ in range(30)}
        total.update({(lang, 1, w): f for w, f in rows.items()})
        counts.append((lang, 1, pa.array([w.encode() for w in rows], pa.large_binary()), np.array(list(rows.values()), np.int64)))
    got, sent = Counter(), [r for b in C._added_up(iter(counts), held) for r in b.to_pylist()]
    for r in sent:
        got[r["lang"], r["words"], r["phrase"]] += r["f"]
    assert got == total and len(sent) <= sum(len(f) for *_, f in counts) and (held < 10**6 or len(sent) == len(total))
    assert list(C._added_up(iter([]), held)) == []


def test_rows_of_the_second_pass_follow_the_phrases(spark, monkeypatch):
    """Ten chunks a partition and many partitions: a phrase leaves each task once, not each chunk."""
    rows, sent = texts(5, 800), spark.sparkContext.accumulator(0)
    added = C._added_up

    def told(counts, held):
        for b in added(counts, held):
            sent.add(b.num_rows)
            yield b

    monkeypatch.setattr(C, "_added_up", told)
    at_once = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame(rows, "text string, lang string").repartition(8 * at_once)
    found = C.frequent_phrases(df, **(SMALL | {"chunk": 200}))
    n = found.count()
    assert n <= sent.value <= 2.2 * at_once * n


def test_a_chunk_takes_little_memory():
    """Arrays of NumPy and Arrow for 12 MB of text, in both passes; nothing of Arrow's stays behind."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[(i * j) % 3000] for j in range(1, 251)) for i in range(9000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    sketch = SimpleNamespace(value=b"\xff" * (C.DEPTH * (1 << 20) // 8))
    for run in (C._sketched(3, 1 << 20, 16, C.CHUNK), C._counted(3, 1 << 20, C.CHUNK, sketch)):
        tracemalloc.start()
        assert len([None for _ in run(iter([batch]))]) > 0
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 160 << 20
