"""One-pass dictionaries against replacements made one after the other."""

import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from glotmill.functions import rewriting as R
from glotmill.functions import text as X


def folded(text, pairs):
    return reduce(lambda s, kv: s.replace(*kv) if kv[0] else s, pairs, text)


def whole_words(spark, texts, pairs):
    """The fold of one pattern a word, by Java's own word boundaries."""
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    fold = reduce(lambda c, kv: F.regexp_replace(c, rf"(?U)\b\Q{kv[0]}\E\b", kv[1].replace("\\", "\\\\").replace("$", r"\$")), pairs, F.col("t"))
    r = df.select("id", fold.alias("a"), R.replace_words(F.col("t"), pairs).alias("b")).orderBy("id").collect()
    return [x.a for x in r], [x.b for x in r]


@pytest.mark.parametrize("seed", range(6))
def test_literals_of_few_letters(spark, seed):
    """Keys that overlap, hold each other and are put in by others; some hold blanks or put in no blanks."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("ab:)(") for _ in range(rng.randrange(1, n)))
    keys = list(dict.fromkeys(some(5) for _ in range(14)))
    if seed % 2:
        keys.sort(key=len, reverse=True)
    pairs = [(k, f" {some(4)} ") for k in keys]
    if seed > 3:
        pairs[3], pairs[6] = (pairs[3][0], "x"), ("a b", " y ")
    texts = ["".join(rng.choice("ab:)( ") for _ in range(rng.randrange(30))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", R.replace_literals(F.col("t"), pairs).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [folded(t, pairs) for t in texts]


def test_four_hundred_literals(spark):
    rng = random.Random(1)
    marks = [chr(0x1F300 + i) for i in range(340)] + [a + b + c for a in ":;=" for b in ("-", "") for c in "()DPpoO|/*3"]
    pairs = [(k, f" word{i} face ") for i, k in enumerate(sorted(marks, key=len, reverse=True))]
    assert len(pairs) >= 400 and len(R.literal_passes(pairs)) == 1
    texts = ["".join(rng.choice([*marks, "xin", " ", "$1", "\\", "é", "\n"]) for _ in range(40)) for _ in range(200)] + ["", "plain " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("id", R.replace_literals(F.col("t"), pairs).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [folded(t, pairs) for t in texts]
    assert X.replace_literals(F.col("t"), {k: v.strip() for k, v in pairs}) is not None


def test_passes():
    assert R.literal_passes([("ab", " x "), ("cd", " y ")]) == [{"ab": " x ", "cd": " y "}]
    assert R.literal_passes([("ab", " x "), ("bc", " y ")]) == [{"ab": " x "}, {"bc": " y "}]
    assert R.literal_passes([("ab", " cd "), ("cd", " y ")]) == [{"ab": " cd "}, {"cd": " y "}]
    assert R.literal_passes([("a", " x "), ("xab", " y ")]) == [{"a": " x "}]
    assert R.literal_passes([("", " x ")]) == []


@pytest.mark.parametrize("seed", range(4))
def test_cascades(spark, seed):
    rng = random.Random(seed)
    words = ["ko", "dc", "a", "b", "c", "được", "không", "é", "_", "x1", "Ⅷ", "ª", "½"]
    keys = list(dict.fromkeys(rng.choice(words) for _ in range(12)))
    pairs = [(k, rng.choice(["", " ", "$0 \\", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(4)], "a-b", "b's"])) for k in keys]
    if seed % 2:
        pairs.insert(4, ("a b", "c"))
        pairs.insert(2, ("b-c", "a"))
    texts = ["".join(rng.choice([*words, " ", " ", "-", ".", "\n", "A"]) for _ in range(rng.randrange(25))) for _ in range(300)]
    fold, one = whole_words(spark, texts, pairs)
    assert one == fold


def test_four_hundred_words(spark):
    """A chain in which every word becomes the next one's key, and pairs that lead back to earlier keys."""
    pairs = [(f"w{i}", f"w{i + 1} v{i}") for i in range(398)] + [("v3", "w0"), ("w398", "end")]
    texts = ["w0 w1, w397!", "v3 v4 w398", "W0", "w39 w5-w6 " * 300]
    fold = [reduce(lambda s, kv: re.sub(rf"\b{kv[0]}\b", kv[1], s), pairs, t) for t in texts]
    # one nested pattern a word is more than Spark can plan; the composed map is one pass
    one = [r.r for r in spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", R.replace_words(F.col("t"), pairs).alias("r")).orderBy("id").collect()]
    assert one == fold and one[1] == "w0 v4 end" and one[0].startswith("end v397")
