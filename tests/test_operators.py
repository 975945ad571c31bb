import pytest
from pyspark.sql import functions as F

from glotmill.operators import detect_v2, metrics, resampling, stats, subsets
from glotmill.sources import readers, writers
from glotmill.streaming import annotate


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("1", [1, 0, 0], [1, 0, 0]), ("2", [1, 1, 0], [0, 1, 1]), ("3", [0, 1, 0], [1, 1, 0]), ("4", [0, 0, 0], [0, 0, 0])]
    return spark.createDataFrame([(*r, "a") for r in rows], "id string, y_true array<tinyint>, y_pred array<tinyint>, subset string")


def test_metrics(scored):
    m = metrics.subset_metrics(scored, ["subset"], least=1).first()
    got = [m.micro_precision, m.micro_recall, m.micro_f1, m.macro_precision, m.macro_recall, m.macro_f1, m.weighted_f1, m.hamming_loss, m.subset_accuracy, m.avg_pred_per_sample]
    assert [round(x, 4) for x in got] == [0.6, 0.75, 0.6667, 0.5, 0.5, 0.5, 0.75, 0.25, 0.5, 1.25]
    assert m.label_accuracy == pytest.approx(1 - m.hamming_loss)
    assert metrics.errors(scored).count() == 2


def test_threshold(spark):
    df = spark.createDataFrame([("1", [1], [0.3]), ("2", [0], [0.2]), ("3", [1], [0.9])], "id string, y_true array<int>, y_prob array<double>")
    assert metrics.tune_threshold(df).first().threshold == pytest.approx(0.22)
    none = df.withColumn("y_true", F.array(F.lit(0)))
    assert metrics.tune_threshold(none).first().threshold == 0.5


def test_resampling(scored, spark):
    many = scored.select("y_true", "y_pred", "subset", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"), "id").withColumn("id", F.concat_ws("-", "id", "k"))
    a = resampling.bootstrap_ci(many, replicates=100).first()
    assert a.n == 80 and a.lo <= 0.5 <= a.hi
    assert resampling.bootstrap_ci(many.repartition(7), replicates=100).first() == a
    assert resampling.bootstrap_ci(scored, replicates=10).first().lo is None
    both = many.withColumn("subset", F.when(F.col("k") <= 10, "a").otherwise("b"))
    r = resampling.permutation_test(both, [("a", "b"), ("a", "c")], permutations=50).collect()
    assert len(r) == 1 and r[0].diff == 0 and r[0].p_value == 1.0


def test_wilcoxon():
    r = resampling.wilcoxon([1, 2, 3, 4, 5])
    assert r["p_value"] == 2 / 32 and r["statistic"] == 0
    assert resampling.wilcoxon([0.0, 0.0])["n"] == 2


def test_kappa(spark):
    from glotmill.operators.detect_v3 import agreement

    df = spark.createDataFrame([(bool(int(a)), bool(int(b))) for a, b in zip("11000100", "10001100")], "a boolean, b boolean")
    r = agreement(df, "a", "b").first()
    assert (r.agreement, round(r.kappa, 6)) == (0.75, 0.466667)


def test_registry(spark):
    df = spark.createDataFrame([(1, "pure_vi", False), (2, "english_mixed", True)], "id int, cs_group string, is_cs_strict boolean")
    reg = subsets.Registry()
    reg.register("odd", lambda d: F.col("id") % 2 == 1)
    for spec, n in (("odd", 1), ("cs_strict", 1), ("id > 1", 1), (lambda d: F.lit(None), 0), ("control_pure_vi", 0), ("is_cs_strict", 1)):
        assert df.where(reg.mask(df, spec)).count() == n


def test_history(spark):
    h = spark.createDataFrame([("m", e, s) for e, s in enumerate([0.1, 0.3, 0.3, 0.2, 0.9])], "model string, epoch int, macro_f1 double")
    assert metrics.best_epoch(h).first().epoch == 4
    assert [r.epoch for r in metrics.early_stop(h).orderBy("epoch").collect()] == [0, 1, 2, 3]


def test_tags(spark):
    names = spark.createDataFrame([("r/s1-XLM-R",), ("r/XLM-R_s1",), ("r/other",)], "path string")
    assert sorted(r.tag for r in readers.discover_models(names).collect()) == ["s0", "xlmr-s1", "xlmr-s1-2"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\"", "[1]", "Validation"), ("c", "[2]", "train"), (None, "[2]", "test")], "Comment string, Label string, Set string")
    for kind, write in (("csv", writers.write_csv), ("jsonl", writers.write_jsonl)):
        write(df, f"{tmp_path}/x.{kind}")
        got = readers.with_ids(readers.standardise(readers.read_table(spark, f"{tmp_path}/x.{kind}")))
        assert sorted((r.text, r.labels, r.split) for r in got.collect()) == [("a\n\"b\"", "[1]", "val"), ("c", "[2]", "train")]
        assert sorted(r.id for r in got.collect()) == ["0", "1"]
    with pytest.raises(ValueError):
        readers.require_splits(got)
    with pytest.raises(ValueError):
        readers.standardise(spark.range(1))


def test_directory(spark, tmp_path):
    for name in ("train", "dev_set"):
        spark.createDataFrame([(f"t {name}",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/d/{name}.parquet")
        (tmp_path / "d" / f"{name}.parquet").rename(tmp_path / "d" / f"{name}_dir")
        for p in (tmp_path / "d" / f"{name}_dir").glob("*.parquet"):
            p.rename(p.with_name(f"{name}.parquet"))
    assert sorted((r.text, r.split) for r in readers.read_directory(spark, f"{tmp_path}/d").collect()) == [("t dev_set", "val"), ("t train", "train")]


def test_export(spark, sf, tmp_path):
    from glotmill.plans.reference import labelled

    df = labelled(spark, sf)
    index = writers.export_tiers(df, str(tmp_path / "e"))
    n = {(r.subset, r.split): r.n for r in index.collect()}
    back = spark.read.parquet(f"{tmp_path}/e/tiers").groupBy("subset", "split").count().collect()
    assert n == {(r.subset, r.split): r["count"] for r in back}
    assert stats.crosstab(df, "split", "cs_level").where("split = 'All'").first()["All"] == df.count()


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "good clip"), ("2", "vui")], "id string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string").parquet(f"{tmp_path}/in")
    q = annotate.append_stream(annotate.annotated_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert {r.id: r.cs_group for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"1": "english_mixed", "2": "pure_vi"}


def control_by_hand(rows, seed=42):
    """The matched control of (id, split, label, strict, pure) rows, sorted whole."""
    import hashlib
    from collections import Counter

    place = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
    out = set()
    for split in {r[1] for r in rows}:
        cs, pure = [r for r in rows if r[1] == split and r[3]], sorted((r for r in rows if r[1] == split and r[4]), key=place)
        target = min(len(cs), len(pure))
        if not target:
            continue
        taken = set()
        for label, n in Counter(r[2] for r in cs).items():
            taken |= {r[0] for r in [r for r in pure if r[2] == label][: round(n / len(cs) * target)]}
        taken |= {r[0] for r in [r for r in pure if r[0] not in taken][: max(0, target - len(taken))]}
        out |= taken
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_matched_control(spark, parts):
    """Selection by counts of hash prefixes gives the rows that sorting gives, for any number of partitions."""
    import random

    rng = random.Random(parts)
    rows = []
    for i in range(1500):
        strict = rng.random() < 0.3
        rows.append((i, rng.choice(["train"] * 6 + ["val", "test"]), rng.choice([-1, 0, 0, 1, 2 if strict else 0]), strict, not strict and rng.random() < 0.7))
    rows += [(9000, "only_pure", 0, False, True), (9001, "only_cs", 0, True, False)]
    df = spark.createDataFrame(rows, "id long, split string, primary_label int, is_cs_strict boolean, pure boolean").withColumn("cs_group", F.when(F.col("pure"), "pure_vi").otherwise("x"))
    got = {r.id for r in subsets.matched_control(df.repartition(parts)).where("control_pure_vi").collect()}
    assert got == control_by_hand(rows) and len(got) > 300
    assert subsets.matched_control(df.where("false")).count() == 0


def test_first_in_order_repeats(spark):
    """Rows with one hash are ordered by id; numbers beyond the rows take all, zero takes none."""
    rows = spark.createDataFrame([("a", i, "00ff") for i in range(20)] + [("b", 1, "abcd"), ("c", 2, "abcd")], "k string, __id int, h string")
    wanted = spark.createDataFrame([("a", 7), ("b", 5), ("c", 0)], "k string, n int")
    got = {(r.k, r["__id"]) for r in subsets.first_in_order(rows, ["k"], wanted, "n").where("taken").collect()}
    assert got == {("a", i) for i in range(7)} | {("b", 1)}


def test_v2_computes_spellings_once_and_skips_texts_without_marks(spark):
    from functools import reduce

    from glotmill.functions import tokens as T

    texts = ["plain words", "a<b>c", "x http://y z", "WWW.q r", "ſww.a", "@me a@b", "#tag a#b", "<", "://", "a < b > c", "", "5٠ ٠ × a'b -"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    every = reduce(lambda c, p: F.regexp_replace(c, p, " "), (T.TAG, r"(?i)https?://\S+|www\.\S+", T.MENTION, T.HASHTAG), F.col("text"))
    assert df.where(~T.cleaned(F.col("text")).eqNullSafe(every)).count() == 0
    words = T.tokens(F.coalesce("text", F.lit("")))
    assert df.where(T.word_tokens(words) != F.filter(words, lambda t: t.rlike(f"[{T.LETTERS}]"))).count() == 0
    # the pattern of runs is tried once a word
    assert detect_v2.annotate(df)._jdf.queryExecution().optimizedPlan().toString().count(r"(.)\1\1") == 1
