"""Annotation runs that die and go on, models on executors, lexicon files and lexicons of table size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glotmill.lexicon import DetectorConfig
from glotmill.operators import detect_v2, inference, metrics
from glotmill.operators.annotation_run import FILES, WAVES, annotate_in_waves, cached
from glotmill.sources.readers import read_lexicon, read_metrics


def backend(calls, dies_at=None, silent=()):
    """Notes every text that it is asked for in a file."""

    class Dies(BaseException):
        """Ends the task, unlike the errors that a backend may raise."""

    def answer(texts):
        with open(calls, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        if dies_at in texts:
            raise Dies
        if any(t in silent for t in texts):
            raise OSError("busy")
        return [{"has_cs": t.endswith("7"), "langs": ["en"], "tokens": [{"text": t, "type": "english", "gloss": ""}], "confidence": 0.5} for t in texts]

    return answer


def asked(calls):
    lines = calls.read_text().split()
    calls.write_text("")
    return lines


def test_a_run_goes_on_where_it_died(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(None, "none"), (3, "t3")], "id long, text string")
    calls, path = tmp_path / "calls", str(tmp_path / "cache")
    with pytest.raises(Exception, match="Dies"):
        annotate_in_waves(df, backend(calls, dies_at="t30"), "m", path, wave_rows=15, batch=4)
    asked(calls)
    done = {r.id for r in cached(spark, path, "m").collect()}
    assert 0 < len(done) < 60 and "30" not in done
    other = next(i for i in map(str, range(60)) if i not in done and i != "30")
    # the next run asks for the missing rows, each once; two get no answer
    assert annotate_in_waves(df, backend(calls, silent=("t30", f"t{other}")), "m", path, wave_rows=15, batch=1, attempts=1) == 60 - len(done)
    assert sorted(asked(calls)) == sorted(f"t{i}" for i in range(60) if str(i) not in done)
    assert annotate_in_waves(df, backend(calls), "m", path, wave_rows=15, batch=4) == 2 and set(asked(calls)) == {"t30", f"t{other}"}
    assert annotate_in_waves(df, backend(calls), "m", path) == 0 and asked(calls) == []
    got = cached(spark, path, "m").collect()
    assert sorted((int(r.id), r.text, r.has_cs) for r in got) == [(i, f"t{i}", i % 10 == 7) for i in range(60)]
    assert {r["_seq"] for r in got if r.id in ("30", other)} == {3}
    # another tag is another annotator
    assert annotate_in_waves(df, backend(calls), "other", path) == 60 and cached(spark, path).count() == 120


def test_waves_and_files_do_not_grow_with_the_table(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(40)
    path = tmp_path / "cache"
    assert annotate_in_waves(df, backend(tmp_path / "calls"), "m", str(path), wave_rows=20) == 3000
    assert sorted(asked(tmp_path / "calls")) == sorted(f"t{i}" for i in range(3000))
    assert cached(spark, str(path), "m").count() == 3000
    for folder, most in (("asked", min(FILES, spark.sparkContext.defaultParallelism)), ("entries", None)):
        waves = list((path / folder / "run=1").glob("wave=*"))
        assert len(waves) == WAVES
        assert most is None or all(len(list(w.glob("part-*"))) <= most for w in waves)


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    assert annotate_in_waves(none, backend(tmp_path / "c"), "m", str(tmp_path / "x")) == 0
    assert cached(spark, str(tmp_path / "x")).count() == 0


def test_probabilities(spark, tmp_path):
    loads = tmp_path / "loads"

    def load():
        with open(loads, "a") as f:
            f.write("x")
        return lambda texts: np.array([[len(t) / 10, t.count("a")] for t in texts])

    df = spark.createDataFrame([(i, "a" * (i % 5)) for i in range(50)] + [(99, None)], "id int, text string").coalesce(1)
    out = inference.with_probabilities(df, load, 2, batch_size=7)
    assert {r.id: r.y_prob for r in out.collect()} == {**{i: [i % 5 / 10, i % 5] for i in range(50)}, 99: [0.0, 0.0]}
    assert loads.read_text() == "x"
    logits = inference.with_probabilities(df.where("id = 4"), load, 2, logits=True).first().y_prob
    assert logits == pytest.approx([1 / (1 + np.exp(-0.4)), 1 / (1 + np.exp(-4))])
    with pytest.raises(Exception, match="3 labels"):
        inference.with_probabilities(df, load, 3).collect()
    assert inference.with_probabilities(df.where("false"), load, 2).count() == 0


def test_threshold_of_another_split(spark):
    rows = [("val", [1], [0.3]), ("val", [0], [0.2])] * 15 + [("test", [1], [0.25]), ("test", [0], [0.1]), ("test", [1], [0.21])] * 5
    df = spark.createDataFrame([(*r, "s") for r in rows], "split string, y_true array<int>, y_prob array<double>, subset string")
    r = inference.evaluated_at_best(df, ["subset"]).first()
    assert r.threshold == pytest.approx(0.22) and r.n_samples == 15
    assert r.macro_f1 == pytest.approx(metrics.subset_metrics(df.where("split = 'test'").withColumn("y_pred", metrics.predict(F.col("y_prob"), r.threshold)), ["subset"]).first().macro_f1)
    # a condition that too few rows meet is dropped
    assert inference.evaluated_at_best(df, ["subset"], tune="y_true[0] = 5").first().threshold == pytest.approx(0.22)


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{":))": "cười", ":)": "vui", ":D": "lớn",\n ":d": "nhỏ", "a": 1, "B": null, ":)": "cuối"}', encoding="utf-8")
    assert list(read_lexicon(spark, str(tmp_path / "e.json")).items()) == [(":))", "cười"), (":)", "cuối"), (":D", "lớn"), (":d", "nhỏ"), ("a", "1"), ("B", "null")]
    (tmp_path / "t.txt").write_text("ko\tkhông\r\nz\tvậy\tđó\nno tab\nK\tka\n", encoding="utf-8")
    assert list(read_lexicon(spark, str(tmp_path / "t.txt")).items()) == [("ko", "không"), ("z", "vậy\tđó"), ("K", "ka")]


def test_metric_files(spark, tmp_path):
    for tag in ("xlm-r-s1", "vit5-s2"):
        (tmp_path / tag).mkdir()
        (tmp_path / tag / "metrics.csv").write_text(f"model,subset,macro_f1\n{tag},all,0.5\n")
    assert sorted((r.arch, r.scenario, r.macro_f1) for r in read_metrics(spark, str(tmp_path)).collect()) == [("vit5", "s2", 0.5), ("xlm-r", "s1", 0.5)]


def test_lexicon_of_table_size(spark, sf):
    """30,000 words in a table give what they give as a list in the plan, row by row; the plan does not grow."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 600").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(900, None), (901, "Soooo goood haha deadlinee")], "id long, text string"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).groupBy("word").count().withColumnRenamed("count", "n")
    filler = spark.range(30_000).select(F.concat(F.lit("zq"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.lit(1).alias("n"))
    lexicon = detect_v2.top_words(words.unionByName(filler), 30_000)
    listed = [r.w for r in lexicon.collect()]
    assert len(listed) == 30_000
    config = DetectorConfig(extra_english=tuple(listed))
    want = {r.token: r["class"] for r in detect_v2.classify_distinct(docs, config=config).collect()}
    got = detect_v2.classify_by_table(docs, lexicon)
    assert {r.token: r["class"] for r in got.collect()} == want
    small = detect_v2.classify_by_table(docs, lexicon.limit(1))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(got) < 1.2 * size(small)
    key = lambda r: r.id
    rows = sorted(detect_v2.annotate(docs, config=config).drop("text").collect(), key=key)
    for commonest in (50, 100_000):
        assert sorted(detect_v2.annotate_by_table(docs, lexicon, commonest=commonest).drop("text").collect(), key=key) == rows


def test_top_words(spark):
    f = spark.createDataFrame([("The", 5), ("the", 6), ("ab", 50), ("x1y", 40), ("cat", 11), ("bat", 11), ("dog", 1)], "word string, n int")
    assert [r.w for r in detect_v2.top_words(f, 2).collect()] == ["bat", "cat"]
    assert sorted(r.w for r in detect_v2.top_words(f, 10).collect()) == ["bat", "cat", "dog", "the"]
