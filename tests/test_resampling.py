"""Exact draws: sums, independence of partitions, and the distributions they should have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glotmill.operators import resampling
from glotmill.operators.splitting import Splitter, chosen, picked, stream

SIZES = np.array([3, 0, 40, 1, 7, 120, 0, 29])


@pytest.mark.parametrize("replace,draws", [(True, 200), (False, 77), (False, 0), (False, 200), (True, 50_000), (True, 4097)])
def test_counts_add_up(replace, draws):
    s = Splitter("g", SIZES, draws, 60, replace)
    parts = np.stack([s.counts(b) for b in range(8)])
    assert (parts.sum(axis=0) == draws).all() and (parts >= 0).all() and (parts[[1, 6]] == 0).all()
    if not replace:
        assert (parts <= SIZES[:, None]).all()
    assert np.abs(parts.mean(axis=1) - draws * SIZES / 200).max() <= 0.05 * draws + 1


def test_large_numbers_without_replacement():
    sizes = np.array([30_000, 50_000, 1, 19_999])
    s = Splitter("g", sizes, 40_000, 20, False)
    parts = np.stack([s.counts(b) for b in range(4)])
    assert (parts.sum(axis=0) == 40_000).all() and (parts <= sizes[:, None]).all() and abs(parts[0].mean() - 12_000) < 100


@pytest.mark.parametrize("replace", [True, False])
def test_inverted_distributions(replace):
    """Frequencies of a split of 12 rows of 20 against the binomial and the hypergeometric distribution."""
    s = Splitter("x", np.array([8, 12]), 9, 6000, replace)
    got = np.bincount(s.counts(0), minlength=10) / 6000
    if replace:
        want = [math.comb(9, k) * 0.4**k * 0.6 ** (9 - k) for k in range(10)]
    else:
        want = [math.comb(8, k) * math.comb(12, 9 - k) / math.comb(20, 9) if k <= 8 else 0 for k in range(10)]
    assert np.abs(got - want).max() < 0.025


def test_draws_within_a_bucket():
    assert picked("n", 1, 2, 500, 7).sum() == 500 and picked("n", 1, 2, 0, 7).sum() == 0
    for n in (0, 1, 13, 40):
        w = chosen("n", 3, 2, n, 40)
        assert w.sum() == n and set(w.tolist()) <= {0, 1}
    assert len(np.unique(stream("n", 100_000))) == 100_000
    counts = sum(picked("n", r, 0, 1000, 10) for r in range(50))
    assert np.abs(counts - 5000).max() < 400


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.range(900).select(
        F.col("id"), F.array((F.col("id") % 3 == 0).cast("tinyint"), (F.col("id") % 7 < 3).cast("tinyint")).alias("y_true"),
        F.array((F.col("id") % 4 == 0).cast("tinyint"), (F.col("id") % 5 < 2).cast("tinyint")).alias("y_pred"),
        F.when(F.col("id") % 9 == 0, "a").otherwise("b").alias("subset"),
    )
    return df.unionByName(df.where("id = 5"))  # a repeated row


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_every_replicate_has_n_rows(scored, bits):
    n = {"a": 100, "b": 801}
    rows = resampling._resampled(scored, "subset", None, 30, 7, bits, "y_true", "y_pred").collect()
    assert len(rows) == 2 * 30 * 2 and all(r.n == n[r.subset] for r in rows)


def test_every_permutation_has_fixed_sizes(scored):
    pooled = scored.withColumn("pair", F.lit("a|b"))
    rows = resampling._resampled(pooled, "pair", {"a|b": 100}, 2000, 7, 5, "y_true", "y_pred").collect()
    assert len(rows) == 2 * 2000 * 2 and {(r.side, r.n) for r in rows} == {(0, 100.0), (1, 801.0)}


def test_partitions_do_not_matter(scored):
    first = sorted(map(tuple, resampling.bootstrap_ci(scored, replicates=50, bits=4).collect()))
    assert sorted(map(tuple, resampling.bootstrap_ci(scored.repartition(13), replicates=50, bits=4).collect())) == first
    test = lambda df: resampling.permutation_test(df, [("a", "b")], permutations=100, bits=3).first()
    assert test(scored) == test(scored.repartition(9)) and test(scored).n_a == 100


def test_interval_against_a_plain_bootstrap(spark):
    """Micro F1 of independent labels: the interval's ends near those of numpy's own resampling."""
    rng = np.random.default_rng(5)
    t, p = rng.random(400) < 0.5, rng.random(400) < 0.6
    df = spark.createDataFrame([(i, [int(a)], [int(b)], "s") for i, (a, b) in enumerate(zip(t, p))], "id long, y_true array<tinyint>, y_pred array<tinyint>, subset string")
    r = resampling.bootstrap_ci(df, metric="micro_f1", replicates=800).first()
    f1 = lambda at: 2 * (t[at] & p[at]).sum() / (t[at].sum() + p[at].sum())
    lo, hi = np.percentile([f1(rng.integers(0, 400, 400)) for _ in range(3000)], [2.5, 97.5])
    assert abs(r.lo - lo) < 0.012 and abs(r.hi - hi) < 0.012


def test_signed_ranks_by_group(spark):
    gaps = spark.createDataFrame([("x", f"m{i}", v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0])] + [("x", "mean", 3.0), ("y", "m0", 1.0), ("z", "m0", None)], "gap string, model string, value double")
    r = resampling.signed_rank_table(gaps).collect()
    assert [(x.gap, x.n, x.positive, x.p_value) for x in r] == [("x", 5, 5, 2 / 32)]


def test_paired_scenarios(spark):
    rows = [(a, "all", s, v) for i, a in enumerate("abcde") for s, v in (("s1", 0.5 + 0.01 * i), ("s2", 0.4))] + [("f", "all", "s1", 0.9), ("a", "r0", "s1", 0.1), ("a", "r0", "s2", 0.2)]
    r = resampling.paired_scenarios(spark.createDataFrame(rows, "arch string, subset string, scenario string, macro_f1 double"), [("s1", "s2"), ("s1", "s3")]).collect()
    assert [(x.pair, x.subset, x.n, x.positive, x.p_value) for x in r] == [("s1-s2", "all", 5, 5, 2 / 32)]
