"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from glotmill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string"


def fitted(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    c = distinct - 1_000_000.0 - (sums / n - 1_000_000.0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def close(rows, vectors, ids):
    x, n, sums, values, basis = fitted(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    k = max(c for _, c in by)
    for j in range(k):
        expected = (x - sums / n) @ basis[:, j] / np.sqrt(values[j])
        got = np.array([by[i, j + 1].whitened for i in ids])
        assert np.allclose(np.abs(got), np.abs(expected), atol=1e-6) and abs(abs(got @ expected) - expected @ expected) < 1e-4 * (1 + expected @ expected)
        assert abs(by[ids[0], j + 1].explained - values[j] / values.sum()) < 1e-9
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for i, v in zip(ids, x):
        assert by[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
    return k


@pytest.mark.parametrize("size,decay", [(5, 1.0), (24, 0.6), (64, 0.5), (64, 1.0)])
def test_equals_a_dense_decomposition(spark, size, decay):
    rng = np.random.default_rng(size)
    v = (rng.standard_normal((300, size)) * decay ** np.arange(size) * 4) @ np.linalg.qr(rng.standard_normal((size, size)))[0]
    rows = [(i, list(map(float, x)), "c") for i, x in enumerate(v)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert close(got, v, list(range(300))) == min(16, size)


def test_few_passes_or_the_full_dimension():
    """A steep spectrum ends early in a narrow basis; a flat one is completed; both are exact."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for values, full in ((1e-3 ** np.arange(80.0), False), (1 + rng.random(80), True)):
        v, widths = (q * values) @ q.T, []
        found, vectors = W.leading_eigenpairs(lambda b: widths.append(b.shape[1]) or v @ b, 80, k=4)
        assert (widths[-1] == 80) is full and len(widths) <= W.PASSES + 1
        assert np.allclose(found, np.sort(values)[::-1][:4], rtol=1e-10)
        assert np.abs(v @ vectors - vectors * found).max() < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 3)).astype(np.float32)
    good = [(i, [float(c) for c in x], "c") for i, x in enumerate(v)]
    odd = [(100, None, "c"), (101, [], "c"), (102, [1.0, None, 2.0], "c"), (103, [1.0, float("nan"), 2.0], "c"), (104, [float("inf")] * 3, "c"), (105, [1.0, 2.0], "c")]
    repeats = [(0, good[0][1], "c"), (None, good[1][1], "c")]
    got = W.whiten(spark.createDataFrame(good + odd + repeats, SCHEMA).repartition(4)).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(40)) and len(got) == 42 * 3
    close([r for r in got if r.vec_id is not None], v, list(range(40)))


def test_no_components(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert W.whiten(df([])).count() == 0
    assert W.whiten(df([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")])).count() == 0
    line = W.whiten(df([(i, [float(i), 2.0 * i], "") for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9


def test_exact_beyond_64_bits():
    x = np.array([[2**61, 0], [0, 0]])
    assert W._deviations(x, 2, [2**61, 0]).tolist() == [2**63 - 1, 2**63 - 1]
    assert W._deviations(np.array([[3, 1]]), 2, [4, 2]).tolist() == [4]
