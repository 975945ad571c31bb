"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from glotmill import plans

TABLES = "region nation customer documents embeddings pages labels conversations events".split()


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    assert rows(plans.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_resampling_sizes(spark, sf, monkeypatch):
    """The registered queries draw as often as the operators' defaults: 1,000 replicates, 2,000 permutations."""
    from glotmill.operators import resampling

    drawn, whole = [], resampling._resampled
    monkeypatch.setattr(resampling, "_resampled", lambda df, key, draws, n, *a: drawn.append(n) or whole(df, key, draws, n, *a))
    for name in ("bootstrap_ci", "permutation_test"):
        plans.QUERIES[name](spark, sf)
    assert set(drawn) == {1000, 2000}
