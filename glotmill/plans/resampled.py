"""Queries over resamples and tests of models, and SQL that repeats their draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.operators import metrics, resampling
from glotmill.plans import sql as S
from glotmill.plans.reference import evaluated, query, rounded

BITS, SEED = 4, 42


def _mixed(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * 73244475) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


def _number(name: str, digits: int) -> str:
    return f"('0x' || substr(md5({name}), 1, {digits}))::BIGINT"


def _draws(replicates: int, replace: bool, bits: int = BITS) -> str:
    """From rw (k, doc_id) and tot (k, draws): leaf (k, r, bucket, m), each replicate's draws in each bucket of rows pl."""
    if replace:
        weight = "exp(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1) + c * ln(lft / (lft + rgt)) + (m - c) * ln(rgt / (lft + rgt)))"
    else:
        choose = lambda n, j: f"lgamma({n} + 1) - lgamma({j} + 1) - lgamma({n} - {j} + 1)"
        weight = f"CASE WHEN c <= lft AND m - c <= rgt THEN exp({choose('lft', 'c')} + {choose('rgt', '(m - c)')} - ({choose('(lft + rgt)', 'm')})) ELSE 0 END"
    parts = [
        f"bk AS (SELECT *, md5(doc_id::VARCHAR) AS h, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT >> {32 - bits} AS bucket FROM rw)",
        "pl AS (SELECT *, row_number() OVER (PARTITION BY k, bucket ORDER BY h) - 1 AS at FROM bk)",
        "sz AS (SELECT k, bucket, count(*) AS n FROM bk GROUP BY 1, 2)",
        f"nd0 AS (SELECT k, r, 0::BIGINT AS prefix, draws AS m FROM tot, range({replicates}) t(r))",
    ]
    for i in range(bits):
        goes = lambda side: f"coalesce(sum(n) FILTER ((bucket >> {bits - i - 1}) & 1 = {side}), 0)::DOUBLE"  # noqa: B023, E731
        name = f"'{SEED}:' || nd.k || ':' || r || ':{i}:' || nd.prefix"
        parts += [
            f"s{i} AS (SELECT k, bucket >> {bits - i} AS prefix, {goes(0)} AS lft, {goes(1)} AS rgt FROM sz GROUP BY 1, 2)",
            f"x{i} AS (SELECT nd.k, nd.r, nd.prefix, nd.m, lft, rgt, {_number(name, 13)} / 4503599627370496.0 AS u FROM nd{i} nd JOIN s{i} s ON nd.k = s.k AND nd.prefix = s.prefix)",
            f"c{i} AS (SELECT k, r, prefix, m, u, sum({weight}) OVER (PARTITION BY k, r, prefix ORDER BY c) AS upto FROM (SELECT *, unnest(range(m + 1)) AS c FROM x{i} WHERE lft > 0 AND rgt > 0))",
            f"g{i} AS (SELECT k, r, prefix, least(count_if(upto < u), any_value(m))::BIGINT AS lm FROM c{i} GROUP BY 1, 2, 3)",
            f"l{i} AS (SELECT x.*, CASE WHEN lft = 0 THEN 0 WHEN rgt = 0 THEN m ELSE lm END AS goes FROM x{i} x LEFT JOIN g{i} g ON x.k = g.k AND x.r = g.r AND x.prefix = g.prefix)",
            f"nd{i + 1} AS (SELECT k, r, 2 * prefix AS prefix, goes AS m FROM l{i} UNION ALL SELECT k, r, 2 * prefix + 1, m - goes FROM l{i})",
        ]
    stream = _number(f"'{SEED}:' || nd.k || ':' || r || ':' || sz.bucket", 8)
    parts.append(f"leaf AS (SELECT nd.k, nd.r, sz.bucket, nd.m, sz.n, {stream} AS s FROM nd{bits} nd JOIN sz ON nd.k = sz.k AND nd.prefix = sz.bucket)")
    return ", ".join(parts)


def _place(i: str) -> str:
    return _mixed(f"((s + {i} * 2654435761) % 4294967296)")


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"
_COUNTED = "sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((y <> 1 AND p >= 0.5)::INT) AS fp, sum((y = 1 AND p < 0.5)::INT) AS fn"


@query(f"""WITH {S.EVAL}, rw AS (SELECT DISTINCT subset AS k, doc_id FROM ev), tot AS (SELECT k, count(*) AS draws FROM rw GROUP BY k), {_draws(1000, True)},
dr AS (SELECT k, r, bucket, {_place('j')} % n AS at FROM (SELECT *, unnest(range(m)) AS j FROM leaf)), ct AS (SELECT dr.k, dr.r, ev.label_id, {_COUNTED} FROM dr JOIN pl ON dr.k = pl.k AND dr.bucket = pl.bucket AND dr.at = pl.at JOIN ev ON ev.subset = pl.k AND ev.doc_id = pl.doc_id GROUP BY 1, 2, 3),
sr AS (SELECT k, r, avg({_F1}) AS f1 FROM ct GROUP BY 1, 2) SELECT k AS subset, any_value(draws) AS n, round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi FROM sr JOIN tot USING (k) GROUP BY k""")
def bootstrap_ci(spark, sf):
    """Intervals of macro F1 over 1,000 replicates of exactly n rows."""
    return rounded(resampling.bootstrap_ci(evaluated(spark, sf), bits=BITS), "lo", "hi")


_PAIRS = [("r0", "r1"), ("r0", "r2")]


@query(f"""WITH {S.EVAL}, pr(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PAIRS)}), rw AS (SELECT DISTINCT a || '|' || b AS k, doc_id, subset FROM ev JOIN pr ON subset IN (a, b)),
tot AS (SELECT k, count_if(subset = split_part(k, '|', 1))::BIGINT AS draws, count(*) AS n FROM rw GROUP BY k), {_draws(2000, False)},
sd AS (SELECT leaf.k, leaf.r, pl.doc_id, pl.subset, (row_number() OVER (PARTITION BY leaf.k, leaf.r, leaf.bucket ORDER BY {_place('pl.at')}) > m)::INT AS side FROM leaf JOIN pl ON leaf.k = pl.k AND leaf.bucket = pl.bucket),
lab AS (SELECT DISTINCT doc_id, label_id, y, p FROM ev), ct AS (SELECT k, r, side, label_id, {_COUNTED} FROM sd JOIN lab USING (doc_id) GROUP BY 1, 2, 3, 4), sr AS (SELECT k, r, side, avg({_F1}) AS f1 FROM ct GROUP BY 1, 2, 3),
df AS (SELECT k, r, max(f1) FILTER (side = 0) - max(f1) FILTER (side = 1) AS d FROM sr GROUP BY 1, 2), oc AS (SELECT k, subset, label_id, {_COUNTED} FROM rw JOIN lab USING (doc_id) GROUP BY 1, 2, 3),
ob AS (SELECT k, max(f1) FILTER (subset = split_part(k, '|', 1)) - max(f1) FILTER (subset = split_part(k, '|', 2)) AS o FROM (SELECT k, subset, avg({_F1}) AS f1 FROM oc GROUP BY 1, 2) GROUP BY k)
SELECT split_part(k, '|', 1) AS a, split_part(k, '|', 2) AS b, any_value(draws) AS n_a, any_value(n - draws) AS n_b, round(any_value(o), 6) AS diff, round((count_if(round(abs(d), 12) >= round(abs(o), 12)) + 1) / 2001, 6) AS p_value,
  (count_if(round(abs(d), 12) >= round(abs(o), 12)) + 1) / 2001 < 0.05 AS significant FROM df JOIN ob USING (k) JOIN tot USING (k) GROUP BY k""")
def permutation_test(spark, sf):
    """2,000 permutations with exact group sizes; the pair (all, r0) shares rows and falls out."""
    return rounded(resampling.permutation_test(evaluated(spark, sf), [*_PAIRS, ("all", "r0")], bits=BITS), "diff", "p_value")


_ARCHES = "abcdef"
_PAIRED = f"""md(model) AS (VALUES {', '.join(f"('{a}{s}')" for a in _ARCHES for s in "12")}), lb AS (SELECT doc_id, model, 0 AS label_id, quality AS y, {S.pseudo("' || model || '0")} AS p FROM labels CROSS JOIN md
  UNION ALL SELECT doc_id, model, 1, toxic, {S.pseudo("' || model || '1")} FROM labels CROSS JOIN md), ev AS (SELECT *, 'all' AS subset FROM lb UNION ALL SELECT *, 'r' || (doc_id % 3) FROM lb)"""


@query(f"""WITH {_PAIRED}, {S.counts(keys='model, subset')}, g AS (SELECT a.subset, a.model, a.macro_f1 - b.macro_f1 AS value FROM mt a JOIN mt b ON a.subset = b.subset AND a.model[1] = b.model[1] WHERE a.model[2] = '1' AND b.model[2] = '2'),
d AS (SELECT subset, value, row_number() OVER (PARTITION BY subset ORDER BY model) - 1 AS i, 2 * rank() OVER (PARTITION BY subset ORDER BY abs(value)) + count(*) OVER (PARTITION BY subset, abs(value)) - 1 AS r2 FROM g WHERE value <> 0),
st AS (SELECT subset, least(sum(r2 * (value > 0)::INT), sum(r2 * (value < 0)::INT)) AS low FROM d GROUP BY subset), cn AS (SELECT subset, count(*) AS k FROM d GROUP BY subset),
signs AS (SELECT subset, s.pattern, sum(r2 * ((s.pattern >> d.i) & 1)) AS v FROM d JOIN cn USING (subset) CROSS JOIN range({2 ** len(_ARCHES)}) s(pattern) WHERE s.pattern < 1 << k GROUP BY subset, s.pattern),
pv AS (SELECT subset, least(1, 2 * count_if(v <= low) / count(*)) AS p FROM signs JOIN st USING (subset) GROUP BY subset)
SELECT 's1-s2' AS pair, subset, count(*)::INT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count_if(value > 0)::INT AS positive, round(any_value(p), 6) AS p_value FROM g JOIN pv USING (subset) GROUP BY subset""")
def paired_scenarios(spark, sf):
    """Two scenarios of six pseudo-models, paired by model; the SQL lists all patterns of signs."""
    parts = [metrics.subset_metrics(evaluated(spark, sf, f"{a}{s}"), ["subset"]).select("subset", "macro_f1", F.lit(a).alias("arch"), F.lit(f"s{s}").alias("scenario")) for a in _ARCHES for s in "12"]
    return rounded(resampling.paired_scenarios(reduce(DataFrame.unionByName, parts), [("s1", "s2")]), "mean", "sd", "p_value")
