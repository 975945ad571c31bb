"""Intervals and tests over resamples (M14 to M16), and signed-rank tests of models.

Resamples are exact: a bootstrap replicate draws as many rows as there are, with replacement, and a permutation puts
exactly as many rows into the first group as it has. ``splitting`` deals the draws over hash buckets of rows, so that
results do not depend on partitions and a lost task draws the same again. A task sums weighted label counts of its
buckets for all replicates by matrix products and sends replicates x labels sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.operators.metrics import averages, label_counts
from glotmill.operators.splitting import Splitter, chosen, picked

#: Rows that a bucket should hold; buckets are at most 2^MOST_BITS, so their table stays small.
BUCKET_ROWS, MOST_BITS, AT_ONCE = 2048, 16, 64


def _resampled(df: DataFrame, key: str, draws: dict[str, int] | None, replicates: int, seed: int, bits: int | None, true: str, pred: str) -> DataFrame:
    """(key, b, side, label_id, tp, fp, fn, support, n): sums over each replicate's rows.

    With ``draws`` that many rows of each group are chosen without replacement (side 0), the others being side 1;
    without, as many as there are are drawn with replacement.
    """
    schema = f"{key} string, b int, side int, label_id int, tp double, fp double, fn double, support double, n double"
    place = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = df.select(F.col(key).cast("string").alias("k"), place.alias("h"), F.col(true).alias("t"), F.col(pred).alias("p"))
    if bits is None:
        largest = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS)))))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int"))
    sizes: dict[str, np.ndarray] = {}
    for r in rows.groupBy("k", "bucket").count().collect():  # groups x 2^bits rows at most
        sizes.setdefault(r["k"], np.zeros(1 << bits, np.int64))[r["bucket"]] = r["count"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        splitters: dict[str, Splitter] = {}
        held: list[pd.DataFrame] = []
        now = None

        def finish() -> None:
            name, bucket = now
            part = pd.concat(held)
            t, p = np.stack(part["t"]).astype(float), np.stack(part["p"]).astype(float)
            counts = np.stack([t * p, (1 - t) * p, t * (1 - p), t, np.ones_like(t)], axis=2)
            size, each = len(part), int(sizes[name].sum())
            if name not in splitters:
                splitters[name] = Splitter(f"{seed}:{name}", sizes[name], each if draws is None else draws[name], replicates, draws is None)
                sums[name] = np.zeros((1 if draws is None else 2, replicates, *counts.shape[1:]))
            n, draw = splitters[name].counts(bucket), picked if draws is None else chosen
            for at in range(0, replicates, AT_ONCE):
                w = np.stack([draw(f"{seed}:{name}", r, bucket, int(n[r]), size) for r in range(at, min(at + AT_ONCE, replicates))]).astype(float)
                sums[name][0, at : at + AT_ONCE] += np.tensordot(w, counts, axes=1)
                if draws is not None:
                    sums[name][1, at : at + AT_ONCE] += np.tensordot(1 - w, counts, axes=1)

        for f in frames:
            for (name, bucket), g in f.groupby(["k", "bucket"], sort=False):
                if now is not None and (name, bucket) != now:
                    finish()
                    held = []
                now = (name, bucket)
                held.append(g)
        if held:
            finish()
        for name, total in sums.items():
            sides, b, labels = total.shape[:3]
            out = pd.DataFrame(total.reshape(-1, 5), columns=["tp", "fp", "fn", "support", "n"])
            out.insert(0, "label_id", np.tile(np.arange(labels), sides * b))
            out.insert(0, "side", np.repeat(np.arange(sides), b * labels))
            out.insert(0, "b", np.tile(np.repeat(np.arange(b), labels), sides))
            out.insert(0, key, name)
            yield out

    # within a bucket rows are told apart by their hash, then by what they hold
    sums = rows.repartition("k", "bucket").sortWithinPartitions("k", "bucket", "h", "t", "p").mapInPandas(run, schema)
    return sums.groupBy(key, "b", "side", "label_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support", "n")])


def bootstrap_ci(df: DataFrame, key: str = "subset", metric: str = "macro_f1", replicates: int = 1000, alpha: float = 0.05, seed: int = 42, least: int = 10, bits: int | None = None, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Key, n, lo, hi. Every replicate draws exactly n rows with replacement. Groups under ``least`` rows get nulls.

    2^bits buckets hold the rows; by default about 2,048 rows each. Other ``bits`` or seeds give other draws.
    """
    scores = averages(_resampled(df, key, None, replicates, seed, bits, true, pred), [key, "b"])
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(scores.groupBy(key).agg(F.percentile(metric, F.lit(alpha / 2)).alias("lo"), F.percentile(metric, F.lit(1 - alpha / 2)).alias("hi")), key)
    enough = F.col("n") >= least
    return out.select(key, "n", F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"))


def permutation_test(df: DataFrame, pairs: list[tuple[str, str]], key: str = "subset", metric: str = "macro_f1", permutations: int = 2000, seed: int = 42, bits: int | None = None, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A, b, n_a, n_b, diff, p_value, significant for disjoint groups.

    A permutation puts exactly n_a of the pooled rows into the first group. Pairs that share rows, or of which one is
    empty, are left out. Differences are compared to 12 digits, so that equal groups count as equal.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(key).agg(F.count(F.lit(1))).collect()}
    flags = F.collect_set(F.when(F.col(key).isin([x for p in pairs for x in p]), F.col(key)))
    shared = df.groupBy("id").agg(flags.alias("s")).select(*[F.coalesce(F.max(F.array_contains("s", a) & F.array_contains("s", b)), F.lit(False)).alias(f"{a}|{b}") for a, b in pairs]).first().asDict()
    valid = [(a, b) for a, b in pairs if a in sizes and b in sizes and not shared[f"{a}|{b}"]]
    spark, columns = df.sparkSession, "a string, b string, n_a long, n_b long, diff double, p_value double, significant boolean"
    if not valid:
        return spark.createDataFrame([], columns)
    tagged = df.withColumn("pair", F.explode(F.array_compact(F.array(*[F.when(F.col(key).isin(a, b), F.lit(f"{a}|{b}")) for a, b in valid]))))
    sums = averages(_resampled(tagged, "pair", {f"{a}|{b}": sizes[a] for a, b in valid}, permutations, seed, bits, true, pred), ["pair", "b", "side"])
    diffs = sums.groupBy("pair", "b").agg((F.max(F.when(F.col("side") == 0, F.col(metric))) - F.max(F.when(F.col("side") == 1, F.col(metric)))).alias("d"))
    seen = averages(label_counts(df.where(F.col(key).isin([x for p in valid for x in p])), [key], true, pred), [key]).select(key, F.col(metric).alias("m"))
    table = spark.createDataFrame([(f"{a}|{b}", a, b, sizes[a], sizes[b]) for a, b in valid], "pair string, a string, b string, n_a long, n_b long")
    table = table.join(seen.select(F.col(key).alias("a"), F.col("m").alias("ma")), "a").join(seen.select(F.col(key).alias("b"), F.col("m").alias("mb")), "b").withColumn("diff", F.col("ma") - F.col("mb"))
    size = lambda c: F.round(F.abs(c), 12)
    count = diffs.join(table.select("pair", "diff"), "pair").groupBy("pair").agg(((F.count_if(size("d") >= size("diff")) + 1) / F.lit(permutations + 1)).alias("p_value"))
    return table.join(count, "pair").select("a", "b", "n_a", "n_b", "diff", "p_value", (F.col("p_value") < 0.05).alias("significant"))


def wilcoxon(differences: list[float]) -> dict[str, float]:
    """Signed-rank test of a few differences (one per model): statistic, exact two-sided p, mean, sd, positives.

    Zeros are left out; tied sizes share their mean rank. The p-value counts all 2^n sign patterns by dynamic programming
    over doubled ranks, so ties keep it exact.
    """
    d = [x for x in differences if x != 0 and not np.isnan(x)]
    n = len(d)
    sizes = sorted(map(abs, d))
    rank = {s: sizes.index(s) + sizes.count(s) + sizes.index(s) + 1 for s in set(sizes)}  # twice the mean rank
    up = sum(rank[abs(x)] for x in d if x > 0)
    total = sum(rank[s] for s in sizes)
    ways = np.zeros(total + 1)
    ways[0] = 1
    for s in sizes:
        ways[rank[s] :] = ways[rank[s] :] + ways[: total + 1 - rank[s]]
    low = min(up, total - up)
    p = min(1.0, 2 * ways[: low + 1].sum() / 2**n) if n else float("nan")
    every = np.array([x for x in differences if not np.isnan(x)], dtype=float)
    return {"statistic": low / 2, "p_value": float(p), "mean": float(every.mean()) if len(every) else float("nan"), "sd": float(every.std(ddof=1)) if len(every) > 1 else float("nan"), "positive": int((every > 0).sum()), "n": len(every)}


TESTED = "n int, mean double, sd double, positive int, p_value double"


def _tested(values: DataFrame, least: int) -> DataFrame:
    """Tests of the column ``value`` for each ``gap``; a gap has one value a model, so a group is a few dozen rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = wilcoxon([float("nan") if v is None else float(v) for v in rows["value"]])
        return pd.DataFrame([(key[0], *[r[k] for k in ("n", "mean", "sd", "positive", "p_value")])] if len(rows) >= least else [], columns=["gap", "n", "mean", "sd", "positive", "p_value"])

    return values.select("gap", "value").groupBy("gap").applyInPandas(run, f"gap string, {TESTED}")


def signed_rank_table(gaps: DataFrame, least: int = 5) -> DataFrame:
    """Tests of every gap over models (one value per model)."""
    return _tested(gaps.where("model <> 'mean'"), least)


def paired_scenarios(scores: DataFrame, pairs: list[tuple[str, str]], metric: str = "macro_f1", least: int = 4) -> DataFrame:
    """Tests of scenario against scenario, paired by architecture and subset; ``scores`` has arch, scenario, subset.

    Pairs of scenarios that fewer than ``least`` architectures share are left out.
    """
    one = scores.groupBy("arch", "subset", "scenario").agg(F.max(metric).alias("m"))
    wanted = scores.sparkSession.createDataFrame([(a, b) for a, b in pairs], "sa string, sb string")
    first, second = one.select("arch", "subset", F.col("scenario").alias("sa"), F.col("m").alias("ma")), one.select("arch", "subset", F.col("scenario").alias("sb"), F.col("m").alias("mb"))
    both = first.join(F.broadcast(wanted), "sa").join(second, ["arch", "subset", "sb"])
    named = both.select(F.concat_ws("|", F.concat_ws("-", "sa", "sb"), "subset").alias("gap"), (F.col("ma") - F.col("mb")).alias("value"))
    tested, parts = _tested(named, least), F.split("gap", "\\|")
    return tested.select(parts[0].alias("pair"), parts[1].alias("subset"), *[c.split()[0] for c in TESTED.split(", ")])
