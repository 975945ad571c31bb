"""Multi-label evaluation.

Rows carry ``y_true`` and ``y_pred`` (0/1 arrays) or ``y_prob``. Everything is a sum over (subset, label): rows are
exploded to labels, partial sums are made before the shuffle, and what is left has subsets x labels rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predict(prob: Column, threshold: float | Column) -> Column:
    """M10, inclusive."""
    return F.transform(prob, lambda p: (p >= threshold).cast("tinyint"))


def sigmoid(x: Column) -> Column:
    """M11."""
    return 1 / (1 + F.exp(-x))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def label_counts(df: DataFrame, keys: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """keys, label_id, tp, fp, fn, support, n."""
    long = df.select(*keys, F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))).alias("label_id", "x"))
    t, p = F.col("x.t") == 1, F.col("x.p") == 1
    return long.groupBy(*keys, "label_id").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("support"), F.count(F.lit(1)).alias("n"))


def with_label_scores(counts: DataFrame) -> DataFrame:
    """M7: precision, recall and f1 of each label."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def averages(counts: DataFrame, keys: list[str]) -> DataFrame:
    """M1 to M4 from label counts; labels without support count in the macro means."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return with_label_scores(counts).groupBy(*keys).agg(
        F.max("n").alias("n_samples"), ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("weighted_f1"), ((fp + fn) / F.sum("n")).alias("hamming_loss"),
        (1 - (fp + fn) / F.sum("n")).alias("label_accuracy"),
    )


def subset_metrics(df: DataFrame, keys: list[str], true: str = "y_true", pred: str = "y_pred", least: int = 5) -> DataFrame:
    """One row per group with all averages; groups under ``least`` rows are left out."""
    size = lambda a: F.aggregate(F.col(a), F.lit(0), lambda s, x: s + x.cast("int"))
    rows = df.groupBy(*keys).agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("subset_accuracy"), F.avg(size(pred)).alias("avg_pred_per_sample"), F.avg(size(true)).alias("avg_gold_per_sample"))
    return averages(label_counts(df, keys, true, pred), keys).join(rows, keys).where(F.col("n_samples") >= least)


def density_check(df: DataFrame, keys: list[str], pred: str = "y_pred", most: float = 10.0) -> DataFrame:
    """Labels predicted a row, and whether they are few enough for a head that was loaded rightly."""
    n = F.size(F.filter(F.col(pred), lambda x: x == 1))
    return df.groupBy(*keys).agg(F.avg(n).alias("avg_pred_per_sample")).withColumn("plausible", F.col("avg_pred_per_sample") < most)


def mean_ci_width(scores: DataFrame, metric: str = "macro_f1", subset: str = "subset") -> DataFrame:
    """Mean width over models of each subset's interval (columns metric_lo and metric_hi); smaller differences are noise."""
    return scores.groupBy(subset).agg(F.avg(F.col(f"{metric}_hi") - F.col(f"{metric}_lo")).alias("ci_width"))


def sample_averages(df: DataFrame, keys: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """M8: means over rows of a row's precision, recall and F1."""
    both = F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))
    n = lambda test: F.size(F.filter(both, test))
    tp, p, t = n(lambda x: (x["t"] == 1) & (x["p"] == 1)), n(lambda x: x["p"] == 1), n(lambda x: x["t"] == 1)
    return df.groupBy(*keys).agg(F.avg(ratio(tp, p)).alias("samples_precision"), F.avg(ratio(tp, t)).alias("samples_recall"), F.avg(ratio(2 * tp, p + t)).alias("samples_f1"))


def tune_threshold(df: DataFrame, metric: str = "macro_f1", points: int = 31, prob: str = "y_prob", true: str = "y_true", keys: list[str] | None = None) -> DataFrame:
    """The lowest of the thresholds 0.10 + 0.02 i with the best score; 0.5 where every score is 0.

    A row's probability passes the first k thresholds, so each (label, k) is counted once and running sums over k give
    the counts at every threshold: rows are not multiplied by the grid.
    """
    keys = keys or []
    grid = [0.10 + 0.02 * i for i in range(points)]
    long = df.select(*keys, F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(prob).alias("p"))).alias("label_id", "x"))
    passed = F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda k, g: k + (F.col("x.p") >= g).cast("int"))
    counts = long.groupBy(*keys, "label_id", passed.alias("k")).agg(F.count_if(F.col("x.t") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    spread = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    sums = spread.groupBy(*keys, "label_id", "i").agg(
        F.sum(F.when(F.col("k") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") > F.col("i"), F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") <= F.col("i"), F.col("pos")).otherwise(0)).alias("fn"), F.sum("pos").alias("support"), F.sum("n").alias("n"),
    )
    scored = averages(sums, [*keys, "i"]).withColumn("threshold", F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    best = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc(metric), "threshold"))).where("r = 1")
    return best.select(*keys, F.when(F.col(metric) > 0, F.col("threshold")).otherwise(0.5).alias("threshold"), F.col(metric).alias("best"))


def shared_label_macro(counts: DataFrame, group: str, a: str, b: str, least: int = 5) -> DataFrame:
    """Macro F1 of two groups over the labels that both have often enough."""
    side = lambda g, n: with_label_scores(counts.where(F.col(group) == g)).where(F.col("support") >= least).select("label_id", F.col("f1").alias(n))
    return side(a, "fa").join(side(b, "fb"), "label_id").agg(F.avg("fa").alias("f1_a"), F.avg("fb").alias("f1_b"), F.count(F.lit(1)).alias("n_labels"))


def worst_labels(counts: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """W4."""
    w = Window.partitionBy(*keys).orderBy("f1", "label_id")
    return with_label_scores(counts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pos_weight(df: DataFrame, true: str = "y_true", low: float = 1.0, high: float = 50.0, clip: bool = True) -> DataFrame:
    """Negatives over positives for each label (at least one positive is assumed), clipped by default."""
    long = df.select(F.posexplode(true).alias("label_id", "t"))
    c = long.groupBy("label_id").agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") != 1).alias("neg"))
    w = F.col("neg") / F.greatest(F.col("pos"), F.lit(1))
    return c.withColumn("pos_weight", F.least(F.greatest(w, F.lit(low)), F.lit(high)) if clip else w)


def weighted_bce(df: DataFrame, weights: DataFrame, logit: str = "y_logit", true: str = "y_true") -> DataFrame:
    """Mean weighted loss; ``weights`` has a row per label and is broadcast."""
    long = df.select(F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(logit).alias("x"))).alias("label_id", "v")).join(F.broadcast(weights.select("label_id", "pos_weight")), "label_id")
    x, t = F.col("v.x"), F.col("v.t")
    log_sigmoid = lambda z: -F.log1p(F.exp(-F.abs(z))) + F.least(z, F.lit(0.0))
    return long.agg(F.avg(-(F.col("pos_weight") * t * log_sigmoid(x) + (1 - t) * log_sigmoid(-x))).alias("loss"))


def errors(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows whose prediction differs."""
    return df.where(~F.col(true).eqNullSafe(F.col(pred)))


def gaps(scores: DataFrame, pairs: list[tuple[str, str]], metric: str = "macro_f1", model: str = "model") -> DataFrame:
    """Per model the metric's difference between subsets, and the mean over models as ``mean``."""
    names = sorted({s for p in pairs for s in p})
    wide = scores.groupBy(model).pivot("subset", names).agg(F.first(metric))
    rows = wide.select(model, F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("gap"), (F.col(a) - F.col(b)).alias("value")) for a, b in pairs])).alias("g")).select(model, "g.*")
    return rows.unionByName(rows.groupBy("gap").agg(F.avg("value").alias("value")).withColumn(model, F.lit("mean")))


def compare(scores: DataFrame, metric: str = "macro_f1", model: str = "model", order: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Subset x model, with the subset's size first and preferred subsets on top; U5: ``only`` these subsets."""
    scores = scores if only is None else scores.where(F.col("subset").isin(only))
    wide = scores.groupBy("subset").pivot(model).agg(F.round(F.avg(metric), 4))
    sizes = scores.groupBy("subset").agg(F.min_by("n_samples", model).alias("n"))
    place = F.array_position(F.array(*map(F.lit, order or ["all"])), F.col("subset"))
    return sizes.join(wide, "subset").orderBy(F.when(place == 0, 10_000).otherwise(place), "subset")


def paper_check(scores: DataFrame, published: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """100 x macro F1 on ``all`` beside published values (arch, scenario, paper)."""
    got = scores.where("subset = 'all'").select("arch", "scenario", F.round(100 * F.col("macro_f1"), 2).alias("got"))
    out = got.join(F.broadcast(published), ["arch", "scenario"], "left").withColumn("diff", F.round(F.col("got") - F.col("paper"), 2))
    return out.withColumn("ok", F.abs("diff") <= tolerance)


def best_epoch(history: DataFrame, model: str = "model", score: str = "macro_f1") -> DataFrame:
    """The first epoch with the best score."""
    return history.groupBy(model).agg(F.max_by(F.struct("epoch", score), F.struct(F.col(score), -F.col("epoch"))).alias("b")).select(model, "b.*")


def early_stop(history: DataFrame, model: str = "model", score: str = "macro_f1", patience: int = 2) -> DataFrame:
    """Epochs that training reaches when it stops after ``patience`` epochs without gain."""
    before = Window.partitionBy(model).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    gained = history.withColumn("gain", F.coalesce(F.col(score) > F.max(score).over(before), F.lit(True)))
    last = F.max(F.when(F.col("gain"), F.col("epoch"))).over(Window.partitionBy(model).orderBy("epoch"))
    stale = gained.withColumn("stale", F.col("epoch") - last)
    stop = F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).over(Window.partitionBy(model))
    return stale.withColumn("stop", stop).where(F.col("epoch") <= F.coalesce("stop", "epoch")).drop("stale", "stop")
