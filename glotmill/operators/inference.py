"""Model inference as a batch hook (section 2.14): any model that maps texts to label probabilities.

A model is loaded once in each Python worker, on the executors, and sees Arrow batches of texts. The engine takes the
probability table that comes out: thresholds are tuned on one split and applied to another by the metrics' own sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from glotmill.operators import metrics

#: Texts to a matrix of texts x labels, probabilities or logits.
Model = Callable[[list[str]], np.ndarray]


def predict_probabilities(text: Column, load: Callable[[], Model], n_labels: int, batch_size: int = 32, logits: bool = False) -> Column:
    """An array of ``n_labels`` probabilities for each text. ``load`` runs once in a worker; a null text is empty.

    With ``logits`` the model's numbers go through the sigmoid (M11). A model that gives another number of rows or labels
    fails the task, so that no probability lands at the wrong text.
    """

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            found = np.asarray(model([str(t) for t in texts.ravel()]), dtype=np.float64)
            if found.shape != (texts.size, n_labels):
                raise ValueError(f"the model gave {found.shape} for {texts.size} texts and {n_labels} labels")
            return 1 / (1 + np.exp(-found)) if logits else found

        return predict

    return predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)(F.coalesce(text, F.lit("")))


def with_probabilities(df: DataFrame, load: Callable[[], Model], n_labels: int, text_col: str = "text", out: str = "y_prob", **options) -> DataFrame:
    """``df`` with the column ``out``, which M10 to M13 read."""
    return df.withColumn(out, predict_probabilities(F.col(text_col), load, n_labels, **options))


def evaluated_at_best(df: DataFrame, keys: list[str], metric: str = "macro_f1", tune_on: str = "val", test_on: str = "test", least: int = 20, points: int = 31, tune: str | None = None) -> DataFrame:
    """Metrics of split ``test_on`` by ``keys``, at the threshold that is best on split ``tune_on``.

    ``df`` has split, y_true and y_prob. ``tune`` is a condition that narrows the tuning rows; if fewer than ``least``
    satisfy it, all of the split are used (P6). The driver sees the threshold alone.
    """
    val = df.where(F.col("split") == tune_on)
    if tune is not None:
        enough = val.where(tune).limit(least).count() >= least
        val = val.where(tune) if enough else val
    best = metrics.tune_threshold(val, metric, points).select("threshold")
    threshold = best.first()
    threshold = 0.5 if threshold is None else threshold[0]
    scored = df.where(F.col("split") == test_on).withColumn("threshold", F.lit(threshold))
    scored = scored.withColumn("y_pred", metrics.predict(F.col("y_prob"), F.col("threshold")))
    return metrics.subset_metrics(scored, [*keys, "threshold"])
