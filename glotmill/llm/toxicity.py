"""Toxicity scores from non-negative positive-unlabelled learning.

Only confirmed toxic texts count as labels; all other text is unlabelled and holds an unknown number of toxic texts.
With p the share of toxic texts, R+ and R- the mean losses as toxic and as clean, P the toxic and U the unlabelled
texts, the risk is p R+(P) + max(0, R-(U) - p R-(P)): the second part estimates the loss on clean texts from unlabelled
ones, corrected by the class prior; where it turns negative the model has begun to fit the toxic texts hidden in U, and
the step goes the other way. The classifier is linear over the presence of words and of their first four and five
letters, trained in numpy on a bounded sample (parameters below) and sent to the tasks as a table of at most
``max_features`` weights; every whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import held_out, unit_hash

WORD = re.compile(r"[^\W\d_]+")
MEMO = 400_000


@dataclass(frozen=True)
class NnPU:
    max_positive: int = 3000  # toxic texts in the sample
    max_unlabelled: int = 9000  # unlabelled texts in the sample
    max_features: int = 1 << 17
    min_df: int = 5  # texts of the sample that hold a feature
    min_z: float = 5.0  # how surely a feature is commoner in toxic than in unlabelled texts, in standard errors
    epochs: int = 40
    batch: int = 1024
    rate: float = 0.05
    decay: float = 1e-5
    beta: float = 0.0  # how far below zero the clean part may fall
    gamma: float = 1.0  # size of the steps back
    prior_floor: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # hashes of features, sorted
    weights: np.ndarray
    bias: float
    prior: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.keys.tolist(), self.weights.tolist()))


def features(text: str | None) -> set[str]:
    """Distinct words and their first four and five letters, lower-cased."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:4] for w in words} | {w[:5] for w in words}


def key(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) >> 1


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """Sparse rows of present features."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.columns = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cols = np.concatenate([self.columns[self.ends[i] : self.ends[i + 1]] for i in at]) if len(at) else self.columns[:0]
        return cols, np.repeat(np.arange(len(at)), self.sizes[at])


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], config: NnPU) -> np.ndarray:
    """Features that are surely commoner in toxic than in unlabelled texts, the surest ``max_features`` of them."""
    if not positive or not unlabelled:
        return np.zeros(0, dtype=np.int64)
    found, at = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    cut = sum(map(len, positive))
    df_p, df_u = np.bincount(at[:cut], minlength=len(found)), np.bincount(at[cut:], minlength=len(found))
    n_p, n_u = len(positive), len(unlabelled)
    pool = (df_p + df_u) / (n_p + n_u)
    z = (df_p / n_p - df_u / n_u) / np.sqrt(np.maximum(pool * (1 - pool) * (1 / n_p + 1 / n_u), 1e-12))
    z[df_p + df_u < config.min_df] = -np.inf
    best = np.lexsort((found, -z))[: config.max_features]
    return np.sort(found[best[z[best] >= config.min_z]])


def slopes(sp: np.ndarray, su: np.ndarray, prior: float, config: NnPU) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the risk by the logits of a batch's toxic and unlabelled texts, whose sigmoids are ``sp`` and ``su``.

    Sigmoid loss: s(z) as clean, 1 - s(z) as toxic; both have slope s(1 - s), of opposite sign. Where the estimated loss
    on clean texts falls under -beta, the slopes are those of that estimate alone, times -gamma.
    """
    clean = su.mean() - prior * sp.mean()
    slope_p, slope_u = prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    if clean >= -config.beta:
        return -2 * slope_p, slope_u
    return config.gamma * slope_p, -config.gamma * slope_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, config: NnPU) -> Model:
    """Fits the weights; rows are arrays of feature hashes without repeats."""
    found = choose(positive, unlabelled, config)

    def columns(rows: list[np.ndarray]) -> _Rows:
        out = []
        for r in rows:
            at = np.searchsorted(found, r)
            at[at == len(found)] = 0
            out.append(at[found[at] == r] if len(found) else at[:0])
        return _Rows(out)

    pos, unl = columns(positive), columns(unlabelled)
    n_pos, n_unl = min(config.batch, len(positive)), min(config.batch, len(unlabelled))
    rng = np.random.default_rng(config.seed)
    # weights and bias are one vector; moments are Adam's
    w = np.append(np.zeros(len(found)), math.log(prior / (1 - prior)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    steps = math.ceil(len(unlabelled) / config.batch) * config.epochs if positive else 0
    for step in range(1, steps + 1):
        pc, pr = pos.take(rng.integers(0, len(positive), n_pos))
        uc, ur = unl.take(rng.integers(0, len(unlabelled), n_unl))
        sp = _sigmoid(np.bincount(pr, w[pc], n_pos) + w[-1])
        su = _sigmoid(np.bincount(ur, w[uc], n_unl) + w[-1])
        slope_p, slope_u = slopes(sp, su, prior, config)
        grad = np.append(np.bincount(pc, slope_p[pr], len(found)) + np.bincount(uc, slope_u[ur], len(found)), slope_p.sum() + slope_u.sum())
        grad[:-1] += config.decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w, b = w[:-1], float(w[-1])
    return Model(found, w, b, prior)


def sample(docs: DataFrame, labels: DataFrame, config: NnPU, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, list, float]:
    """Feature rows of the sampled toxic and unlabelled texts, and the prior among labelled rows.

    Sizes are bounded in expectation by the configuration; ids come from the training fold alone. The ids of the
    sampled toxic rows (at most about ``max_positive``) are broadcast, so that no text is shuffled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    rest = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).agg(F.count(F.lit(1))).first()[0]
    share_p = min(1.0, config.max_positive / max(toxic, 1))
    share_u = min(1.0, config.max_unlabelled / max(rest, 1))
    chosen = known.where((F.col("toxic") == 1) & (unit_hash(F.col("__id"), "toxic") < share_p)).select("__id", F.lit(True).alias("__toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).where(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    rows = rows.join(F.broadcast(chosen), "__id", "left").withColumn("__toxic", F.coalesce("__toxic", F.lit(False)))
    rows = rows.withColumn("__free", unit_hash(F.col("__id"), "free") < share_u).where("__toxic or __free")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sorted({key(f) for f in features(t)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__toxic"), b.column("__free"), pa.array(keys, pa.list_(pa.int64()))], names=["p", "u", "keys"])

    got = rows.select("text", "__toxic", "__free").mapInArrow(run, "p boolean, u boolean, keys array<long>").toArrow()
    arrays = [x.values.to_numpy() for x in got.column("keys").combine_chunks()] if got.num_rows else []
    p, u = got.column("p").to_pylist(), got.column("u").to_pylist()
    prior = min(max(toxic / n if n else 0.0, config.prior_floor), 0.5)
    return [a for a, x in zip(arrays, p) if x], [a for a, x in zip(arrays, u) if x], prior


def fit(docs: DataFrame, labels: DataFrame, config: NnPU = NnPU(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    positive, unlabelled, prior = sample(docs, labels, config, id_col, text_col)
    return train(positive, unlabelled, prior, config)


class _Memo(dict):
    """Weight of a feature string, hashed once."""

    def __init__(self, table: dict[int, float]):
        self.table = table

    def __missing__(self, feature: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        w = self[feature] = self.table.get(key(feature), 0.0)
        return w


def with_scores(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 of its whole text.

    Null and empty texts get the score of a text without words. Without toxic texts to learn from every score is the
    prior. Rows keep their number and their other columns; a column that has the score's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, weights, bias = sent.value
        memo = _Memo(dict(zip(keys.tolist(), weights.tolist())))
        look = memo.__getitem__
        for texts in batches:
            z = np.array([bias + math.fsum(map(look, features(t))) for t in texts], dtype=float)
            yield pd.Series(_sigmoid(z))

    return docs.withColumn(name, score(F.col(text_col)))
