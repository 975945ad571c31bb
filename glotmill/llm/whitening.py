"""Embedding whitening by a randomised range finder with power passes, and Rayleigh-Ritz.

Vectors become whole numbers, so sums, means and deviations are exact whatever the order of tasks. Components belong to
the covariance of the distinct vectors:

1. A random orthonormal basis Q of ``COMPONENTS`` + ``OVERSAMPLE`` columns is multiplied by the covariance in one pass
   over all centred rows (``covariance_times``: each task sends one matrix of dimension x columns, added up by Spark).
2. Rayleigh-Ritz: the eigenvectors of Q'VQ give estimates u and residuals |Vu - eu|. While a residual is above
   ``TOLERANCE`` times the largest eigenvalue, the product is orthonormalised and passed through once more.
3. Where that can't succeed in ``PASSES`` passes, as the residuals' rate shows (flat spectra), the basis is completed to
   the full dimension, whose one pass makes Rayleigh-Ritz exact to rounding.

The driver holds dimension x columns matrices (dimension squared at most) and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage, cut_lineage_counted

COMPONENTS, OVERSAMPLE, PASSES, TOLERANCE = 16, 10, 8, 1e-13

#: floor(scale * c) + SHIFT are the whole numbers that stand for components.
SCALE, SHIFT = 64, 1_000_000

LOW = 0xFFFFFFFF


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(64 c) + 1000000 of each component as packed 64-bit integers.

    Null or empty vectors, and those that hold null, NaN or infinite components or ones too large for 64 bits, take no
    part. Null ids and repeated rows do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            c = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(invalid="ignore", over="ignore"):
                c = np.floor(SCALE * c)
                good = np.abs(c) < 2.0**62  # false for NaN and infinity
            ends, bad = np.cumsum(sizes), np.concatenate([[0], np.cumsum(~good)])
            keep = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            x = np.where(good, c, 0).astype(np.int64) + SHIFT
            out = [x[e - n : e].tobytes() for e, n in zip(ends[keep].tolist(), sizes[keep].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(out, pa.binary())], names=["id", "x"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, x binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int64).reshape(-1, size)


def totals(distinct: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension: halves of 32 bits are summed apart, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), size)
                sums = [pa.array(range(size), pa.int32()), pa.array((x >> 32).sum(axis=0)), pa.array((x & LOW).sum(axis=0)), pa.array([b.num_rows] * size, pa.int64())]
                yield pa.RecordBatch.from_arrays(sums, names=["i", "high", "low", "n"])

    parts = distinct.select("x").mapInArrow(run, "i int, high long, low long, n long")
    found = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).collect()
    rows = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return (int(found[0]["n"]) if found else 0), [rows[i] for i in range(size)] if found else [0] * size


def centring(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the rest under one half, so that centring loses no digits."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(near, np.int64), np.array([(s - m * n) / n for s, m in zip(sums, near)])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]).astype(np.float64) - mean[1]


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A matrix from the tasks' (i, j, v) parts."""
    out = np.zeros(shape)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _entries(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(total.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])


def covariance_times(distinct: DataFrame, n: int, mean, basis: np.ndarray) -> np.ndarray:
    """Covariance x basis, in one pass over the centred rows; rows first meet the basis, so no square matrix is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for b in batches:
            c = centred(_matrix(b.column(0), len(basis)), mean) if b.num_rows else np.zeros((0, len(basis)))
            total += c.T @ (c @ basis)
        yield _entries(total)

    return _summed(distinct.select("x").mapInArrow(run, "i int, j int, v double"), basis.shape) / n


def _variance(distinct: DataFrame, n: int, mean, size: int) -> float:
    """The covariance's trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                total += float((centred(_matrix(b.column(0), size), mean) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    return (distinct.select("x").mapInArrow(run, "v double").agg(F.sum("v")).first()[0] or 0.0) / n


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalue estimates (falling), vectors and residual norms of a symmetric matrix known by its product with a basis."""
    inner = basis.T @ product
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = basis @ vectors
    return values, found, np.linalg.norm(product @ vectors - found * values, axis=0)


def leading_eigenpairs(multiply, size: int, k: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix known by ``multiply``."""
    k, width = min(k, size), min(size, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    worst = np.inf
    for done in range(1, passes + 1):
        product = multiply(basis)
        values, vectors, residuals = _ritz(basis, product)
        bound = tolerance * max(values[0], 0.0)
        now = residuals[:k].max()
        if width == size or now <= bound:
            return values[:k], vectors[:, :k]
        rate, worst = now / worst, now
        if done == passes or done > 1 and now * rate ** (passes - done) > bound:
            break
        basis = np.linalg.qr(product)[0]
    rest = np.random.default_rng(seed + 1).standard_normal((size, size - width))
    for _ in range(2):  # twice is enough for columns orthogonal to rounding
        rest -= vectors @ (vectors.T @ rest)
        rest = np.linalg.qr(rest)[0]
    basis = np.linalg.qr(np.hstack([vectors, rest]))[0]
    values, vectors, _ = _ritz(basis, multiply(basis))
    return values[:k], vectors[:, :k]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **search) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Rows that ``whole_vectors`` leaves out are not there; of the others those of the commonest length (of equally common
    ones the longest) take part. Repeated rows are returned each time but fitted once. Components whose eigenvalue is
    zero to rounding are left out, so one distinct vector gives no rows, as an empty table does. ``deviation`` beyond 64
    bits is given as the end of the range. Other columns are not read.
    """
    spark = table.sparkSession
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = cut_lineage(whole_vectors(table, id_col, vector_col))
    common = rows.groupBy(F.octet_length("x").alias("b")).count().orderBy(F.desc("count"), F.desc("b")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["b"] // 8
    rows = rows.where(F.octet_length("x") == common["b"])
    # few rows in few tasks, as every task sends a matrix at every pass
    distinct, _ = cut_lineage_counted(rows.select("x").distinct())
    n, sums = totals(distinct, size)
    mean = centring(n, sums)
    trace = _variance(distinct, n, mean, size)
    values, vectors = leading_eigenpairs(lambda basis: covariance_times(distinct, n, mean, basis), size, components, **search)
    good = values > max(trace, 0.0) * size * np.finfo(float).eps
    values, vectors = values[good], vectors[:, good]
    if not len(values):
        return spark.createDataFrame([], schema)
    onto = vectors / np.sqrt(values)
    error = _identity_error(distinct, n, mean, onto)
    explained, k = values / trace, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), size)
            w = centred(x, mean) @ onto
            m = len(x)
            out = [
                b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(np.repeat(_deviations(x, n, sums), k), pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exactly; in Python's integers only where 64 bits might not hold it."""
    off = max(max(abs(n * int(v) - s) for v in (lo, hi)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums))
    if off * off * x.shape[1] < 2**63 and max(map(abs, sums)) < 2**62 and n * int(np.abs(x).max()) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return np.array([min(v, 2**63 - 1) for v in exact], np.int64)


def _identity_error(distinct: DataFrame, n: int, mean, onto: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over the fit list."""
    size, k = onto.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = centred(_matrix(b.column(0), size), mean) @ onto
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield _entries(total)

    total = _summed(distinct.select("x").mapInArrow(run, "i int, j int, v double"), (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
