"""Exact top-k search by inner product over KD-trees, one tree per shard.

Vectors are dealt into shards of about ``SHARD`` rows by a hash of their id, so equal vectors spread evenly. A shard's
tree splits at the median of its widest component; every node keeps the tight bounding box of its points. For a query q
no point of a box scores over sum_i max(q_i low_i, q_i high_i), and a best-first traversal (highest bound first) stops
once that bound is under the query's k-th score. The k-th score travels: each query first searches its own shard, and
takes the score found there to all others, which then open only boxes that can still matter.

Each search is one shuffle: a shard's points come before its queries in a sorted partition, so that a task builds a
shard's tree once and streams the queries past it. Memory holds one shard and one batch of queries. In high dimensions
boxes prune little; then a traversal costs what a scan by matrix products costs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage

SHARD, LEAF = 16_384, 256


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, vec): floor(scale * x) of each component as packed 64-bit integers.

    Vectors that are null or empty, or hold null, NaN or infinite components, take no part, nor do null ids, nor
    vectors with a component whose floor is beyond 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * x)
                good = np.abs(x) < 2.0**63  # false for NaN and infinity
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & ids.is_valid().to_numpy(zero_copy_only=False)
            whole = np.where(good, x, 0).astype(np.int64)
            out = [whole[e - n : e].tobytes() for e, n in zip(ends[keep].tolist(), sizes[keep].tolist())]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.array(out, pa.binary())], names=["id", "vec"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, vec binary")


def _largest(vectors: np.ndarray) -> int:
    """Largest absolute component, as a Python integer (that of -2^63 has no 64-bit one)."""
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


class Tree:
    """A KD-tree over distinct points; ids of equal points are kept together, ascending.

    ``reach`` is the largest absolute component of the queries. Scores are whole numbers: doubles hold them exactly up
    to 2^53, 64-bit integers up to 2^63, and where a score could be larger Python's integers are used.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, reach: int | None = None):
        order = np.lexsort((ids, *points.T[::-1]))
        ids, points = ids[order], points[order]
        new = np.append(True, (points[1:] != points[:-1]).any(axis=1))
        self.starts = np.append(np.flatnonzero(new), len(ids))
        self.ids, distinct = ids, points[new]
        rows, low, high, self.children = [], [], [], []
        todo = [(np.arange(len(distinct)), -1)]
        while todo:
            at, parent = todo.pop()
            box, node = distinct[at], len(rows)
            rows.append(at)
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if at.size > leaf:
                order = at[np.argsort(box[:, int(np.argmax(high[-1] - low[-1]))], kind="stable")]
                todo += [(order[: at.size // 2], node), (order[at.size // 2 :], node)]
        self.rows, self.low, self.high = rows, np.array(low, dtype=np.float64), np.array(high, dtype=np.float64)
        top = _largest(distinct)
        most = top * (top if reach is None else reach) * distinct.shape[1]
        self.scale = float(top)
        self.kind = np.float64 if most < 2**52 else np.int64 if most < 2**63 else object
        self.points = [None if c else distinct[r].astype(self.kind) for r, c in zip(rows, self.children)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest score that a point of each node's box can have with each query."""
        q = queries.astype(np.float64)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: float, own: int | None = None, owned: int = 0) -> list[tuple[int, int]]:
        """The best k (score, -id) pairs that reach ``floor``, ties to smaller ids; not of id ``own``, which has ``owned`` points."""
        best: list[tuple[int, int]] = []
        q = query.astype(self.kind)
        queue = [(-bounds[0], 0)]
        # bounds are doubles; as sums of products they may be off by rounding
        slack = 1e-9 * self.scale * float(np.abs(query.astype(np.float64)).sum())
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound + slack < floor:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bounds[c] + slack >= floor:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            scores = self.points[node] @ q
            near = np.flatnonzero(scores >= floor)
            if near.size > k + owned:
                at = near.size - k - owned
                kth = np.sort(scores[near])[at] if self.kind is object else np.partition(scores[near], at)[at]
                near = near[scores[near] >= kth]
            for i in near.tolist():
                r = self.rows[node][i]
                ids = self.ids[self.starts[r] : self.starts[r + 1]]
                for x in (ids[ids != own] if owned else ids)[:k].tolist():
                    item = (int(scores[i]), -x)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    else:
                        break
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _unpack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.int64) for v in vectors])


class Shard:
    """One shard's points and their trees, a tree for each length of vector and reach of queries."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.trees: dict[tuple[int, int], Tree] = {}

    def add(self, points: pd.DataFrame) -> None:
        self.ids.append(points["id"].to_numpy())
        self.vectors.append(points["vec"].to_numpy())

    def tree(self, size: int, reach: int) -> Tree | None:
        # queries' reach is rounded up to a power of two, so that batches share a tree
        key = size, 1 << max(reach, 1).bit_length()
        if key not in self.trees:
            ids, vectors = np.concatenate(self.ids), np.concatenate(self.vectors)
            fit = np.array([len(v) == size for v in vectors], bool)
            self.trees[key] = Tree(ids[fit], _unpack(vectors[fit]), reach=key[1]) if fit.any() else None
        return self.trees[key]

    def search(self, queries: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
        """(query, point, score): vectors of another length than a query's are not candidates, nor are points of its id."""
        out: list[tuple[int, int, int]] = []
        sizes = queries["vec"].map(len)
        for size in sorted(set(sizes)) if self.ids else []:
            q = queries[sizes == size]
            vectors = _unpack(q["vec"])
            if (tree := self.tree(size, _largest(vectors))) is None:
                continue
            for at in range(0, len(q), 512):
                block = vectors[at : at + 512]
                limits = tree.bounds(block)
                rows = q.iloc[at : at + 512]
                for j, (own, floor, owned, times) in enumerate(zip(rows["id"].tolist(), rows["floor"].tolist(), rows["owned"].tolist(), rows["times"].tolist())):
                    found = tree.search(block[j], limits[j], k, -np.inf if np.isnan(floor) else floor, own, owned)
                    out += [(own, -x, min(max(s, -(2**63)), 2**63 - 1)) for s, x in sorted(found, reverse=True)] * times
        return out


def _searched(points: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """(query_id, vec_id, score) of every query (id, vec, owned, times, floor, shard) in its shard."""
    none = [F.lit(0).alias("owned"), F.lit(0).alias("times"), F.lit(None).cast("double").alias("floor")]
    rows = points.select("shard", F.lit(0).alias("asks"), "id", "vec", *none)
    rows = rows.unionByName(queries.select("shard", F.lit(1).alias("asks"), "id", "vec", "owned", "times", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard()
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for (at, asks), g in b.to_pandas().groupby(["shard", "asks"], sort=True):
                if at != now:
                    now, shard = at, Shard()
                if asks:
                    out += shard.search(g, k)
                else:
                    shard.add(g)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates by integer inner product, ties to smaller ids.

    Queries are the rows whose id satisfies ``is_query``; candidates are all rows but those with the query's id. Every
    row counts: a repeated candidate is found as often as it is there, and pairs of rows that share a query's id,
    repeated or with other vectors, are ranked together. Scores beyond 64 bits are ranked as such and given as the end of
    the range. With fewer than k candidates all are returned; without queries or usable vectors the result is empty;
    other columns are not read.
    """
    # of equal rows no more than k can matter to any query, so a vector that is there very often weighs little
    copies = F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times")
    distinct = cut_lineage(integer_vectors(table, id_col, vector_col).groupBy("id", "vec").agg(copies))
    n = distinct.agg(F.sum("times")).first()[0] or 0
    shards = max(1, -(-n // shard))
    distinct = distinct.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    points = distinct.select("shard", "id", "vec", F.explode(F.sequence(F.lit(1), F.col("times"))))
    asked = distinct.where(is_query(F.col("id")))
    # all vectors of an id are in its shard; a query's own are no candidates there
    queries = asked.join(asked.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("owned")), "id")
    home = cut_lineage(_searched(points, queries.withColumn("floor", F.lit(None).cast("double")), k, shards))
    every = home
    if shards > 1:
        kth = home.withColumn("r", F.row_number().over(_ranking())).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array("shard"))).alias("shard")
        away = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "vec", F.lit(0).alias("owned"), "times", "floor", others)
        every = home.unionByName(_searched(points, away, k, shards))
    ranked = every.withColumn("rank", F.row_number().over(_ranking())).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranking():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
