"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its size is the number of copies that each of its words should have. Whole copies are certain;
the fraction is an inclusion probability p. A document draws u in (0, 1) and is ranked by (u / (1 - u)) / (p / (1 - p)),
its random odds over its inclusion odds; the sample is the first documents in that order whose words make up the rest of
the target. With a ``preference`` p differs between documents, and preferred ones rank earlier.

No task sees a whole source. Ranks fall into ``BINS`` bins; sums of words by (source, bin), combined before the shuffle,
tell in which bin a source's target is reached, and only that bin is ordered row by row. A long document at the end
would leave a gap, so later bins fill it in ``ROUNDS`` rounds with documents that still fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage

BINS, ROUNDS, WEIGHTS, SHARE, MOST = 4096, 3, (3, 1, 2), 1.5, 2
#: Up to so many sources their table is sent to all tasks; beyond, rows meet it in a join with salt.
FEW_SOURCES, SALTS = 20_000, 16

WORD = r"[^\x20\x09-\x0D]+"


def weighted_sources(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: ``weights`` in turn over the sources by code point, null last. Sources are sorted in ranges."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    placed = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # as many rows as ranges
    before = before.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = F.pmod(F.col("at") + F.col("before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), index.cast("int") + 1)
    return placed.join(F.broadcast(before), "part").withColumn("weight", weight).drop("part", "at", "before")


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes by weight, at most ``most`` sizes each.

    What full sources leave is shared by the others' weights, until none is above. The driver sees sums only.
    """
    full = F.lit(False)
    known, each, capped = F.col("source_size"), 0.0, -1
    while True:
        total, rest, words, n = sources.agg(F.sum(known), F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, known)), F.count_if(full)).first()
        if n == capped or not rest:
            break
        capped, each = n, (share * (total or 0) - most * (words or 0)) / rest
        full = F.col("weight") * F.lit(each) > most * known
    return sources.withColumn("target", F.when(full, most * known.cast("double")).otherwise(F.col("weight") * F.lit(each)))


def _drawn(id_col: str, seed: int) -> Column:
    """A number in (0, 1) of 52 bits that a hash of the id gives, in any engine."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 52))


def _by_source(n_sources: int):
    """A join of rows with a table that has one row a source: sent to all tasks if small, else met by salt."""

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(F.col("source").alias("__s"), *[c for c in right.columns if c != "source"])
        if n_sources <= FEW_SOURCES:
            return left.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        left = left.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "u"), F.lit(SALTS)))
        right = right.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__salt") == F.col("__to"))).drop("__s", "__to", "__salt")

    return joined


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: Column | None = None, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: how many words of each document the mix takes.

    Size is the number of words (null text: 0). ``copies`` is the number of times that the document is taken whole, so
    ``taken`` = copies x size. Equal ranks are ordered by id (null first), then size; rows that repeat both are sampled
    one by one and cannot be told apart in the result. Documents of size 0 have ``taken`` 0. Reruns and other
    partitionings agree. ``preference`` (positive; null is 1) makes documents likelier. Null sources are a source, an
    empty table gives an empty result, other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    liked = F.greatest(F.coalesce(F.lit(1.0) if preference is None else preference.cast("double"), F.lit(1.0)), F.lit(1e-9))
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _drawn(id_col, seed).alias("u"), liked.alias("liked")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liked")).alias("liked_size"))
    sources = cut_lineage(with_targets(weighted_sources(sources, weights), share, most))
    copies = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    sources = sources.withColumn("whole", F.coalesce(F.floor(copies), F.lit(0)).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    joined = _by_source(sources.count())
    # inclusion probabilities follow the preference and add up to the rest
    ranked = joined(rows, sources.select("source", "source_size", "target", "whole", (F.col("rest") / F.when(F.col("liked_size") > 0, F.col("liked_size"))).alias("__p")))
    p = F.least(F.greatest(F.coalesce(F.col("__p") * F.col("liked"), F.lit(0.0)), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    ranked = ranked.withColumn("rank", odds).withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)).cast("int")).drop("__p", "liked")
    # a source's state: the first bin that is open, words still wanted, and the largest document that may be taken
    state = sources.select("source", F.lit(0).alias("open"), F.col("rest").alias("gap"), F.lit(1 << 62).alias("limit"))
    taken, bounds = [], sources.select("source")
    for i in range(rounds):
        state, now, edge = _round(ranked, state, joined)
        taken.append(edge)
        named = now.select(F.col("source").alias(f"__{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("open", "limit", "stop")])
        bounds = bounds.join(named, F.col("source").eqNullSafe(F.col(f"__{i}"))).drop(f"__{i}")
    fits = lambda i, upto: (F.col("bin") >= F.col(f"open{i}")) & upto & (F.col("size") <= F.col(f"limit{i}"))
    within = [fits(i, F.col("bin") < F.col(f"stop{i}")) for i in range(rounds)]
    at_edge = [fits(i, F.col("bin") == F.col(f"stop{i}")) for i in range(rounds)]
    plain = joined(ranked, cut_lineage(bounds)).where(~reduce(Column.__or__, at_edge)).withColumn("drawn", reduce(Column.__or__, within))
    columns = ["doc_id", "size", "source_size", "target", "whole", "drawn", "source"]
    every = reduce(DataFrame.unionByName, [edge.select(*columns) for edge in taken], plain.select(*columns))
    n = F.col("whole") + F.col("drawn").cast("int")
    return every.select("doc_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"), "source", n.alias("copies"))


def _round(ranked: DataFrame, state: DataFrame, joined) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes rows in order while they fit. Gives the next state, this one with its last bin, and that bin's rows."""
    open_rows = joined(ranked, state).where((F.col("bin") >= F.col("open")) & (F.col("size") <= F.col("limit")))
    bins = open_rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    running = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    wanted = state.select(F.col("source").alias("__s"), "gap", "open", "limit")
    # the first bin that goes over the gap, and the words before it; BINS where all fits
    over = running.join(wanted, F.col("source").eqNullSafe(F.col("__s")), "right").groupBy(F.col("__s").alias("source"), "gap", "open", "limit").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("gap"), F.col("bin"))), F.lit(BINS)).alias("stop"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.lit(0)).alias("before"),
    )
    now = cut_lineage(over)
    last = joined(ranked, now).where((F.col("bin") == F.col("stop")) & (F.col("bin") >= F.col("open")) & (F.col("size") <= F.col("limit")))
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = last.withColumn("upto", F.col("before") + F.sum("size").over(order)).withColumn("drawn", F.col("upto") <= F.col("gap"))
    edge = cut_lineage(edge.drop("open", "limit"))
    most = edge.where("drawn").groupBy(F.col("source").alias("__e")).agg(F.max("upto").alias("most"))
    left = now.join(most, F.col("source").eqNullSafe(F.col("__e")), "left")
    gap = F.col("gap") - F.coalesce("most", "before")
    after = left.select("source", (F.col("stop") + 1).alias("open"), gap.alias("gap"), F.floor(gap).alias("limit"))
    return after, now, edge
