"""Connected components by alternating large-star and small-star steps.

Links never leave the cluster; each round is two aggregations and joins, and rounds grow with the logarithm of the
longest path. Hubs are safe: the minimum over a node's neighbours is combined before the shuffle, and the joins back to
the neighbours are sort-merge joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage_counted


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(lowest, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """True if every node stands on one side only and every u once, so that each edge points to its root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    known = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count_if(F.col("up") == 0).alias("downs"))
    return known.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("downs") > 0)))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Self-links and repeated links do no harm, links with a null end are dropped, and no links give no rows.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges, n = cut_lineage_counted(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # both steps keep the components and bring every node nearer to its root
    while n and not _settled(edges):
        edges, n = cut_lineage_counted(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
