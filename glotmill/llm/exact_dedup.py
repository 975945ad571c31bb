"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Copies fall together in three steps, and each step groups by the content itself beside its digest:

1. within a map task (Spark's partial aggregation), so that of a text held a million times each task sends one row;
2. over (digest, salt), so that one hot text is met by ``SALTS`` tasks rather than one;
3. over the digest alone, where one winner of each salt, at most ``SALTS`` a text, is left.

Memory: one task holds distinct contents only, and Spark's aggregation spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import BLANKS, cut_lineage

SALTS, HOT, STEP = 16, 1000, 10_000


def with_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, chars, content, digest): content is the text without white space; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, BLANKS, "")
    return docs.select(F.col(id_col).alias("doc"), F.length(text).alias("chars"), content.alias("content")).withColumn(
        "digest", F.sha2(F.col("content").cast("binary"), 256)
    )


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct content: digest, check (a second hash) and size of it, keep_chars, keep_id, group_size."""
    rows = with_content(docs, id_col, text_col)
    # of the largest struct the row with most characters comes first, then the smallest id; a null id loses
    best = F.max(F.struct("chars", F.col("doc").isNotNull().alias("known"), (-F.col("doc")).alias("low"), "doc")).alias("best")
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"), "content").agg(best, F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    return merged.select(
        F.col("digest").alias("w_digest"), F.xxhash64("content").alias("w_check"), F.length("content").alias("w_size"),
        F.col("best.chars").alias("keep_chars"), F.col("best.doc").alias("keep_id"), "group_size",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points,
    then the smallest id, stays. Null and empty texts are one group. Rows that repeat an id with a text of the same
    length and content are equal in every column here; of such rows that win, one is kept. A row with a null id stays
    only if its whole group has null ids. An empty table gives an empty result; other columns of ``docs`` are not read,
    so their names cannot clash.
    """
    small = with_content(docs, id_col, text_col).select(
        "doc", "chars", "digest", F.xxhash64("content").alias("check"), F.length("content").alias("size")
    )
    w = cut_lineage(winners(docs, id_col, text_col))
    total = w.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # at most HOT groups hold a share of 1 / HOT of the rows; these few are known to all tasks and meet their rows by salt
    hot = F.col("group_size") * HOT >= total
    small = small.join(F.broadcast(w.where(hot).select(F.col("w_digest").alias("digest"), F.lit(True).alias("hot")).distinct()), "digest", "left")
    small = small.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    w = w.withColumn("w_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    same = (F.col("digest") == F.col("w_digest")) & (F.col("check") == F.col("w_check")) & (F.col("size") == F.col("w_size")) & (F.col("salt") == F.col("w_salt"))
    found = small.join(w, same, "inner").select(
        F.col("doc").alias("doc_id"), "keep_id", "group_size",
        (F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("best"),
        F.col("digest").alias("text_sha256"),
    )
    # equal rows are counted, and told out again with the first of the best kept; in steps, so that no array grows with them
    counted = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {STEP}"))))
    each = counted.withColumn("i", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("n"), (F.col("step") + 1) * STEP) - 1)))
    return each.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("i") == 0)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    The semi join's key (id, length and content hash of the row that stays) is unique, so a group of copies that holds
    a third of all rows puts no weight on one task. Rows that repeat an id with other content are told apart; of those
    that repeat id, length and content one stays, whichever it is.
    """
    docs = without_repeats(docs, id_col, text_col)
    keep = winners(docs, id_col, text_col).select(F.col("keep_id").alias("__keep"), F.col("keep_chars").alias("__chars"), F.col("w_check").alias("__check"))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = (F.length(text) == F.col("__chars")) & (F.xxhash64(F.regexp_replace(text, BLANKS, "")) == F.col("__check"))
    return docs.join(keep, docs[id_col].eqNullSafe(F.col("__keep")) & same, "left_semi")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of those that have the same id (null ids too), length and content, whichever it is.

    Repeats are counted by narrow keys; only rows that have any are grouped with all their columns, after map tasks
    have combined their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, BLANKS, "")
    keys = {"__id": F.col(id_col), "__chars": F.length(text), "__check": F.xxhash64(content), "__check2": F.crc32(content.cast("binary"))}
    repeated = cut_lineage(docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if repeated.isEmpty():
        return docs
    r = repeated.select(*[F.col(k).alias(f"{k}_r") for k in keys])
    keyed = docs.withColumns(keys)
    same = F.lit(True)
    for k in keys:
        same &= keyed[k].eqNullSafe(r[f"{k}_r"])
    once = keyed.join(r, same, "left_semi").dropDuplicates(list(keys))
    return keyed.join(r, same, "left_anti").unionByName(once).select(*docs.columns)
