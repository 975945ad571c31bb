"""Summaries, cross-tabulations, label distributions and top tokens (A1 to A19, K3's index, W3 to W5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.lexicon import LABELS
from glotmill.operators.subsets import TIERS, in_tiers


def _percent(n: str, of: str = "n") -> Column:
    return 100 * F.col(n) / F.col(of)


def summary_v2(df: DataFrame) -> DataFrame:
    """A1."""
    flags = {"cs_strict": "is_cs_strict", "cs_broad": "is_cs_broad", "has_english": "has_english", "has_teencode": "has_teencode", "has_emoji": "has_emoji"}
    out = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(a) for a, c in flags.items()], F.count_if(F.col("n_laugh") > 0).alias("has_laugh"),
        F.avg("english_ratio").alias("avg_english_ratio"), F.avg("teencode_ratio").alias("avg_teencode_ratio"), F.avg("n_word_tokens").alias("avg_word_tokens"),
    )
    return out.withColumns({f"{a}_pct": _percent(a) for a in flags})


def summary_v1(df: DataFrame) -> DataFrame:
    """A2."""
    flags = {"code_switched": "is_code_switched", "has_english": "has_english", "has_chinese": "has_chinese", "has_other_foreign": "has_other_foreign"}
    out = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(a) for a, c in flags.items()], F.avg("english_ratio").alias("avg_english_ratio"))
    return out.withColumns({f"{a}_pct": _percent(a) for a in flags})


def summary_v3(df: DataFrame) -> DataFrame:
    """A3."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_cs_strict").alias("cs"), F.count_if("is_cs_rule").alias("cs_rule"), F.count_if(F.col("n_chinese") > 0).alias("chinese"),
        F.count_if(F.col("n_translit") > 0).alias("translit"), F.avg("llm_confidence").alias("avg_confidence"),
    )


def rule_against_llm(df: DataFrame) -> DataFrame:
    """Totals of both annotators and their signed difference."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_cs_rule").alias("rule"), F.count_if("is_cs_strict").alias("llm")).withColumn("difference", F.col("llm") - F.col("rule"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str] | None = None) -> DataFrame:
    """A4: counts with margins named All, from one cube; cells without rows are 0."""
    cube = df.cube(rows, columns).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("gr"), F.grouping(columns).alias("gc"))
    named = cube.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(rows)).alias(rows), F.when(F.col("gc") == 1, "All").otherwise(F.col(columns)).alias("__c"), "n")
    return named.groupBy(rows).pivot("__c", values and [*values, "All"]).agg(F.first("n")).na.fill(0)


def label_distribution(df: DataFrame, labels: str = "label_ids", names: list[str] = LABELS, tiers=("all", "cs_strict", "cs_broad", "pure_vi")) -> DataFrame:
    """A5: tier, label_id, label, support, ratio, n_tier for every tier and label; empty ones are 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, i, n) for t in tiers for i, n in enumerate(names)], "subset string, label_id int, label string")
    rows = in_tiers(df, tiers).select("subset", labels)
    support = rows.select("subset", F.explode(F.array_distinct(labels)).alias("label_id")).groupBy("subset", "label_id").agg(F.count(F.lit(1)).alias("support"))
    totals = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n_tier"))
    # both aggregates have at most tiers x labels rows
    out = grid.join(support, ["subset", "label_id"], "left").join(totals, "subset", "left").na.fill(0, ["support", "n_tier"])
    return out.withColumn("ratio", F.when(F.col("n_tier") > 0, F.col("support") / F.col("n_tier")).otherwise(0.0))


def label_shift(distribution: DataFrame) -> DataFrame:
    """A6."""
    tiers = ["all", "cs_strict", "cs_broad", "pure_vi"]
    wide = distribution.groupBy("label_id", "label").pivot("subset", tiers).agg(F.first("ratio"))
    return wide.withColumn("cs_minus_pure", F.col("cs_strict") - F.col("pure_vi")).orderBy(F.desc("cs_minus_pure"), "label_id")


def by_label(df: DataFrame, label_list: str = "label_list") -> DataFrame:
    """Rows per label; rows without labels stand under ``nan``."""
    rows = df.withColumn("label", F.explode_outer(label_list)).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("nan")))
    out = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_code_switched").alias("code_switched"), F.count_if("has_english").alias("english_mixed"), F.count_if("has_chinese").alias("chinese_mixed"))
    return out.withColumn("code_switched_pct", F.col("code_switched") / F.col("n") * 100).orderBy(F.desc("code_switched_pct"), F.desc("n"), "label")


def top_tokens(df: DataFrame, column: str, k: int = 200, separator: str = r"\s+", lower: bool = False) -> DataFrame:
    """The commonest tokens of a joined-token column; ties by token."""
    parts = F.transform(F.split(F.col(column), separator), lambda t: F.trim(t))
    token = F.explode(F.filter(parts, lambda t: t != ""))
    rows = df.select(token.alias("token"))
    rows = rows.withColumn("token", F.lower("token")) if lower else rows
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "token").limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares; the groups are summed over their counts, not over the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def tier_index(df: DataFrame, n_labels: str = "n_labels", tiers=TIERS) -> DataFrame:
    """K3: subset, split, n, pct_of_split, avg_tokens, avg_english_ratio, avg_labels_per_sample."""
    out = in_tiers(df, tiers).groupBy("subset", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("n_word_tokens").alias("avg_tokens"), F.avg("english_ratio").alias("avg_english_ratio"), F.avg(n_labels).alias("avg_labels_per_sample"))
    total = F.max(F.when(F.col("subset") == "all", F.col("n"))).over(Window.partitionBy("split"))
    return out.withColumn("pct_of_split", 100 * F.col("n") / F.greatest(total, F.lit(1)))


def subset_sizes(df: DataFrame, tiers=TIERS, splits=("train", "val", "test")) -> DataFrame:
    """A18."""
    return in_tiers(df, tiers).groupBy("subset").agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits], F.count(F.lit(1)).alias("total"))


def length_coverage(df: DataFrame, text_col: str = "text", limit: int = 200, width: int = 50, top: int = 1000) -> DataFrame:
    """Histogram of lengths with the share of texts up to ``limit`` characters."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    bucket = F.least(F.floor(size / width), F.lit(top // width)).cast("int")
    hist = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(size <= limit).alias("n_short"))
    whole = Window.partitionBy(F.lit(0))  # at most top / width + 1 rows
    return hist.select("bucket", "n", (F.sum("n_short").over(whole) / F.sum("n").over(whole)).alias("share_short"))


def pairwise_equality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per pair of columns the share and number of rows that differ, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(f"e{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"e{i}").alias("equal"), "n") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumns({"share": F.col("equal") / F.col("n"), "changed": F.col("n") - F.col("equal")})


def dense_tags(df: DataFrame, tag: str = "tag", order: str = "path") -> DataFrame:
    """The second use of a tag becomes ``tag-2``, the third ``tag-3``."""
    r = F.row_number().over(Window.partitionBy(tag).orderBy(order))
    return df.withColumn("__r", r).withColumn(tag, F.when(F.col("__r") > 1, F.concat_ws("-", tag, "__r")).otherwise(F.col(tag))).drop("__r")
