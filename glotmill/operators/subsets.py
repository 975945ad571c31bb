"""Named subsets, matched controls and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill.operators.lineage import kept

GROUPS = ("pure_vi", "english_mixed", "teencode_slang", "emoji_only", "other_noise")
PREFERRED = ("all", "cs_strict", "cs_broad", "cs_heavy", "cs_light", "english_mixed", "chinese_mixed", "translit_only", "teencode_slang", "emoji_only", "other_noise", "pure_vi", "control_pure_vi", "cs_rule")


class Registry:
    """Names for predicates. A predicate is a function of the frame, so that missing columns can stand for False."""

    def __init__(self):
        has = lambda df, c, other=None: F.col(c) if c in df.columns else (F.lit(False) if other is None else other)
        self.rules: dict[str, Callable[[DataFrame], Column]] = {
            "all": lambda df: F.lit(True), **{g: (lambda df, g=g: F.col("cs_group") == g) for g in GROUPS},
            "cs_strict": lambda df: F.col("is_cs_strict"), "cs_broad": lambda df: has(df, "is_cs_broad", F.col("is_cs_strict")),
            "cs_heavy": lambda df: F.col("cs_level") == "heavy", "cs_light": lambda df: F.col("cs_level") == "light",
            "control_pure_vi": lambda df: has(df, "control_pure_vi"), "chinese_mixed": lambda df: F.col("cs_group") == "chinese_mixed",
            "translit_only": lambda df: F.col("n_translit") > 0 if "n_translit" in df.columns else F.lit(False), "cs_rule": lambda df: has(df, "is_cs_rule"),
        }

    def register(self, name: str, rule: Callable[[DataFrame], Column]) -> None:
        self.rules[name] = rule

    def mask(self, df: DataFrame, spec) -> Column:
        """P5: a callable, a registered name, a boolean column, or a SQL expression; null is False."""
        if callable(spec) and not isinstance(spec, Column):
            found = spec(df)
        elif isinstance(spec, Column):
            found = spec
        elif spec in self.rules:
            found = self.rules[spec](df)
        elif spec in df.columns and dict(df.dtypes)[spec] == "boolean":
            found = F.col(spec)
        else:
            found = F.expr(spec)
        return F.coalesce(found.cast("boolean"), F.lit(False))


TIERS = ("all", "pure_vi", "english_mixed", "teencode_slang", "emoji_only", "other_noise", "cs_strict", "cs_broad", "cs_heavy", "cs_light")


def tiers_of(df: DataFrame, names=TIERS, registry: Registry | None = None) -> Column:
    """The subsets that a row belongs to, as an array: one pass serves all of them."""
    r = registry or Registry()
    return F.array_compact(F.array(*[F.when(r.mask(df, n), F.lit(n)) for n in names]))


def in_tiers(df: DataFrame, names=TIERS, registry: Registry | None = None) -> DataFrame:
    return df.withColumn("subset", F.explode(tiers_of(df, names, registry)))


def shuffled(id_col: str, seed: int) -> Column:
    """A reproducible order that does not depend on partitions or on the engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


BINS = 4096


def first_in_order(rows: DataFrame, keys: list[str], wanted: DataFrame, n: str, hash_col: str = "h", id_col: str = "__id") -> DataFrame:
    """``rows`` of the keys in ``wanted`` with ``taken``: whether they are among the first ``n`` of their key by hash, then id.

    A distributed selection: rows are counted by key and hash prefix (``BINS`` of them), which tells in which prefix a
    key's number is reached, and only that prefix's rows are sorted. No task sorts a whole key. ``hash_col`` is a
    hexadecimal digest; keys of ``wanted`` are unique and none is null.
    """
    binned = rows.withColumn("__bin", F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int"))
    wanted = wanted.select(*keys, F.col(n).alias("__wanted"))
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bin")))
    last = upto.join(wanted, keys).groupBy(*keys, "__wanted").agg(
        F.coalesce(F.min(F.when(F.col("__upto") > F.col("__wanted"), F.col("__bin"))), F.lit(BINS)).alias("__last"),
        F.coalesce(F.max(F.when(F.col("__upto") <= F.col("__wanted"), F.col("__upto"))), F.lit(0)).alias("__before"),
    )
    placed = binned.join(F.broadcast(last), keys)
    sure = placed.where(F.col("__bin") != F.col("__last")).withColumn("taken", F.col("__bin") < F.col("__last"))
    edge = placed.where(F.col("__bin") == F.col("__last")).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__last").orderBy(hash_col, id_col)))
    edge = edge.withColumn("taken", F.col("__before") + F.col("__r") <= F.col("__wanted")).drop("__r")
    return sure.unionByName(edge).select(*rows.columns, "taken")


def matched_control(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Adds ``control_pure_vi``, pure rows that match the code-switched ones in number and label, by split.

    Per split the target is min(code-switched, pure). Each primary label gives round-half-even(share x target) rows of
    its pure rows, as far as they go; a deficit is made up from the remaining pure rows. Rounding can give more than the
    target. Rows are chosen by a hash of the id, by distributed selection (``first_in_order``); only ids, splits and
    labels of pure rows move. Splits and labels are few, so their tables are broadcast.
    """
    counts = df.groupBy("split").agg(F.count_if("is_cs_strict").alias("cs"), F.count_if(F.col("cs_group") == "pure_vi").alias("pure")).withColumn("target", F.least("cs", "pure")).where("target > 0")
    labels = df.where("is_cs_strict").groupBy("split", "primary_label").agg(F.count(F.lit(1)).alias("n_label"))
    quota = labels.join(counts, "split").select("split", "primary_label", F.bround(F.col("n_label") / F.col("cs") * F.col("target")).cast("int").alias("quota"))
    pure = df.where(F.col("cs_group") == "pure_vi").select(F.col(id_col).alias("__id"), "split", "primary_label", shuffled(id_col, seed).alias("h"))
    pure, counts = kept(pure), kept(counts)
    # labels that no code-switched row has give none, but may fill the deficit
    every = pure.select("split", "primary_label").distinct().join(quota, ["split", "primary_label"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    chosen = kept(first_in_order(pure, ["split", "primary_label"], every, "quota"))
    need = chosen.groupBy("split").agg(F.count_if("taken").alias("n_taken")).join(counts, "split").select("split", (F.col("target") - F.col("n_taken")).alias("deficit")).where("deficit > 0")
    rest = first_in_order(chosen.where("not taken").drop("taken"), ["split"], need, "deficit").where("taken")
    both = chosen.where("taken").join(F.broadcast(counts.select("split")), "split", "left_semi").select("__id").unionByName(rest.select("__id")).withColumn("control_pure_vi", F.lit(True))
    return df.join(both, df[id_col] == both["__id"], "left").drop("__id").withColumn("control_pure_vi", F.coalesce("control_pure_vi", F.lit(False)))


def stratified_sample(df: DataFrame, per_group: int = 40, group: str = "cs_group", id_col: str = "id", seed: int = 42) -> DataFrame:
    """At most ``per_group`` rows of each group (a partial limit runs before the shuffle)."""
    w = Window.partitionBy(group).orderBy(shuffled(id_col, seed), id_col)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_group).drop("__r")


def review_sample(df: DataFrame, n: int = 200, low: int = 40, groups: int | None = None, id_col: str = "id", seed: int = 42) -> DataFrame:
    """An equal share of each group and some rows of low confidence, without repeats, with empty gold columns."""
    k = n // max(groups if groups is not None else df.select(F.count_distinct("cs_group")).first()[0], 1)
    w = Window.partitionBy("cs_group").orderBy(shuffled(id_col, seed), id_col)
    first = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
    weak = df.where(F.col("llm_confidence").between(0.01, 0.7)).orderBy(shuffled(id_col, seed + 1), id_col).limit(low)
    # of a row taken twice the group's share comes first, as where the two are read one after the other
    both = first.withColumn("__part", F.lit(0)).unionByName(weak.withColumn("__part", F.lit(1)))
    once = both.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy("__part", "cs_group"))).where(F.col("__r") == 1).drop("__part", "__r")
    return once.withColumns({"gold_has_cs": F.lit(""), "gold_lang": F.lit(""), "note": F.lit("")})


def disagreements(df: DataFrame, rule: str = "is_cs_rule", llm: str = "is_cs_strict", n: int = 200, id_col: str = "id") -> dict[str, DataFrame]:
    """The first rows of each kind of disagreement, and rows with Chinese or transliterated tokens."""
    a, b = F.coalesce(F.col(rule), F.lit(False)), F.coalesce(F.col(llm), F.lit(False))
    kinds = {"llm_only": b & ~a, "rule_only": a & ~b, "chinese": F.col("n_chinese") > 0, "translit": F.col("n_translit") > 0}
    return {k: df.where(c).orderBy(id_col).limit(n) for k, c in kinds.items()}
