"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every file is content-addressed (SHA-256). The ledger holds the (blob, rule, version) triples that were
scanned already, with what they found; a run scans each blob that has an unseen triple once, however many paths hold it,
appends to the ledger and joins the findings back to all paths. One text held by a third of all rows therefore costs one
scan: map tasks send one row per blob, and the join back to paths is salted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage
from glotmill.llm.spans import SPAN, find_spans

SALTS = 16
FEW = 100_000  # unseen blobs (hash and rule names, about 100 bytes) that are broadcast


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    keep: Callable[[Column, Column], Column] | None = None
    base: bool = True
    lead: str = ""  # where a span starts, if the pattern passes over something first


#: Fixed patterns of the contract (assign, access, hex), then the rules this operator adds. A run of hex digits, or of
#: capitals and digits after AKIA, is either long enough as a whole or at none of its starts, so that the length can
#: stand in the pattern; an assignment's cannot, because a match that fails still uses up its text.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, keep=lambda m, part: F.length(part) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    # of several eyJ in a run the first decides, as the run ends for all of them alike; so each run is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", base=False, lead="eyJ"),
)


SEEN = "blob string, rule string, version int, spans " + SPAN


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return ledger.where(F.concat_ws("@", "rule", "version").isin([f"{r.kind}@{r.version}" for r in rules]))


def pending_blobs(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): blobs with the rules that ``ledger`` does not hold in their version. Only hashes are shuffled."""
    blobs = versions.select(_blob(_text(text_col)).alias("blob")).distinct()
    seen = _current(ledger, rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    todo = F.array_except(every, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan_blobs(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, version, spans) for each pair of a blob and a rule version that ``ledger`` does not hold.

    ``ledger`` has blob, rule, version and spans, as returned by earlier calls; append the result to it. A rule whose
    version rose is run again on every blob, and only that rule. Null texts count as the empty blob. What is unseen is
    decided by hashes; up to ``FEW`` unseen blobs are sent to the tasks, so that no other text leaves its task.
    """
    rows = versions.select(_blob(_text(text_col)).alias("blob"), _text(text_col).alias("text"))
    first = lambda df, *more: df.groupBy("blob").agg(F.first("text").alias("text"), *more)
    if ledger is None:
        todo = first(rows).withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pending = cut_lineage(pending_blobs(versions, ledger, text_col, rules))
        if pending.count() <= FEW:
            todo = first(rows.join(F.broadcast(pending), "blob"), F.first("todo").alias("todo"))
        else:
            todo = first(rows).join(pending, "blob")
    none = F.expr(f"cast(null as {SPAN})")
    found = todo.select(
        "blob",
        F.array(
            *[
                F.struct(
                    F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                    F.when(F.array_contains("todo", r.kind), find_spans(F.col("text"), r.kind, i, r.pattern, r.keep, r.group, r.lead)).otherwise(none).alias("spans"),
                )
                for i, r in enumerate(rules)
            ]
        ).alias("runs"),
    )
    return found.select("blob", F.explode(F.filter("runs", lambda r: r["spans"].isNotNull())).alias("run")).select("blob", "run.*")


def update_ledger(versions: DataFrame, folder: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger in ``folder`` (Parquet, in shared storage; may not exist yet) has not seen, appends it, and
    returns the whole ledger. A run that fails appends nothing; run it again.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(SEEN).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan_blobs(versions, text_col, ledger, rules).write.mode("append").parquet(folder)
    return spark.read.schema(SEEN).parquet(folder)


def secrets_by_path(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``versions``: path, blob and all spans of its text by start, then rule order.

    Findings come from ``ledger`` where it has them and from a scan of the rest. Repeated rows and null paths keep
    their rows; null and empty texts have no spans; an empty table gives an empty result; further columns of
    ``versions`` are not read.
    """
    fresh = scan_blobs(versions, text_col, ledger, rules)
    return findings_by_path(versions, fresh if ledger is None else fresh.unionByName(_current(ledger, rules).select("blob", "rule", "version", "spans")), path_col, text_col, rules)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Joins the findings of a ledger that has seen all of ``versions`` back to all their rows, as ``secrets_by_path``."""
    # a triple that two runs appended counts once; blobs without findings need no row
    once = _current(ledger, rules).where(F.size("spans") > 0).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
    found = once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # the few blobs with findings are repeated for each salt, so that the paths of one blob spread over tasks
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = versions.select(F.col(path_col).alias("path"), _blob(_text(text_col)).alias("blob"))
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return paths.join(found, ["blob", "salt"], "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))
