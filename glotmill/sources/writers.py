"""Writers (K1 to K11). Tables go out in parallel; only reports of a few rows pass the driver."""

from __future__ import annotations

import json
import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.operators.stats import tier_index
from glotmill.operators.subsets import TIERS, in_tiers
from glotmill.sources.workbook import FORMAT, MAX_NAME, WorkbookSource, exists


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as JSON text, for formats without nesting."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1."""
    _flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2; text stays UTF-8."""
    df.write.mode(mode).json(path)


def export_tiers(df: DataFrame, path: str, columns: list[str] | None = None, tiers=TIERS, mode: str = "errorifexists") -> DataFrame:
    """Rows of every tier by (subset, split), and the index of sizes and means, which is returned too."""
    kept = [c for c in columns if c in df.columns] if columns else [c for c in df.columns if not c.startswith("label_")]
    rows = in_tiers(df, tiers).select("subset", *dict.fromkeys([*kept, "split"]))
    rows.write.mode(mode).partitionBy("subset", "split").parquet(f"{path}/tiers")
    index = tier_index(df, tiers=tiers)
    write_csv(index, f"{path}/index", mode)
    return index


def write_by_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5: Parquet by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def run_config(df: DataFrame, arguments: dict) -> str:
    """K6: arguments, row count and group counts as JSON."""
    groups = {r[0]: r[1] for r in df.groupBy("cs_group").count().collect()}
    return json.dumps({**arguments, "n_rows": sum(groups.values()), "cs_group": groups}, ensure_ascii=False, indent=2)


def _cells(df: DataFrame, columns: list[str]) -> Column:
    """A row's cells as (kind, value): numbers, booleans, and text for all else; NaN is an empty cell."""
    out, types = [], dict(df.dtypes)
    for c in columns:
        col, t = F.col(f"`{c.replace('`', '``')}`"), types[c]
        if t.startswith(("array", "map", "struct")):
            kind, value = F.lit("s"), F.to_json(col)
        elif t in ("double", "float"):
            infinite = F.abs(col) == float("inf")
            kind, value = F.when(infinite, "s").otherwise("n"), F.when(~F.isnan(col), col.cast("string"))
        elif t in ("tinyint", "smallint", "int", "bigint") or t.startswith("decimal"):
            kind, value = F.lit("n"), col.cast("string")
        else:
            kind, value = F.lit("b" if t == "boolean" else "s"), F.base64(col) if t == "binary" else col.cast("string")
        out.append(F.struct(kind.alias("kind"), value.alias("value")))
    return F.array(*out)


def _sheet_name(name: Column) -> Column:
    """At most 31 characters, without those that the format forbids; ``unknown`` for null and empty names."""
    plain = F.substring(F.regexp_replace(F.trim(name.cast("string")), r"[\[\]:*?/\\]", "_"), 1, MAX_NAME)
    return F.when(F.length(plain) > 0, plain).otherwise("unknown")


def _save_workbooks(rows: DataFrame, path: str, headers: dict[str, list[str]], mode: str, single: bool) -> None:
    rows.sparkSession.dataSource.register(WorkbookSource)
    if mode not in ("overwrite", "errorifexists", *([] if single else ["append"])):
        raise ValueError(f"mode {mode}")
    if mode == "errorifexists" and exists(path):
        raise FileExistsError(path)
    out = rows.write.format(FORMAT).option("path", path).option("headers", json.dumps(headers)).option("single", str(single).lower())
    out.mode("overwrite" if mode == "overwrite" else "append").save()


def write_workbooks(df: DataFrame, path: str, sheet: str = "split", mode: str = "errorifexists") -> None:
    """A folder of workbooks with a sheet for each value of ``sheet``, which ``read_excel`` reads as one table.

    Each task writes its own rows, sorted by sheet, so nothing is shuffled and no split lies in one task. A sheet that is
    full goes on in the next workbook. Coalesce a small table first to get a single file.
    """
    columns = [c for c in df.columns if c != sheet]
    if not columns:
        raise ValueError("a sheet needs a column")
    rows = df.select(_sheet_name(F.col(sheet)).alias("sheet"), _cells(df, columns).alias("cells"))
    _save_workbooks(rows.sortWithinPartitions("sheet"), path, {"*": columns}, mode, single=False)


def write_report(sheets: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """K7: numbers rounded to four places, names cut to 31 characters; one workbook if ``path`` ends in ``.xlsx``,
    otherwise a CSV directory per sheet.

    A workbook is one file, so one task writes it: it is for reports, and a sheet over the format's limit is an error.
    Rows keep the order of their frame, and a frame without rows gives its headings.
    """
    rounded = {n: df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for n, df in sheets.items()}
    if not path.endswith(".xlsx"):
        for name, df in rounded.items():
            write_csv(df, f"{path}/{name[:MAX_NAME]}", mode)
        return
    parts = [df.select(F.lit(i).alias("no"), _sheet_name(F.lit(n)).alias("sheet"), F.monotonically_increasing_id().alias("row"), _cells(df, df.columns).alias("cells")) for i, (n, df) in enumerate(rounded.items())]
    rows = reduce(DataFrame.unionByName, parts).coalesce(1).sortWithinPartitions("no", "row").select("sheet", "cells")
    names = [re.sub(r"[\[\]:*?/\\]", "_", n.strip())[:MAX_NAME] or "unknown" for n in sheets]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"sheet names are the same once cut: {names}")
    _save_workbooks(rows, path, dict(zip(names, [df.columns for df in rounded.values()])), mode, single=True)


def append_cache(df: DataFrame, path: str, run: int | None = None) -> None:
    """K8: adds entries to a cache; ``run`` (by default the time in milliseconds) orders them after those of earlier runs."""
    df.drop("_seq").withColumn("_seq", F.lit(time.time_ns() // 1_000_000 if run is None else run).cast("long")).write.mode("append").json(path)


def prediction_columns(df: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """true_, prob_ and pred_ columns of each label beside the row's other columns."""
    arrays = {"true": "y_true", "prob": "y_prob", "pred": "y_pred"}
    wide = [F.col(a)[i].alias(f"{p}_{n}") for p, a in arrays.items() if a in df.columns for i, n in enumerate(names)]
    return df.select(*[c for c in df.columns if c not in arrays.values()], *wide)
