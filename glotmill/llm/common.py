"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: [\x20\x09-\x0D].
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table; the path may lie in any store that Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="glotmill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_observed(df: DataFrame, *totals: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` and totals over all rows, from the same job."""
    shared_folder(df.sparkSession)
    seen = Observation()
    return df.observe(seen, *totals).checkpoint(eager=True), seen.get


def cut_lineage_counted(df: DataFrame, rows_per_task: int = 200_000) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, counted by the same job; few rows come back in few partitions."""
    cut, seen = cut_lineage_observed(df, F.count(F.lit(1)).alias("n"))
    n = seen["n"]
    return cut.coalesce(max(1, math.ceil(n / rows_per_task))), n


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def unit_hash(column: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) for sampling, of 53 bits, so that a share of any size is met."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), column), 11) / F.lit(float(1 << 53))
