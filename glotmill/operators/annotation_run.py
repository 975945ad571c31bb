"""Annotation runs that can be broken off and taken up again (K8, D25, D26, D30, W1 and section 2.13).

The rows that a cache has no entry for are written down once, dealt over numbered waves by a hash of their id. Waves are
annotated one after the other, each by all executors, and each is committed to the cache by itself: its folder bears the
tag and the wave's number and is replaced as a whole, so a wave that dies midway leaves nothing, and one that runs again
leaves one copy. A later run reads the cache first and asks for what is missing only, whether a job died or a backend
left rows without an answer. The driver holds the waves' numbers and no rows.

A run has at most ``WAVES`` waves and ``FILES`` files of rows a wave; larger tables get larger waves. So neither jobs nor
the files that the driver lists grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.operators.detect_v3 import CACHE_SCHEMA, annotate_with, keep_last, to_do

#: Most waves of a run, and most files that a wave's rows are written to.
WAVES, FILES = 32, 64


def cached(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Entries of all runs below ``path``; of an id and tag the one of the latest run stays. Empty if there is no run yet."""
    try:
        rows = spark.read.schema(f"{CACHE_SCHEMA}, run int, wave int").parquet(f"{path}/entries")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"{CACHE_SCHEMA}, run int, wave int")
    return keep_last(rows.withColumn("_seq", F.col("run").cast("long")), tag).drop("run", "wave")


def annotate_in_waves(df: DataFrame, backend: Callable[[list[str]], list[dict]], tag: str, path: str, id_col: str = "id", wave_rows: int = 10_000, **options) -> int:
    """Annotates the rows of ``df`` that the cache at ``path`` has no entry for; returns how many were asked for.

    Every call is a run of its own, numbered after those whose entries the cache holds; call it again after a failure.
    ``df`` has text and ids that tell rows apart; null ids are left out, as no cache could find them again, and of a
    repeated id one row is asked for. A wave has about ``wave_rows`` rows, more where that would take over ``WAVES``
    waves. ``options`` go to ``annotate_with``.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), "text").dropDuplicates(["id"])
    known = cached(spark, path)
    run = (known.agg(F.max("_seq")).first()[0] or 0) + 1
    missing = to_do(rows, known, tag)
    asked = missing.count()
    if not asked:
        return 0
    waves = min(math.ceil(asked / wave_rows), WAVES)
    # written once, so that a wave reads its own rows and not the whole table; rows are dealt by wave before, so that a
    # task does not write a file for each wave
    wanted, files = f"{path}/asked/run={run}", min(FILES, spark.sparkContext.defaultParallelism)
    dealt = missing.withColumns({"wave": F.pmod(F.xxhash64("id"), F.lit(waves)).cast("int"), "__file": F.pmod(F.hash("id"), F.lit(files))})
    dealt.repartition("wave", "__file").drop("__file").write.mode("overwrite").partitionBy("wave").parquet(wanted)
    # files are listed once
    written = spark.read.schema("id string, text string, wave int").parquet(wanted)
    for wave in range(waves):
        part = written.where(F.col("wave") == wave).drop("wave")
        found = annotate_with(part, backend, tag, **options).withColumn("_seq", F.lit(run).cast("long"))
        found.write.mode("overwrite").parquet(f"{path}/entries/run={run}/wave={wave}")
    return asked
