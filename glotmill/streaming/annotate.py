"""Annotation of a stream of new comments: stateless expressions, appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.lexicon import DetectorConfig
from glotmill.operators import detect_v2


def annotated_stream(stream: DataFrame, config: DetectorConfig = DetectorConfig(), event_time: str | None = None, delay: str = "1 hour", id_col: str = "id") -> DataFrame:
    """The stream with v2 annotations. With an event time, repeats of an id within ``delay`` are dropped; state is bounded."""
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_col])
    return detect_v2.annotate(stream, config=config)


def group_counts(annotated: DataFrame, event_time: str, window: str = "10 minutes") -> DataFrame:
    """Rows per window and group; the stream must have a watermark."""
    return annotated.groupBy(F.window(event_time, window), "cs_group").agg(F.count(F.lit(1)).alias("n"))


def append_stream(annotated: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts the query that writes each batch once, under its batch id, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if then:
            then(batch, batch_id)

    return annotated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
