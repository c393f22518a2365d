"""Streaming use of the stateless parts.

Parsing (P1-P8) and filtering (F1-F8) are row-local, so a ``readStream`` of a
folder of log files goes through the same functions; level and hour counts
(A3 / A9) become windowed streaming aggregates with a watermark on the entry
time. The near-duplicate trim is order-dependent and is not offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_lines
from ..functions.timestamps import epoch_micros
from ..operators.filters import entry_filter


def stream_entries(spark: SparkSession, folder: str, max_files_per_trigger: int = 100,
                   **filters: str) -> DataFrame:
    """Parsed, filtered entries of the text files arriving in ``folder``."""
    lines = (
        spark.readStream.format("text").option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
        .select(F.regexp_replace("value", "\r$", "").alias("value"),
                F.col("_metadata.file_path").alias("file_path"))
    )
    parsed = parse_lines(lines).where(F.col("parse_error").isNull()).drop("parse_error")
    pred = entry_filter(**filters)
    return parsed if pred is None else parsed.where(pred)


def windowed_level_counts(entries: DataFrame, window: str = "1 hour",
                          watermark: str = "10 minutes") -> DataFrame:
    """A3 per event-time window: ``(window_start, window_end, level, count)``."""
    return (
        entries.withColumn("event_time", F.timestamp_micros(epoch_micros(F.col("ts"))))
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window), F.upper("level").alias("level"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "level", "count")
    )
