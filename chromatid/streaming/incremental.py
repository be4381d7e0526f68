"""Drift signals as a stream (id, type, severity, detected_at timestamp, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid.operators import filters


def deduplicated(signals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return signals.withWatermark("detected_at", late).dropDuplicatesWithinWatermark(["id"])


def daily_counts(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, type, severity, n): tumbling counts, as daily snapshots."""
    by = signals.withWatermark("detected_at", late).groupBy(F.window("detected_at", "1 day").alias("w"), "type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("day"), "type", "severity", "n")


def new_against(baseline: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch's signals that aren't in the baseline to sink."""
    return lambda batch, at: sink(filters.new_since(batch, baseline), at)


def changed_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content, mtime): a stream of text files below root, each as it appears."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return s.select("path", F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"))


def retry_queue(queue: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Entries (attempts, queued_at) still to be sent, oldest first."""
    return queue.where(F.col("attempts") < max_attempts).orderBy("queued_at")
