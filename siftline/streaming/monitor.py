"""Structured Streaming forms: windowed counts with late data, counters by epoch, first sightings.

The counters and first sightings are what append-only logs and query-then-insert
indexes do in batch; the windowed counts go beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by tumbling (or sliding) event-time windows; rows later than the watermark drop from a stream."""
    at = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return at.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_sightings(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key comes for the first time; a stream forgets keys older than the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def exposure_by_epoch(log: DataFrame) -> DataFrame:
    """Images, empty images and their share by epoch."""
    got = log.groupBy("epoch").agg(F.sum("images").alias("images"), F.sum("post_augmentation_empty_images").alias("empty"))
    return got.withColumn("fraction", F.try_divide("empty", "images"))
