"""The status log as a stream of (event_id, status, updated_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within the watermark."""
    return events.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame) -> DataFrame:
    """(hour, status, n) of a stream with a watermark on updated_at; works on a table as well."""
    counted = events.groupBy(F.window("updated_at", "1 hour"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("hour"), "status", "n")


def stale_to_pending(events: DataFrame, now: str, after: str = "1 hour") -> DataFrame:
    """Rows processing for longer than `after` before `now` go back to pending."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.expr(f"timestamp '{now}' - interval {after}"))
    return events.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))
