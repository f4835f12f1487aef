"""Streams: minute activity with a watermark, and unions of intervals as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_activity(events: DataFrame, time: str = "ts", value: str = "value", late: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Counts and sums of each step; what comes later than the watermark is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, step)).agg(F.count("*").alias("event_count"), F.sum(value).alias("activity")).select(F.col("window.start").alias("minute_time"), "event_count", "activity")


def island_sessions(events: DataFrame, node: str = "node", start: str = "start_time", seconds: str = "duration_s", late: str = "1 hour") -> DataFrame:
    """Unions of [start, start + duration] of each node: sessions whose gap is the event's own length.

    Touching intervals are one, as in the batch operator."""
    gap = F.concat(F.col(seconds).cast("string"), F.lit(" seconds"))
    out = events.withWatermark(start, late).groupBy(node, F.session_window(start, gap)).agg(F.count("*").alias("source_records"))
    return out.select(node, F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), "source_records")
