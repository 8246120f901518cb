"""Sessions of an event stream, with late and repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, started, ended, n): events without a pause of the gap, closed once the watermark has passed; an event delivered twice within
    the watermark counts once. Works on a stream (append mode) and on a table."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id]) if e.isStreaming else e.dropDuplicates([event_id])
    w = F.session_window(ts, gap)
    return e.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
