"""An extension beyond batch parity: frame windows and sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, events, value) by tumbling or sliding windows of ``ts``; works on streams and tables.

    Events later than ``late`` are dropped on a stream. Rows without ts are in no window.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events): runs of a user's events at most ``gap`` apart; end is the last event plus the gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
