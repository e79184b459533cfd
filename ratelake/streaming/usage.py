"""Streaming forms of the usage queries: late data, duplicates, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.calendar import tou_period


def period_usage(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """kWh of each user, window and time-of-use period; events repeated within the delay count once. Works on a
    stream (append mode gives a window once no event for it is awaited any more) and on a table."""
    rows = events.select("event_id", "ts", "user_id", "value")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        rows = rows.dropDuplicates(["event_id"])
    grouped = rows.groupBy("user_id", F.window("ts", width).alias("w"), tou_period(F.col("ts")).alias("period"))
    return grouped.agg(F.sum("value").alias("kwh"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "period", "kwh", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of a user's events without a pause of ``gap``: start, end, events and sum."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
