"""Windowed activity and sessions of event streams. An extension: the same functions take tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which wants times with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_activity(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events and their total by user and window of time; on a stream, rows later than ``late`` are left out."""
    events = _watched(events, late)
    return events.groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    events = _watched(events, late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
