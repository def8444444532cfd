"""Streams: sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events (ts, user_id, value) of a user less than ``gap`` apart: rec, start, end, n, level.

    For batches and streams alike; a stream needs ``late``, its watermark. A gap of exactly ``gap`` begins a new session, where
    merging spans would still join them.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    w = rows.groupBy(F.col("user_id").alias("rec"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("level"))
    return w.select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")
