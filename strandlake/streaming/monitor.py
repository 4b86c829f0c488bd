"""Placement monitor: rejection counts by code over event-time windows of a placement log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rejections(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, code, n) of a log (event_id, ts, code), streaming or not; a stream drops what is later than `late`."""
    w = log.withWatermark("ts", late) if log.isStreaming else log
    return w.groupBy(F.window("ts", width).alias("w"), "code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "code", "n")
