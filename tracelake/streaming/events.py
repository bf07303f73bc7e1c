"""Duplicates and windows of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floor_div


def event_time(ns: str = "time_ns"):
    return F.timestamp_micros(floor_div(F.col(ns), 1000))


def with_time(df: DataFrame, delay: str | None, ns: str = "time_ns") -> DataFrame:
    out = df.withColumn("event_time", event_time(ns))
    return out.withWatermark("event_time", delay) if delay else out


def dedup_points(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first point of each (metric, service, attributes, time); a stream remembers them for the delay."""
    keys = ["metric", "service", "attributes", "time_ns"]
    if points.isStreaming:
        return with_time(points, delay).dropDuplicatesWithinWatermark(keys).drop("event_time")
    return points.dropDuplicates(keys)


def tumbling_volume(logs: DataFrame, width: str, *keys: str, delay: str | None = None, right_closed: bool = False) -> DataFrame:
    """Rows per window and keys; right-closed windows are (start, end]."""
    return sliding_volume(logs, width, width, *keys, delay=delay, right_closed=right_closed)


def sliding_volume(logs: DataFrame, width: str, slide: str, *keys: str, delay: str | None = None, right_closed: bool = False) -> DataFrame:
    timed = with_time(logs, delay)
    at = F.col("event_time") - F.expr("interval 1 microsecond") if right_closed else F.col("event_time")
    if right_closed and delay:
        timed = logs.withColumn("event_time", event_time() - F.expr("interval 1 microsecond")).withWatermark("event_time", delay)
        at = F.col("event_time")
    return timed.groupBy(F.window(at, width, slide).alias("w"), *keys).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "count")


def session_volume(logs: DataFrame, gap: str, *keys: str, delay: str | None = None) -> DataFrame:
    timed = with_time(logs, delay)
    return timed.groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "count")
