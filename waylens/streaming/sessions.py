"""Structured Streaming forms of the session, rollup and filter operators (extensions: their batch forms are the measure)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each profile once no later event can reach them: ``profile, start, end, events``.

    State holds open sessions only; the watermark closes them.
    """
    timed = events.where("timestamp_ns <> 0").withColumn("time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("time", late)
    found = timed.groupBy(F.session_window("time", idle).alias("w"), "profile").agg(F.count("*").alias("events"))
    return found.select("profile", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def streaming_host_rollup(events: DataFrame, host: Column, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each host, artifact and day."""
    timed = events.where("timestamp_ns <> 0").withColumn("time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("time", late)
    found = timed.groupBy(F.window("time", window).alias("w"), host.alias("host"), "artifact").agg(F.count("*").alias("events"))
    return found.select(F.col("w.start").alias("day"), "host", "artifact", "events")


def streaming_deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first arrival of each url, time and artifact within the watermark."""
    timed = events.where("timestamp_ns <> 0").withColumn("time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("time", late)
    return timed.dropDuplicatesWithinWatermark(["url", "timestamp_ns", "artifact"])
