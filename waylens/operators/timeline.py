"""Timelines: deduplication, statistics, sessions and sorted windows of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.operators.ordering import KEY_ROWS, running_total, with_previous


def deduplicated(events: DataFrame) -> DataFrame:
    """The first event (by ``seq``) of each url, time and artifact; untimed events too.

    An aggregation with a partial step instead of a window: copies meet in a map task before any shuffle.
    """
    others = [c for c in events.columns if c not in ("seq", "url", "timestamp_ns", "artifact")]
    key = F.coalesce("url", F.lit("")).alias("__url")
    first = events.groupBy(key, "timestamp_ns", "artifact").agg(F.min_by(F.struct("seq", "url", *others), "seq").alias("e"), F.count("*").alias("copies"))
    return first.select("e.*", "timestamp_ns", "artifact", "copies", (F.col("timestamp_ns") != 0).alias("timed"))


def timeline_stats(events: DataFrame) -> DataFrame:
    """Timed and untimed events that stay, and how many copies were removed."""
    return deduplicated(events).agg(F.count_if("timed").alias("timed"), F.count_if(~F.col("timed")).alias("untimed"), F.sum(F.col("copies") - 1).alias("duplicates_removed"))


def sessionize(events: DataFrame, idle_ns: int = 30 * 60 * 10**9, by: str = "profile", recorded: Column | None = None, most: int = KEY_ROWS) -> DataFrame:
    """Adds ``session_id`` from 0 in each profile: a gap above ``idle_ns``, or another recorded session, begins a new one.

    If some profile has more than ``most`` events, events are cut into ranges of profile and time, so that a profile with a
    third of all events is many tasks' work.
    """
    order = ["timestamp_ns", "seq"]
    marked = events.withColumn("__recorded", F.lit(None) if recorded is None else recorded)
    rows = with_previous(marked, by, order, ["timestamp_ns", "__recorded"], most)
    starts = (F.col("timestamp_ns") - F.col("previous.timestamp_ns") > idle_ns) | (F.col("__recorded") != F.col("previous.__recorded"))
    if recorded is None:
        starts = F.col("timestamp_ns") - F.col("previous.timestamp_ns") > idle_ns
    flagged = rows.withColumn("__new", F.coalesce(starts, F.lit(False)).cast("long")).drop("previous", "__recorded")
    return running_total(flagged, by, order, "__new", "session_id").drop("__new")


def session_summary(sessions: DataFrame, by: str = "profile") -> DataFrame:
    return sessions.groupBy(by, "session_id").agg(F.count("*").alias("events"), F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"))


def around(events: DataFrame, pivot_ns: int, window_ns: int) -> DataFrame:
    return events.where(F.col("timestamp_ns").between(pivot_ns - window_ns, pivot_ns + window_ns))


def collapse_redirects(visits: DataFrame) -> DataFrame:
    """Without redirect hops that aren't a chain's end."""
    return visits.where(~(F.coalesce("is_redirect", F.lit(False)) & ~F.coalesce("chain_end", F.lit(False))))


def tabs_open_at(events: DataFrame, at_ns: int, artifact: str = "Session") -> DataFrame:
    return events.where((F.col("artifact") == artifact) & (F.col("timestamp_ns") > 0) & (F.col("timestamp_ns") <= at_ns))
