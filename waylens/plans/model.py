"""The event model: columns of a normalized event and the dimension of artifact kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "seq bigint, timestamp_ns bigint, browser string, artifact string, source string, description string, attrs map<string,string>"

#: For each artifact kind its evidence source, state, timestamp basis, claimed user action, time slot
#: (M modified, A accessed, B born) and the label of its time.
ARTIFACTS = [
    ("History", "history", "live", "explicit", "visited", "A", "Last Visited Time"),
    ("Downloads", "download", "live", "explicit", "downloaded", "B", "Download Started Time"),
    ("Cookies", "cookie", "live", "explicit", "observed_string", "A", "Last Access Time"),
    ("Bookmarks", "history", "live", "explicit", "visited", "B", "Added Time"),
    ("Cache", "cache", "live", "surrounding_page", "observed_string", "A", "Last Access Time"),
    ("Extensions", "extension", "live", "explicit", "unknown", "B", "Install Time"),
    ("Autofill", "history", "live", "explicit", "observed_string", "A", "Last Used Time"),
    ("Session", "history", "live", "explicit", "visited", "M", "Last Modified Time"),
    ("LoginData", "history", "live", "explicit", "observed_string", "A", "Last Used Time"),
    ("Preferences", "history", "live", "explicit", "observed_string", "M", "Modified Time"),
    ("LocalStorage", "history", "live", "explicit", "observed_string", "M", "Modified Time"),
    ("Integrity", "history", "live", "explicit", "observed_string", "M", "Event Time"),
    ("Carved", "carved", "carved", "none", "unknown", "M", "Recovered Record Time"),
    ("Memory", "memory", "carved", "none", "observed_string", "M", "Observed Time"),
    ("Permission", "history", "live", "explicit", "observed_string", "M", "Last Modified Time"),
    ("CreditCard", "history", "live", "explicit", "observed_string", "M", "Last Modified Time"),
    ("AuthToken", "history", "live", "explicit", "observed_string", "A", "Last Used Time"),
    ("RecoveredDomain", "recovered", "inferred", "none", "unknown", "A", "Last Contacted Time"),
    ("Favicon", "history", "live", "explicit", "visited", "A", "Last Requested Time"),
    ("TopSite", "history", "live", "explicit", "visited", "A", "Last Visited Time"),
    ("Shortcut", "history", "live", "explicit", "searched", "A", "Last Used Time"),
    ("NetworkPrediction", "history", "live", "explicit", "searched", "A", "Last Used Time"),
    ("MediaPlayback", "history", "live", "explicit", "visited", "A", "Last Playback Time"),
    ("TypedInput", "history", "live", "explicit", "searched", "A", "Typed Input Time"),
    ("Annotation", "history", "live", "explicit", "observed_string", "B", "Annotation Added Time"),
    ("RecoveredBookmark", "history", "deleted", "inferred", "visited", "B", "Added Time (from backup)"),
]
CONFIDENCE = {"live": "high", "deleted": "medium", "reconstructed": "medium", "carved": "low", "inferred": "low"}


def artifacts(spark: SparkSession) -> DataFrame:
    """26 rows: broadcast wherever it is joined."""
    rows = [(*a, CONFIDENCE[a[2]], f"find.{a[1]}.{a[2]}.v1") for a in ARTIFACTS]
    return spark.createDataFrame(rows, "artifact string, src string, state string, basis string, action string, slot string, label string, confidence string, rule_id string")


#: Columns of an event that aren't attributes.
ENVELOPE = ("seq", "timestamp_ns", "browser", "artifact", "source", "description", "attrs", "attrs_json")


def attributes(events: DataFrame) -> Column:
    """All attributes of an event as text: its map, or else what columns it has beside the envelope, nulls left out."""
    if "attrs" in events.columns:
        return F.col("attrs")
    named = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in events.columns if c not in ENVELOPE]
    return F.map_from_entries(F.filter(F.array(*named), lambda x: x["value"].isNotNull())) if named else F.create_map().cast("map<string,string>")


def attribute(events: DataFrame, name: str) -> Column:
    """One attribute as text; null if the event doesn't have it."""
    if name in events.columns:
        return F.col(f"`{name}`").cast("string")
    return F.element_at("attrs", F.lit(name)) if "attrs" in events.columns else F.lit(None).cast("string")


def with_kinds(events: DataFrame, *columns: str) -> DataFrame:
    """Events with ``columns`` of their artifact's kind; kinds that aren't listed have the values of an observed string."""
    unknown = {"src": "history", "state": "live", "basis": "explicit", "action": "observed_string", "slot": "M", "label": "Event Time", "confidence": "high", "rule_id": "find.history.live.v1"}
    kinds = artifacts(events.sparkSession).select(F.col("artifact").alias("__kind"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = events.join(F.broadcast(kinds), F.col("artifact") == F.col("__kind"), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", F.lit(unknown[c])) for c in columns}).drop("__kind", *[f"__{c}" for c in columns])
