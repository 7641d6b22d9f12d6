"""What events of each artifact hold: keys, types and counts from the data, and JSON Schema made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylens.plans.model import ENVELOPE, artifacts

#: Names of JSON Schema's types by the beginning of a VARIANT's type.
JSON_TYPES = (("BIGINT", "integer"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("FLOAT", "number"), ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("STRING", "string"))
#: The envelope of an event, which all artifacts share.
COMMON = {"timestamp_ns": "integer", "browser": "string", "artifact": "string", "source": "string", "description": "string"}


def attribute_values(events: DataFrame) -> DataFrame:
    """``artifact, key, value``: each attribute that an event has, as VARIANT; of ``attrs_json`` or else of the columns beside the envelope."""
    if "attrs_json" in events.columns:
        packed = F.col("attrs_json")
    else:
        own = [F.col(f"`{c}`") for c in events.columns if c not in ENVELOPE]
        packed = F.to_json(F.struct(*own)) if own else F.lit("{}")
    return events.select("artifact", F.explode(F.from_json(packed, "map<string,variant>")).alias("key", "value")).where("value IS NOT NULL AND NOT is_variant_null(value)")


def artifact_keys(events: DataFrame) -> DataFrame:
    """``artifact, key, type, n, events, required``: the keys of each artifact, the one VARIANT type that all of their values fit,
    how many events have the key, and whether all do.

    Types merge in the aggregation (``schema_of_variant_agg``), partly before the shuffle, so an artifact of any size is a few
    rows a task. Events without attributes count as events.
    """
    totals = events.groupBy("artifact").agg(F.count("*").alias("events"))
    keys = attribute_values(events).groupBy("artifact", "key").agg(F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("n"))
    return keys.join(F.broadcast(totals), "artifact").select("artifact", "key", "type", "n", "events", (F.col("n") == F.col("events")).alias("required"))  # a row an artifact kind


def catalog(events: DataFrame) -> DataFrame:
    """``artifact, evidence_source, state, events, keys``: the artifacts that occur or are known, with their provenance; those without
    events have none."""
    keys = artifact_keys(events).groupBy("artifact").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    counted = events.groupBy("artifact").agg(F.count("*").alias("events")).join(keys, "artifact", "left")
    known = artifacts(events.sparkSession).select("artifact", F.col("src").alias("evidence_source"), "state")
    rows = known.join(counted, "artifact", "full")
    return rows.select("artifact", "evidence_source", "state", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def json_schemas(events: DataFrame) -> DataFrame:
    """``artifact, line``: a JSON Schema of the events of each artifact as they were found: the envelope, and attributes by key."""
    kind = F.lit("null")
    for head, name in reversed(JSON_TYPES):
        kind = F.when(F.startswith(F.col("type"), F.lit(head)), name).otherwise(kind)
    common = ",".join(f'"{k}":{{"type":"{t}"}}' for k, t in COMMON.items())
    quoted = lambda c: F.to_json(F.array(c))  # noqa: E731 - in brackets, which are cut off
    name = F.regexp_extract(quoted(F.col("key")), r"^\[(.*)\]$", 1)
    own = artifact_keys(events).select("artifact", "key", "required", name.alias("name"), F.concat(name, F.lit(':{"type":"'), kind, F.lit('"}')).alias("property"))
    grouped = own.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("key", "property"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("key", "name")))).alias("r"))
    every = events.select("artifact").distinct().join(grouped, "artifact", "left")
    properties = F.array_join(F.transform(F.coalesce("p", F.array().cast("array<struct<key:string,property:string>>")), lambda x: x["property"]), ",")
    needed = F.array_join(F.transform(F.coalesce("r", F.array().cast("array<struct<key:string,name:string>>")), lambda x: x["name"]), ",")
    line = F.concat(F.lit('{"title":"'), "artifact", F.lit('","type":"object","properties":{' + common + ',"attrs":{"type":"object","properties":{'), properties, F.lit('},"required":['), needed, F.lit("]}}}"))
    return every.select("artifact", line.alias("line"))
