"""Findings: what an examiner should look at first, with confidence and provenance apart from priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylens.functions.text import csv_field, is_executable
from waylens.plans.model import attribute

#: Indicators of clearing.
CLEARING = ("HistoryCleared", "AutoIncrementGap", "HistoryTombstoneFound", "SqliteSequenceGap")
RANK = {"high": 0, "medium": 1, "info": 2}


def executable_downloads(events: DataFrame, target: Column, danger: Column) -> DataFrame:
    """Downloads of executable names, or that the browser called dangerous."""
    rows = events.where((F.col("artifact") == "Downloads") & (is_executable(target) | (F.coalesce(danger, F.lit(0)) != 0)))
    return rows.select("seq", F.lit("high").alias("priority"), F.lit("medium").alias("confidence"), F.lit("exec_download.v1").alias("rule_id"), F.lit("download").alias("evidence_source"), F.lit("live").alias("state"), target.alias("evidence"), "browser")


def integrity_findings(indicators: DataFrame) -> DataFrame:
    """Findings of ``seq, tag, observation``: signs of clearing rank high and as deleted, others medium and as inferred."""
    clearing = F.col("tag").isin(*CLEARING)
    return indicators.select(
        "seq", F.when(clearing, "high").otherwise("medium").alias("priority"), F.lit("medium").alias("confidence"), F.concat(F.lit("integrity."), F.col("tag"), F.lit(".v1")).alias("rule_id"),
        F.lit("history").alias("evidence_source"), F.when(clearing, "deleted").otherwise("inferred").alias("state"), F.col("observation").alias("evidence"), F.lit(None).cast("string").alias("browser"),
    )


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding of each evidence, source and state."""
    rest = [c for c in findings.columns if c not in ("evidence", "evidence_source", "state")]
    first = findings.groupBy("evidence", "evidence_source", "state").agg(F.min_by(F.struct(*rest), "seq").alias("f"))
    return first.select("f.*", "evidence", "evidence_source", "state")


def with_rank(findings: DataFrame) -> DataFrame:
    """Adds ``rank_key``, the priority's place."""
    return findings.withColumn("rank_key", F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("priority")])


def ranked(findings: DataFrame) -> DataFrame:
    """By priority, then in their order; ``rank_key`` sorts so without collecting anything."""
    return with_rank(findings).orderBy("rank_key", "seq")


def assembled(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """All findings of events and explained integrity indicators (``seq, tag, observation``), by priority and then in the order of
    their kinds: executable downloads, integrity, encrypted cookies, extensions. ``place`` sorts so."""
    danger = attribute(events, "danger_type").try_cast("int")
    parts = [executable_downloads(events, attribute(events, "target_path"), danger), integrity_findings(indicators), cookie_finding(events), extension_findings(events)]
    out = None
    for i, part in enumerate(parts):
        own = with_rank(part).withColumn("kind", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("place", F.struct("rank_key", "kind", "seq"))


def visible(findings: DataFrame, most: int = 7) -> DataFrame:
    """The few findings of a summary."""
    return ranked(findings).limit(most)


def encrypted_cookies(cookies: DataFrame) -> DataFrame:
    return cookies.agg(F.count_if(F.col("encrypted_value").isNotNull() & (F.col("encrypted_value") != "")).alias("encrypted"))


def cookie_finding(events: DataFrame) -> DataFrame:
    """One finding that counts cookies whose values are encrypted; none if there are none."""
    held = events.where(F.col("artifact") == "Cookies").agg(F.count_if(attribute(events, "encrypted_value") == "ENCRYPTED").alias("n")).where("n > 0")
    return held.select(
        F.lit(0).cast("long").alias("seq"), F.lit("info").alias("priority"), F.lit("high").alias("confidence"), F.lit("investigate.encrypted_cookies.v1").alias("rule_id"), F.lit("cookie").alias("evidence_source"),
        F.lit("live").alias("state"), F.concat(F.col("n").cast("string"), F.lit(" cookie value(s) stored encrypted (not recoverable without keys)")).alias("evidence"), F.lit(None).cast("string").alias("browser"),
    )


def extension_findings(events: DataFrame) -> DataFrame:
    """A finding for each source with extensions: how many there are, and their names in order."""
    name = F.coalesce(attribute(events, "name"), F.col("description"))
    held = events.where(F.col("artifact") == "Extensions").groupBy("source").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(name)).alias("names"))  # a profile's extensions
    return held.select(
        "seq", F.lit("info").alias("priority"), F.lit("low").alias("confidence"), F.lit("investigate.extension_present.v1").alias("rule_id"), F.lit("extension").alias("evidence_source"), F.lit("live").alias("state"),
        F.concat(F.size("names").cast("string"), F.lit(" extension(s) installed: "), F.array_join("names", ", ")).alias("evidence"), F.lit(None).cast("string").alias("browser"),
    )


#: For each kind of recovered artifact the finding's priority, confidence, rule, and provenance: source, state,
#: basis of its time, claimed action.
RECOVERED = {
    "Carved": ("medium", None, "recover.carve.deleted_record.v1", "carved", "carved", "none", "unknown"), "Cache": ("info", None, "recover.cache_carve.evicted.v1", "cache", "deleted", "surrounding_page", "observed_string"),
    "RecoveredDomain": ("info", "low", "recover.recovered_domain.v1", "recovered", "inferred", "inferred", "unknown"), "RecoveredBookmark": ("medium", "medium", "recover.deleted_bookmark.v1", "history", "deleted", "explicit", "unknown"),
    "Memory": ("info", "low", "recover.memory.carved.v1", "memory", "carved", "none", "observed_string"),
}


def recovery_findings(events: DataFrame) -> DataFrame:
    """Findings of recovered artifacts: carved rows, evicted cache entries, recovered domains, deleted bookmarks and strings of
    memory. Complete carved rows and whole cache bodies are medium in confidence, others low; rows of a log or journal are
    deleted, not carved."""
    kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in RECOVERED.items() for x in (k, v[i] or "")]), F.col("artifact"))
    rows = events.where(F.col("artifact").isin(*RECOVERED))
    url, domain, via = (attribute(rows, k) for k in ("url", "domain", "source_artifact"))
    whole = F.coalesce(attribute(rows, "recovery_quality").isin("complete", "full"), F.lit(False))
    logged = F.coalesce(attribute(rows, "recovery_method").isin("wal", "journal"), F.lit(False)) & (F.col("artifact") == "Carved")
    evidence = (
        F.when(F.col("artifact") == "RecoveredDomain", F.concat(F.coalesce(domain, F.col("description")), F.lit(" (recovered from "), F.coalesce(via, F.lit("a network/state artifact")), F.lit(")")))
        .when(F.col("artifact").isin("Carved", "Cache"), F.col("description")).otherwise(F.coalesce(url, F.col("description")))
    )
    return rows.select(
        "seq", kind(0).alias("priority"), F.when(kind(1) != "", kind(1)).when(whole, "medium").otherwise("low").alias("confidence"), kind(2).alias("rule_id"), kind(3).alias("evidence_source"),
        F.when(logged, "deleted").otherwise(kind(4)).alias("state"), evidence.alias("evidence"), "browser",
    )


def tamper_findings(indicators: DataFrame) -> DataFrame:
    """Findings of explained indicators, with their harmless causes beside them."""
    rows = indicators.withColumn("seq", F.xxhash64("path", "tag", "observation"))
    return integrity_findings(rows).withColumn("rule_id", F.regexp_replace("rule_id", "^integrity", "recover.tamper"))


FOOTER = "Priority says where to look first, not what to conclude. Confidence and interpretation are apart from it."


def finding_lines(findings: DataFrame, form: str = "csv") -> DataFrame:
    """Findings as ``line`` of CSV, JSON or text; the text of each ends with its provenance. ``FOOTER`` goes below them."""
    columns = ["priority", "confidence", "rule_id", "evidence_source", "state", "browser", "evidence"]
    if form == "csv":
        return findings.select(F.concat_ws(",", *[csv_field(F.coalesce(c, F.lit(""))) for c in columns]).alias("line"))
    if form == "jsonl":
        return findings.select(F.to_json(F.struct(*sorted(columns))).alias("line"))
    parts = [F.concat(F.lit("Priority:       "), "priority"), F.concat(F.lit("Confidence:     "), "confidence", F.lit("  (rule "), "rule_id", F.lit(")")), F.concat(F.lit("Provenance:     "), "evidence_source", F.lit(" · "), "state"), F.concat(F.lit("Origin:         "), "browser"), F.concat(F.lit("Evidence:       "), "evidence")]
    return findings.select(F.concat_ws("\n", *parts).alias("line"))


def newest_per_section(records: DataFrame, cap: int = 20) -> DataFrame:
    """The ``cap`` newest records of each kind. Each task keeps its own newest first, so few rows are shuffled."""
    order = Window.partitionBy("kind").orderBy(F.desc("timestamp_ns"), "seq")
    return records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
