"""Reports: counts for a summary, the HTML page, and what a bundle lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.functions.text import csv_field
from waylens.functions.times import rfc3339
from waylens.functions.urls import HOST_FIELDS, URL_FIELDS, domain_of, host_of
from waylens.operators.correlate import host_rollup
from waylens.operators.timeline import deduplicated
from waylens.plans.model import attribute
from waylens.plans.scratch import cut

TOP_DOMAINS, TIMELINE_ROWS = 10, 1000


def artifact_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("artifact").agg(F.count("*").alias("events"))


def top_domains(events: DataFrame, most: int = TOP_DOMAINS) -> DataFrame:
    """The ``most`` hosts with most events."""
    hosts = events.select(host_of(F.when(attribute(events, "url").contains("://"), attribute(events, "url"))).alias("host")).where("host IS NOT NULL")
    return hosts.groupBy("host").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "host").limit(most)


def triage_counts(events: DataFrame, profiles: DataFrame, integrity: DataFrame, carved: DataFrame) -> DataFrame:
    """One row: profiles, events, integrity indicators and carved rows."""
    parts = {"profiles": profiles, "events": events, "integrity": integrity, "carved": carved}
    every = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("part"))
        every = own if every is None else every.unionByName(own)
    return every.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


def rule_versions(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id").distinct()


def html_escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def html_report(events: DataFrame, findings: DataFrame | None = None, title: str = "Browsing activity", zone: str = "UTC", flags: tuple[str, ...] = ()) -> str:
    """An HTML page: counts by artifact, the top domains, findings, observations and the first events in time.

    What reaches the driver is bounded: a row an artifact kind, ten domains, the first thousand findings and events.
    """
    cell = lambda c: F.concat(F.lit("<td>"), html_escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    row = lambda *cs: F.concat(F.lit("<tr>"), *[cell(c) for c in cs], F.lit("</tr>")).alias("line")

    def table(head: tuple[str, ...], rows: DataFrame) -> list[str]:
        return ["<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>", *(r["line"] for r in rows.collect()), "</table>"]

    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = [f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body>', f"<h1>{escape(title)}</h1>"]
    if findings is not None:
        first = findings.orderBy("rank_key", "seq") if "rank_key" in findings.columns else findings.orderBy("seq")
        out += ["<h2>Ranked findings</h2>", *table(("Priority", "Confidence", "Rule", "Evidence"), first.limit(TIMELINE_ROWS).select(row(*[F.col(c) for c in ("priority", "confidence", "rule_id", "evidence")])))]
    out += ["<h2>Artifacts observed</h2>", *table(("Artifact", "Count"), artifact_counts(events).orderBy("artifact").select(row(F.col("artifact"), F.col("events"))))]
    out += ["<h2>Top domains</h2>", *table(("Domain", "Events"), top_domains(events).select(row(F.col("host"), F.col("events"))))]
    out += ["<h2>Observations</h2>", "<ul>", *(f"<li>{escape(f)}</li>" for f in flags), "</ul>"]
    timed = events.where("timestamp_ns <> 0").orderBy("timestamp_ns", "seq").limit(TIMELINE_ROWS)
    out += ["<h2>Timeline</h2>", *table(("Time", "Browser", "Artifact", "Description"), timed.select(row(rfc3339(F.col("timestamp_ns"), zone), F.col("browser"), F.col("artifact"), F.col("description")))), "</body></html>"]
    return "\n".join(out)


#: Fixed value: the header of a unified timeline in CSV.
TIMELINE_HEADER = "timestamp,browser,artifact,host,source,description,url"
#: How the lines of a correlation are ordered; see ``correlation_lines``.
CORRELATION_ORDER = ("section", "first", "second", "third")


def correlation_lines(events: DataFrame, form: str = "text", zone: str = "UTC") -> DataFrame:
    """``section, first, second, third, line`` of the unified timeline and the rollup by registrable domain, in text, JSON (``jsonl``)
    or CSV (timeline only, without its header ``TIMELINE_HEADER``).

    In the order of the other columns: a head with counts, timed events by time (equal times by ``seq``), untimed ones by
    ``seq`` (in text behind a head of their own), and hosts by falling number of events. The counts come from one aggregation.
    """
    host = F.coalesce(*[domain_of(attribute(events, k)) for k in (*URL_FIELDS, *HOST_FIELDS)], F.lit(""))
    rows = events.select("seq", "timestamp_ns", "browser", "artifact", "source", "description", F.coalesce(attribute(events, "url"), F.lit("")).alias("url"), host.alias("host"))
    rows = cut(rows, "correlated")
    kept = cut(deduplicated(rows), "timeline")
    counts = kept.agg(F.count_if("timed").alias("timed"), F.count_if(~F.col("timed")).alias("untimed"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
    none = F.lit(0).cast("long")
    at = lambda section, first, second, third, line: [F.lit(section).alias("section"), first.alias("first"), second.alias("second"), third.alias("third"), line.alias("line")]
    place = (F.when(F.col("timed"), F.col("timestamp_ns")).otherwise(none), F.col("seq"), F.lit(""))
    section = F.when(F.col("timed"), 1).otherwise(3)
    time = rfc3339(F.col("timestamp_ns"), zone)
    if form == "csv":
        line = F.concat_ws(",", *[csv_field(c) for c in (time, F.col("browser"), F.col("artifact"), F.col("host"), F.col("source"), F.col("description"), F.col("url"))])
        return kept.select(section.alias("section"), *at(0, *place, line)[1:])
    rollup = host_rollup(rows.where("host <> ''"), F.col("host"))
    behind = (-F.col("total"), none, F.col("host"))
    if form == "jsonl":
        line = F.to_json(F.struct("artifact", "browser", "description", "host", F.lit("event").alias("record"), "source", time.alias("timestamp"), "timestamp_ns", "url"))
        head = F.to_json(F.struct(F.col("duplicates").alias("duplicates_removed"), F.lit("timeline_summary").alias("record"), "timed", (F.col("timed") + F.col("untimed")).alias("total"), "untimed"))
        last = F.to_json(F.struct("browsers", "counts", "first_seen_ns", "host", "last_seen_ns", F.lit("host").alias("record"), "total"))
        parts = [counts.select(*at(0, none, none, F.lit(""), head)), rollup.select(*at(5, *behind, last))]
    else:
        line = F.concat(F.lit("["), time, F.lit("] "), "browser", F.lit("/"), "artifact", F.lit(" "), "host", F.lit("  "), "description")
        number = lambda c: F.col(c).cast("string")
        head = F.concat(F.lit("== Unified cross-artifact timeline ("), (F.col("timed") + F.col("untimed")).cast("string"), F.lit(" event(s): "), number("timed"), F.lit(" timed, "), number("untimed"), F.lit(" untimed, "), number("duplicates"), F.lit(" duplicate(s) removed) =="))
        span = F.when(F.col("first_seen_ns").isNull(), "(untimed)").otherwise(F.concat(rfc3339(F.col("first_seen_ns"), zone), F.lit(".."), rfc3339(F.col("last_seen_ns"), zone)))
        kinds = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
        last = F.concat(F.lit("  "), "host", F.lit("  total="), number("total"), F.lit("  "), span, F.lit("  ["), F.array_join("browsers", ", "), F.lit("]  "), kinds)
        hosts = rollup.agg(F.count("*").alias("n"))
        parts = [
            counts.select(*at(0, none, none, F.lit(""), head)), counts.where("untimed > 0").select(*at(2, none, none, F.lit(""), F.concat(F.lit("-- untimed ("), number("untimed"), F.lit(") --")))),
            hosts.select(*at(4, none, none, F.lit(""), F.lit(""))), hosts.select(*at(4, none + 1, none, F.lit(""), F.concat(F.lit("== Per-host rollup ("), number("n"), F.lit(" host(s)) ==")))), rollup.select(*at(5, *behind, last)),
        ]
    out = kept.select(section.alias("section"), *at(0, *place, line)[1:])
    for part in parts:
        out = out.unionByName(part)
    return out


def bundle_sums(files: DataFrame) -> DataFrame:
    """``line``: SHA-256 and path of each file (``path, content``), as checking tools read them."""
    return files.select(F.concat(F.sha2("content", 256), F.lit("  "), "path").alias("line"))
