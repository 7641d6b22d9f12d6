"""Views for assistants: recent browsing under an allow-list, redacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.functions.text import mask_secrets
from waylens.functions.urls import host_of, redact_url
from waylens.operators.findings import newest_per_section


def permitted(url: Column, domains: list[str]) -> Column:
    """Whether the URL's host is an allowed domain or below one; an empty list allows nothing, ``*`` everything."""
    if "*" in domains:
        return F.lit(True)
    host = host_of(url)
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return F.coalesce(out, F.lit(False))


def eligible(now_ns: int, minutes: int) -> Column:
    """Open and closed tabs always; others in the last minutes, visits without their redirect hops."""
    hop = (F.col("kind") == "visit") & F.coalesce("is_redirect", F.lit(False)) & ~F.coalesce("chain_end", F.lit(False))
    return F.col("kind").isin("open_tab", "closed_tab") | ((F.col("timestamp_ns") >= now_ns - minutes * 60 * 10**9) & ~hop)


def browsing_context(records: DataFrame, now_ns: int, domains: list[str], minutes: int = 15, cap: int = 20) -> DataFrame:
    """The newest permitted records of each kind, URLs cut at their query, titles masked."""
    allowed = records.where(eligible(now_ns, minutes) & permitted(F.col("url"), domains))
    return newest_per_section(allowed, cap).select("kind", "place", "timestamp_ns", redact_url(F.col("url")).alias("url"), mask_secrets(F.col("title")).alias("title"))


def omitted_by_policy(records: DataFrame, now_ns: int, domains: list[str], minutes: int = 15) -> DataFrame:
    return records.where(eligible(now_ns, minutes) & ~permitted(F.col("url"), domains)).agg(F.count("*").alias("omitted"))


def did_user_visit(records: DataFrame, needle: str, domains: list[str]) -> DataFrame:
    """Permitted records whose URL has the needle in any case."""
    rows = records.where(F.contains(F.lower("url"), F.lit(needle.lower())) & permitted(F.col("url"), domains))
    return rows.select("seq", "timestamp_ns", redact_url(F.col("url")).alias("url"))


def list_browsers(events: DataFrame) -> DataFrame:
    return events.select("browser").distinct()
