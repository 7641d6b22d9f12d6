"""The activity view: normalized events over the tables ``events`` and ``pages``, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: time in ns (0: untimed), url, browser, artifact, profile and the visit's links."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.count()
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    base = e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 97 == 0, F.lit(0)).otherwise(ns).cast("long").alias("timestamp_ns"),
        (F.col("event_id") % n).alias("page_id"),
        F.element_at(F.array(F.lit("Chromium"), F.lit("Firefox"), F.lit("Safari")), (F.col("user_id") % 3 + 1).cast("int")).alias("browser"),
        F.when(F.col("event_type").isin("click", "view"), "History").when(F.col("event_type") == "purchase", "Downloads").when(F.col("event_type") == "signup", "Autofill").otherwise("Cache").alias("artifact"),
        F.col("user_id").alias("profile"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("event_id") + 1).alias("visit_id"),
    ).join(pages, "page_id").drop("page_id")
    kept = Window.partitionBy("profile", "artifact").orderBy("seq")
    previous = F.when((F.col("artifact") == "History") & (F.col("k") % 7 != 0), F.coalesce(F.lag("visit_id").over(kept), F.lit(0))).otherwise(F.lit(0))
    return base.withColumns({
        "from_visit": previous.cast("long"),
        "is_redirect": F.col("k") % 5 == 0,
        "chain_end": F.col("k") % 10 == 0,
        "redirect_kind": F.when(F.col("k") % 5 == 0, F.when(F.col("k") % 2 == 0, "server").otherwise("client")),
        "description": F.concat(F.lit("visit "), F.col("url")),
        "source": F.concat(F.lit("profile/"), F.col("profile").cast("string")),
    })


def with_copies(events: DataFrame) -> DataFrame:
    """The events and a second copy of every fiftieth, as a second artifact of the same browser would report it."""
    return events.unionByName(events.where(F.col("seq") % 50 == 0).withColumn("seq", F.col("seq") + 1_000_000_000))


#: The same view for DuckDB; queries go after it.
SQL = """
WITH base AS (
  SELECT e.event_id AS seq, CASE WHEN e.event_id % 97 = 0 THEN 0 ELSE epoch_us(e.ts) * 1000 END AS timestamp_ns, p.url,
    CASE e.user_id % 3 WHEN 0 THEN 'Chromium' WHEN 1 THEN 'Firefox' ELSE 'Safari' END AS browser,
    CASE WHEN e.event_type IN ('click', 'view') THEN 'History' WHEN e.event_type = 'purchase' THEN 'Downloads' WHEN e.event_type = 'signup' THEN 'Autofill' ELSE 'Cache' END AS artifact,
    e.user_id AS profile, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k, e.event_id + 1 AS visit_id
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
ev AS (
  SELECT *, CASE WHEN artifact = 'History' AND k % 7 <> 0 THEN coalesce(lag(visit_id) OVER (PARTITION BY profile, artifact ORDER BY seq), 0) ELSE 0 END AS from_visit,
    k % 5 = 0 AS is_redirect, k % 10 = 0 AS chain_end, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'server' ELSE 'client' END END AS redirect_kind,
    'visit ' || url AS description, 'profile/' || profile AS source
  FROM base),
ev2 AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq) FROM ev WHERE seq % 50 = 0)
"""
