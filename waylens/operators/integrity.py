"""Integrity rules: signs of clearing and tampering in browser stores, one row for each indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.functions.times import webkit_micros
from waylens.operators.ordering import with_previous
from waylens.plans.scratch import cut
from waylens.sources.sqlite import integrity_failures, sqlite_tables


def cleared_history(urls: DataFrame, sequence: DataFrame) -> DataFrame:
    """``HistoryCleared`` for an empty table with a used sequence, ``AutoIncrementGap`` for a sequence above five times the
    largest id. Inputs have ``db`` and ``id``, and ``db`` and ``seq``."""
    most = urls.groupBy("db").agg(F.max("id").alias("max_id"))
    rows = sequence.join(most, "db", "left")
    tag = F.when(F.col("max_id").isNull() & (F.col("seq") > 0), "HistoryCleared").when((F.col("max_id") > 0) & (F.col("seq") > 5 * F.col("max_id")), "AutoIncrementGap")
    return rows.withColumn("tag", tag).where("tag IS NOT NULL").select("db", "tag", "seq", "max_id")


def _gap() -> Column:
    return F.when(F.col("id") - F.col("previous.id") > 1, F.struct(F.col("previous.id").alias("after_id"), F.col("id").alias("next_id")))


def _reversal() -> Column:
    return F.when(F.col("ts") < F.col("previous.ts"), F.struct("id", "ts", F.col("previous.ts").alias("before")))


def id_gaps(visits: DataFrame) -> DataFrame:
    """The first gap of visit ids in each ``db``: ``after_id, next_id``."""
    rows = with_previous(visits.select("db", "id"), "db", ["id"], ["id"])
    return rows.groupBy("db").agg(F.min(_gap()).alias("g")).where("g IS NOT NULL").select("db", "g.*")


def time_reversals(visits: DataFrame) -> DataFrame:
    """The first visit of each ``db`` whose time lies before that of the visit with the id before."""
    rows = with_previous(visits.select("db", "id", "ts"), "db", ["id"], ["ts"])
    return rows.groupBy("db").agg(F.min(_reversal()).alias("r")).where("r IS NOT NULL").select("db", "r.*")


def gaps_and_reversals(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``id_gaps`` and ``time_reversals`` find, of one pass in the order of ids, written once: a row a ``db``."""
    rows = with_previous(visits.select("db", "id", "ts"), "db", ["id"], ["id", "ts"])
    found = cut(rows.groupBy("db").agg(F.min(_gap()).alias("g"), F.min(_reversal()).alias("r")), "gaps")
    return found.where("g IS NOT NULL").select("db", "g.*"), found.where("r IS NOT NULL").select("db", "r.*")


def visit_count_mismatches(urls: DataFrame, visits: DataFrame) -> DataFrame:
    """URLs that claim more visits than are left; of each ``db`` if there are several."""
    db = [c for c in ("db",) if c in urls.columns]
    found = visits.groupBy(*db, F.col("url_id").alias("id")).agg(F.count("*").alias("found"))
    rows = urls.join(found, [*db, "id"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.where("visit_count > found").select(*db, "id", "visit_count", "found")


def last_visit_mismatches(urls: DataFrame, visits: DataFrame) -> DataFrame:
    """URLs whose recorded last visit isn't the latest one left; those without visits don't count."""
    db = [c for c in ("db",) if c in urls.columns]
    latest = visits.groupBy(*db, F.col("url_id").alias("id")).agg(F.max("ts").alias("latest"))
    return urls.join(latest, [*db, "id"]).where("last_visit > 0 AND last_visit <> latest").select(*db, "id", "last_visit", "latest")


def visit_mismatches(urls: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``visit_count_mismatches`` and ``last_visit_mismatches`` find in each ``db``, of one join, written once."""
    kept = visits.groupBy("db", F.col("url_id").alias("id")).agg(F.count("*").alias("found"), F.max("ts").alias("latest"))
    rows = urls.join(kept, ["db", "id"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    rows = cut(rows.where("visit_count > found OR (last_visit > 0 AND last_visit <> latest)"), "mismatches")
    return rows.where("visit_count > found").select("db", "id", "visit_count", "found"), rows.where("last_visit > 0 AND last_visit <> latest").select("db", "id", "last_visit", "latest")


def future_times(rows: DataFrame, limit: Column) -> DataFrame:
    return rows.where(F.col("ts") > limit)


def cookie_anomalies(cookies: DataFrame) -> DataFrame:
    """Cookies created after their last access. Values stay in the store's own epoch, times 1,000."""
    return cookies.where("last_access > 0 AND created > last_access").select("id", (F.col("created") * 1000).alias("created_ns"), (F.col("last_access") * 1000).alias("last_access_ns"))


def sequence_gaps(sequence: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose sequence is above their largest row id."""
    most = tables.groupBy("name").agg(F.max("rowid").alias("max_rowid"))
    rows = sequence.join(most, "name", "left").withColumn("max_rowid", F.coalesce("max_rowid", F.lit(0)))
    return rows.where("seq > max_rowid").select("name", "seq", "max_rowid")


def normalized_domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), r"\.+$", "")), r"^www\.", "")


def incognito_residue(residual: DataFrame, history: DataFrame) -> DataFrame:
    """Domains of state artifacts (``domain, source``) that no history row has."""
    rows = residual.select(normalized_domain(F.col("domain")).alias("domain"), "source").where("domain <> ''").distinct()
    return rows.join(history.select(normalized_domain(F.col("domain")).alias("domain")), "domain", "left_anti")


def deleted_bookmarks(backups: DataFrame, current: DataFrame) -> DataFrame:
    """The newest backup (``url, title, backup_date, name``) of each URL that is no bookmark now."""
    newest = backups.groupBy("url").agg(F.max_by(F.struct("title", "backup_date", "name"), F.struct("backup_date", "name")).alias("b")).select("url", "b.*")
    return newest.join(current.select("url"), "url", "left_anti")


def _number(at: int, n: int) -> Column:
    """A number of the header of ``content``, which begins at 1."""
    return F.conv(F.hex(F.expr(f"substring(content, {at}, {n})")), 16, 10).cast("long")


def _databases(files: DataFrame) -> DataFrame:
    return files.where(F.expr("substring(content, 1, 15)") == F.lit(b"SQLite format 3"))


def header_anomalies(files: DataFrame) -> DataFrame:
    """``ChangeCounterMismatch`` and ``HeaderVersionAnomaly`` of SQLite files (``path, content``), from header bytes."""
    rows = _databases(files).select("path", _number(25, 4).alias("changes"), _number(93, 4).alias("valid_for"), _number(19, 1).alias("write_version"), _number(20, 1).alias("read_version"))
    tags = F.array(
        F.when((F.col("valid_for") != 0) & (F.col("valid_for") != F.col("changes")), "ChangeCounterMismatch"),
        F.when(~F.col("write_version").isin(1, 2) | ~F.col("read_version").isin(1, 2), "HeaderVersionAnomaly"),
    )
    return rows.withColumn("tag", F.explode(F.filter(tags, lambda x: x.isNotNull())))


def page_anomalies(files: DataFrame) -> DataFrame:
    """``FreelistGrowth`` of files with free pages, and ``PageCountMismatch`` where the header's count of pages, if it is
    valid, isn't what the file's length says: ``path, tag, free_pages, header_pages, file_pages``. Where a listing tells the
    ``length``, 100 bytes of content are enough."""
    length = F.col("length") if "length" in files.columns else F.octet_length("content")
    size = F.when(_number(17, 2) == 1, 65536).otherwise(_number(17, 2))
    rows = _databases(files).select("path", _number(37, 4).alias("free_pages"), _number(29, 4).alias("header_pages"), F.floor(length / size).alias("file_pages"), (_number(25, 4) == _number(93, 4)).alias("valid"))
    tags = F.array(F.when(F.col("free_pages") > 0, "FreelistGrowth"), F.when(F.col("valid") & (F.col("header_pages") > 0) & (F.col("header_pages") != F.col("file_pages")), "PageCountMismatch"))
    return rows.withColumn("tag", F.explode(F.filter(tags, lambda x: x.isNotNull()))).drop("valid")


def logs_present(files: DataFrame) -> DataFrame:
    """``WalPresent`` for write-ahead logs with bytes in them, beside their database."""
    return files.where(F.col("path").endswith("-wal") & (F.octet_length("content") > 0)).select("path", F.lit("WalPresent").alias("tag"))


def tombstones(rows: DataFrame) -> DataFrame:
    """``HistoryTombstoneFound`` for each URL of the deletion records ``source, url``; they hold no usable time."""
    return rows.where("url IS NOT NULL").select(F.col("source").alias("path"), F.lit("HistoryTombstoneFound").alias("tag"), "url", F.lit(0).cast("long").alias("deleted_at_ns"))


#: Tables of which recovered rows count as deleted history.
HISTORY_TABLES = ("urls", "visits", "moz_places", "moz_historyvisits", "history_items", "history_visits")


def recovered_history(carved: DataFrame, live: DataFrame) -> DataFrame:
    """``RecoveredDeletedHistory`` for each file and history table with recovered rows (``path, table``), beside how many rows
    (``path, table, rows``) are left."""
    found = carved.where(F.col("table").isin(*HISTORY_TABLES)).groupBy("path", "table").agg(F.count("*").alias("recovered_rows"))
    joined = found.join(live.select("path", "table", F.col("rows").alias("live_rows")), ["path", "table"], "left")
    return joined.select("path", F.lit("RecoveredDeletedHistory").alias("tag"), "table", "recovered_rows", F.coalesce("live_rows", F.lit(0)).alias("live_rows"))


#: For each tag what was seen, with the indicator's details in braces, and what harmless cause would leave the same.
TEXTS = {
    "HistoryCleared": ("history tables hold nothing, yet {seq} rows were once numbered", "clearing through the browser's own menu, a retention rule, or a new profile"),
    "AutoIncrementGap": ("{seq} rows were numbered, the highest left is {max_id}", "ordinary deletion of the newest rows, or inserts rolled back after a crash"),
    "VisitIdGap": ("ids go from {after_id} to {next_id}", "ordinary deletion, expiry, or a transaction rolled back; ids aren't given out again"),
    "TimestampNonMonotonic": ("row {id} has time {ts}, before the time {before} of the row in front of it", "clock changes, or history synced or imported from another device"),
    "CookieTimestampAnomaly": ("cookie {id} was created at {created_ns}, after its last access at {last_access_ns}", "a clock set between two writes, or an imported cookie"),
    "WalPresent": ("a log with content lies beside the database", "the browser was running, or the copy was made before a checkpoint"),
    "SqliteIntegrityFailure": ("the file's own check says: {message}", "a crash, a loss of power, a fault of the disk, or a copy of a live file"),
    "HistoryTombstoneFound": ("a deletion record names {url}", "ordinary bookkeeping of deletions, also those of another device"),
    "FreelistGrowth": ("{free_pages} of {file_pages} pages are free", "ordinary deletion without compaction, expiry, or changes of indexes"),
    "PageCountMismatch": ("the header counts {header_pages} pages, the file has {file_pages}", "a write cut short, a copy amid a checkpoint, or bytes that a backup added"),
    "VisitCountMismatch": ("URL {id} claims {visit_count} visits, {found} are left", "visits that expired while their URL stayed, or syncing"),
    "LastVisitMismatch": ("URL {id} claims a last visit at {last_visit}, the latest left is at {latest}", "expiry of visits, a write cut short, or syncing"),
    "TimestampInFuture": ("row {id} has time {ts}, after the file was last written", "a clock set wrong, or a row from a device ahead of time"),
    "ChangeCounterMismatch": ("the header's change counter is {changes}, it was valid for {valid_for}", "an old library, or one that doesn't keep the second number"),
    "HeaderVersionAnomaly": ("the header's versions are {write_version} and {read_version}", "a fault of the disk or a torn write"),
    "SqliteSequenceGap": ("{seq} rows of {name} were numbered, the highest left is {max_rowid}", "ordinary deletion of the newest rows, or an insert rolled back"),
    "IncognitoResidue": ("{domain} is in {residue_of}, but in no history", "history that was cleared later, or contacts that no history records"),
    "RecoveredDeletedHistory": ("{recovered_rows} deleted rows of {table} were recovered, {live_rows} are left", "deletion of single entries, or expiry"),
}


def explained(indicators: DataFrame) -> DataFrame:
    """``path, tag, observation, alternative, detail`` of indicators ``path, tag`` and details in other columns."""
    details = [c for c in indicators.columns if c not in ("path", "tag")]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in details]
    detail = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    kinds = indicators.sparkSession.createDataFrame([(t, o, a) for t, (o, a) in TEXTS.items()], "tag string, __seen string, alternative string")
    said = F.aggregate(F.map_entries("detail"), F.col("__seen"), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    rows = indicators.select("path", "tag", detail.alias("detail")).join(F.broadcast(kinds), "tag", "left")
    return rows.select("path", "tag", F.concat("path", F.lit(": "), F.coalesce(said, F.lit("an indicator of this kind"))).alias("observation"), "alternative", "detail")


def tamper_indicators(files: DataFrame) -> DataFrame:
    """All rules over SQLite files (``path, modificationTime, content``): ``path, tag, observation, alternative, detail``.

    Each file is opened once for its tables; header rules read bytes alone, which are written once. Rules that need the same
    order or join take it from one pass.
    """
    tables = sqlite_tables(files, {
        "urls": "id bigint, visit_count bigint, last_visit_time bigint", "visits": "id bigint, url bigint, visit_time bigint", "moz_historyvisits": "id bigint, visit_date bigint",
        "sqlite_sequence": "name string, seq bigint", "history_tombstones": "url string", "cookies": "rowid bigint, creation_utc bigint, last_access_utc bigint",
    })
    urls = tables["urls"].select(F.col("source").alias("db"), "id", "visit_count", F.col("last_visit_time").alias("last_visit"))
    visits = tables["visits"].select(F.col("source").alias("db"), "id", F.col("url").alias("url_id"), F.col("visit_time").alias("ts"))
    others = tables["moz_historyvisits"].select(F.col("source").alias("db"), "id", F.col("visit_date").alias("ts"))
    every = visits.select("db", "id", "ts").unionByName(others)
    sequence = tables["sqlite_sequence"].select(F.col("source").alias("db"), "name", "seq")
    named = lambda rows, tag: rows.withColumnRenamed("db", "path").withColumn("tag", F.lit(tag))
    heads = cut(files.select("path", "modificationTime", F.octet_length("content").alias("length"), F.substring("content", 1, 100).alias("content")), "heads")
    gaps, reversals = gaps_and_reversals(every)
    counts, lasts = visit_mismatches(urls, visits)
    written = heads.select(F.col("path").alias("db"), (F.unix_micros("modificationTime") + 11_644_473_600_000_000).alias("limit"))
    future = visits.join(written, "db").where(F.col("ts") > F.col("limit")).drop("limit", "url_id")
    cookies = tables["cookies"].where("last_access_utc > 0 AND creation_utc > last_access_utc").select(F.col("source").alias("path"), F.lit("CookieTimestampAnomaly").alias("tag"), F.col("rowid").alias("id"), webkit_micros(F.col("creation_utc")).alias("created_ns"), webkit_micros(F.col("last_access_utc")).alias("last_access_ns"))
    found = [
        page_anomalies(heads), header_anomalies(heads), logs_present(heads), tombstones(tables["history_tombstones"]), cookies,
        integrity_failures(files).select(F.col("source").alias("path"), F.lit("SqliteIntegrityFailure").alias("tag"), "message"),
        cleared_history(urls.select("db", "id"), sequence.where("name = 'urls'").select("db", "seq")).withColumnRenamed("db", "path"),
        named(gaps, "VisitIdGap"), named(reversals, "TimestampNonMonotonic"),
        named(counts, "VisitCountMismatch"), named(lasts, "LastVisitMismatch"), named(future, "TimestampInFuture"),
    ]
    out = None
    for rows in found:
        said = explained(rows)
        out = said if out is None else out.unionByName(said)
    return out
