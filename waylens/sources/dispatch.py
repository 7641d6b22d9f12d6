"""Whole profiles: every file to the reader of its name, and the union of what they find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylens.sources import binary, json_readers, leveldb, readers
from waylens.sources.sqlite import evidence_files, routed

#: A reader of SQLite tables by its name in ``readers.READERS``, or one of whole files.
Reader = str | Callable[[DataFrame], DataFrame]

#: Readers by what a file is called; a name may be an expression. Companions of a database go with it.
DISPATCH: dict[str, list[Reader]] = {
    r"History": ["chromium_visits", "chromium_downloads"], r"Cookies": ["chromium_cookies"], r"Extension Cookies": ["extension_cookies"], r"Login Data": ["chromium_logins"],
    r"Web Data": ["chromium_autofill", "chromium_cards", "chromium_server_cards", "chromium_tokens", "chromium_profiles"], r"Favicons": ["chromium_favicons"], r"Top Sites": ["chromium_top_sites"],
    r"Shortcuts": ["chromium_shortcuts"], r"Network Action Predictor": ["chromium_predictions"], r"Media History": ["chromium_media"], r"Reporting and NEL": ["chromium_reporting", readers.reporting_json],
    r"DIPS": [readers.chromium_bounces], r"Bookmarks": [readers.chromium_bookmarks], r"Preferences": [json_readers.preferences, json_readers.permissions], r"Network Persistent State": [json_readers.network_state],
    r"TransportSecurity": [json_readers.transport_security], r"Local State": [json_readers.profiles], r"manifest\.json": [json_readers.chromium_extensions], r"(Session|Tabs)_[0-9]+": [binary.chromium_session],
    r"places\.sqlite": ["firefox_visits", "firefox_bookmarks", "firefox_downloads", "firefox_annotations", "firefox_typed"], r"cookies\.sqlite": ["firefox_cookies"], r"formhistory\.sqlite": ["firefox_autofill"],
    r"permissions\.sqlite": ["firefox_permissions"], r"webappsstore\.sqlite": ["firefox_local_storage"], r"logins\.json": [json_readers.firefox_logins], r"extensions\.json": [json_readers.firefox_extensions],
    r"(sessionstore|recovery|previous)\.(js|jsonlz4|baklz4)": [json_readers.firefox_session], r"History\.db": ["safari_history"], r"Cookies\.db": ["safari_cookies"], r"Bookmarks\.plist": [binary.safari_bookmarks],
    r"Downloads\.plist": [binary.safari_downloads], r"Extensions\.plist": [binary.safari_extensions], r"TopSites\.plist": [binary.safari_top_sites],
    r"(prefs|user)\.js": [lambda files: readers.preference_lines(readers.lines_of(files))], r"SiteSecurityServiceState\.txt": [lambda files: readers.site_security_lines(readers.lines_of(files))],
    r"Local Storage/leveldb/[0-9]+\.(log|ldb)": [leveldb.local_storage], r"Session Storage/[0-9]+\.(log|ldb)": [leveldb.session_storage],
}
#: Files whose hosts survive a clearing of the history.
RESIDUE = ("Network Persistent State", "Reporting and NEL", "TransportSecurity", "DIPS", r"SiteSecurityServiceState\.txt")
#: The columns of events.
EVENT = "timestamp_ns bigint, browser string, artifact string, source string, description string, attrs_json string, attrs map<string,string>"


def read_all(files: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Events of all files (``path, content``, and ``modificationTime`` if there is one), each by the readers of its name; other
    files are left out.

    With ``names``, patterns of DISPATCH, only theirs. The files are scanned once, each routed by its name: rows of databases,
    and contents of other files, are written a folder a reader, and readers go on from there. Readers that no file or table is
    for don't come into the plan.
    """
    chosen = [p for p in DISPATCH if names is None or p in names]
    route = F.coalesce(*[F.when(F.col("path").rlike(rf"(^|/){p}(-wal)?$"), F.lit(i)) for i, p in enumerate(chosen)])
    changed = F.col("modificationTime") if "modificationTime" in files.columns else F.lit(None)
    own = files.select("path", "content", changed.cast("timestamp").alias("modificationTime"), route.alias("route")).where("route IS NOT NULL")
    by_name = [(i, r) for i, p in enumerate(chosen) for r in DISPATCH[p] if isinstance(r, str)]
    tables = {f"{r}__{t}": (i, t, ddl) for i, r in by_name for t, ddl in readers.READERS[r][0].items()}
    found, whole = routed(own, tables, {i for i, p in enumerate(chosen) if any(not isinstance(r, str) for r in DISPATCH[p])})
    none = lambda ddl: files.sparkSession.createDataFrame([], f"source string, {ddl}")
    out = None
    for i, pattern in enumerate(chosen):
        for r in DISPATCH[pattern]:
            if isinstance(r, str):
                needed, make = readers.READERS[r]
                if not any(f"{r}__{t}" in found for t in needed):
                    continue
                events = make({t: found[f"{r}__{t}"] if f"{r}__{t}" in found else none(ddl) for t, ddl in needed.items()})
            elif i in whole:
                events = r(whole[i])
            else:
                continue
            events = events.select("timestamp_ns", "browser", "artifact", "source", "description", "attrs_json", "attrs")
            out = events if out is None else out.unionByName(events)
    return files.sparkSession.createDataFrame([], EVENT) if out is None else out


def parse_profile(spark: SparkSession, path: str) -> DataFrame:
    """Events of a profile's folder."""
    return read_all(evidence_files(spark, path))


def recovered_domains(files: DataFrame) -> DataFrame:
    """``domain, source_artifact, source`` that state files name, of a profile's folder or its ``Network`` folder."""
    found = read_all(files, RESIDUE)
    name = F.coalesce(*[F.element_at("attrs", F.lit(k)) for k in ("domain", "host")])
    return found.select(name.alias("domain"), F.element_at("attrs", F.lit("source_artifact")).alias("source_artifact"), "source").where("domain IS NOT NULL")
