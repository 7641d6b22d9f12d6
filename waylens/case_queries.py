"""Queries over constructed cases: indicators, memory, profiles, integrity, recovery, reports and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import stores as evidence
from waylens import reader_queries as rq
from waylens.functions import text as tx
from waylens.functions import urls as ur
from waylens.functions.cookies import interpret_cookie
from waylens.operators import catalog, findings, indicators, integrity, profiles, reports, search
from waylens.plans.activity import SQL, activity, table, with_copies
from waylens.plans.model import ARTIFACTS
from waylens.plans.scratch import scratch_path
from waylens.queries import DOMAIN, HOST, KINDS_SQL, QUOTED, STAMP
from waylens.sources import cache, detection, discovery, dispatch, manifest, ordered, readers, safari_cache, stylesheets, windows, writers
from waylens.sources.sqlite import evidence_files, integrity_failures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = evidence.duckdb(sql)
        return f

    return register


#: A text for each event with an indicator of every kind (some of them wrong), and where each stands.
PARTS = {
    "email": "concat('u', CAST(event_id AS STRING), '@mail.example')", "ipv4": "concat('10.0.', CAST(event_id % 300 AS STRING), '.7')", "ipv6": "concat('2001:db8::', CAST(event_id % 9999 AS STRING))",
    "card": "CASE WHEN event_id % 3 = 0 THEN '4111111111111112' ELSE '4111111111111111' END", "eth": "concat('0x', CASE WHEN event_id % 2 = 0 THEN 'ab' ELSE 'aB' END, rpad(CAST(event_id AS STRING), 38, '0'))",
    "btc_base58": "CASE WHEN event_id % 4 = 0 THEN '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb' ELSE '1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa' END", "btc_bech32": "CASE WHEN event_id % 5 = 0 THEN 'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5' ELSE 'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4' END",
    "search_term": "concat('https://www.bing.com/search?q=word+', CAST(event_id AS STRING))",
}
_JOINED = ", ' | ', ".join(PARTS.values())
TEXTS = f"SELECT event_id AS seq, concat('é ', {_JOINED}, ' end') AS text FROM {{events}}"
_HOLDS = {"ipv4": "event_id % 300 <= 255", "card": "event_id % 3 > 0", "btc_base58": "event_id % 4 > 0", "btc_bech32": "event_id % 5 > 0"}
_NOTES = {"card": "'Luhn-valid'", "btc_base58": "'checksum-valid'", "btc_bech32": "'checksum-valid'", "eth": "CASE WHEN event_id % 2 = 0 THEN 'no checksum' ELSE 'mixed case, checksum not verified' END", "search_term": "'Bing'"}


def _planted(*kinds: str) -> str:
    """SQL of what the texts hold: each part begins three bytes after the mark, and after those before it."""
    rows = []
    for i, (kind, value) in enumerate(PARTS.items()):
        if kind in kinds:
            before = " + ".join(["3", *[f"length({v}) + 3" for v in list(PARTS.values())[:i]]])
            shown = "'word ' || event_id" if kind == "search_term" else value
            rows.append(f"SELECT event_id AS seq, '{kind}' AS kind, {shown} AS value, CAST({before} AS BIGINT) AS \"offset\", {_NOTES.get(kind, 'CAST(NULL AS VARCHAR)')} AS note FROM events WHERE {_HOLDS.get(kind, 'true')}")
    return " UNION ALL ".join(rows)


@query(_planted(*PARTS))
def ioc_planted(spark, sf_dir):
    return indicators.all_indicators(evidence.select(spark, sf_dir, TEXTS))


for _kind in ("ipv6", "btc", "eth", "search_term"):
    _kinds = ("btc_base58", "btc_bech32") if _kind == "btc" else (_kind,)

    def _one(spark, sf_dir, kinds=_kinds):
        found = indicators.all_indicators(evidence.select(spark, sf_dir, TEXTS), kinds=tuple(k for k in kinds if k in indicators.KINDS) or ("eth",))
        return found.where(F.col("kind").isin(*kinds))

    QUERIES[f"ioc_planted_{_kind}"] = _one
    ORACLE_SQL[f"ioc_planted_{_kind}"] = _planted(*_kinds)


for _kind, _find in (("ipv6", indicators.ipv6), ("btc", indicators.bitcoin), ("eth", indicators.ethereum)):
    _kinds = ("btc_base58", "btc_bech32") if _kind == "btc" else (_kind,)

    def _alone(spark, sf_dir, find=_find):
        return find(evidence.select(spark, sf_dir, TEXTS)).select("seq", "value", "offset")

    QUERIES[f"ioc_{_kind}"] = _alone
    ORACLE_SQL[f"ioc_{_kind}"] = f'SELECT seq, value, "offset" FROM ({_planted(*_kinds)})'


@query("SELECT seq, 'description' AS field, kind, value, \"offset\", note FROM (" + _planted(*PARTS) + ")")
def event_indicators(spark, sf_dir):
    rows = evidence.select(spark, sf_dir, TEXTS)
    return indicators.event_indicators(rows.select("seq", F.lit(1).cast("long").alias("timestamp_ns"), F.lit("Chromium").alias("browser"), F.lit("History").alias("artifact"), F.col("text").alias("description")))


@query(SQL + "SELECT seq, f.field, " + HOST.format("url") + " AS host FROM ev, (VALUES ('description'), ('url')) f(field) WHERE regexp_matches(url, '^https?://')")
def event_hosts(spark, sf_dir):
    return search.event_hosts(activity(spark, sf_dir))


@query(SQL + "SELECT k.rule_id, 'observed_string' AS action, count(*) AS n FROM (SELECT * FROM ev WHERE seq % 4 > 0) e JOIN (VALUES ('History', 'find.history.live.v1'), ('Downloads', 'find.download.live.v1'), ('Autofill', 'find.history.live.v1'), ('Cache', 'find.cache.live.v1')) k(artifact, rule_id) ON k.artifact = e.artifact GROUP BY 1")
def indicator_hits(spark, sf_dir):
    texts = evidence.select(spark, sf_dir, TEXTS)
    found = indicators.all_indicators(texts, kinds=("btc_base58",)).where("kind = 'btc_base58'")
    return search.indicator_hits(activity(spark, sf_dir), found).groupBy("rule_id", "action").agg(F.count("*").alias("n"))


MEMORY = "SELECT page_id, concat('p', CAST(page_id AS STRING)) AS path, concat('x', chr(0), 'https://m', CAST(page_id AS STRING), '.example/a?u=http://in.example/', CAST(page_id AS STRING), chr(0), 'Cookie:  id=', CAST(page_id AS STRING), ' ', chr(13), chr(10), '\"https://q.example/\"') AS text FROM {pages}"


def _memory(spark, sf_dir):
    """All texts in a few raw files, read in ranges far shorter than a file: many a match lies across the end of one."""
    folder = scratch_path(spark, "memory")
    evidence.select(spark, sf_dir, MEMORY).select("text").write.text(folder)
    return windows.read_windows(spark, folder, window=4096, overlap=1024, task_bytes=1 << 20)


@query("SELECT u.url, CAST(count(*) AS BIGINT) AS n FROM pages, LATERAL (VALUES ('https://m' || page_id || '.example/a?u=http://in.example/' || page_id), ('http://in.example/' || page_id), ('https://q.example/')) u(url) GROUP BY 1")
def memory_urls(spark, sf_dir):
    return indicators.url_matches(_memory(spark, sf_dir)).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT 'id=' || page_id AS cookie, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1")
def memory_cookies(spark, sf_dir):
    return indicators.cookie_matches(_memory(spark, sf_dir)).groupBy("cookie").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id AS pid, event_type AS process FROM events WHERE event_id % 7 > 0")
def memory_processes(spark, sf_dir):
    return indicators.processes(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("pid"), F.col("event_type").alias("process")))


@query(SQL + "SELECT seq FROM ev WHERE contains(lower(url), 'blog')")
def needle_filter(spark, sf_dir):
    return search.needle(activity(spark, sf_dir), "BLOG").select("seq")


CARVED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('https://', event_type, '.example/') END AS url, CASE WHEN event_id % 2 = 0 THEN concat('a ', event_type) END AS title FROM {events}"


@query(f"WITH c AS ({CARVED}) SELECT event_id AS row, 'click' AS term, CASE WHEN contains(url, 'click') THEN url ELSE title END AS match FROM c WHERE contains(url, 'click') OR contains(title, 'click')")
def carved_hits(spark, sf_dir):
    rows = evidence.select(spark, sf_dir, CARVED).select(F.col("event_id").alias("row"), F.map_filter(F.create_map(F.lit("url"), "url", F.lit("title"), "title"), lambda k, v: v.isNotNull()).alias("fields"))
    return search.carved_hits(rows, ["click"])


# many terms from a file

#: Twenty pieces of each page's url, and a short one of some; the file has comments and blanks besides.
MANY_TERMS = (
    "SELECT concat(CASE WHEN i % 3 = 0 THEN '  ' ELSE '' END, substr(url, CAST(1 + (page_id * 7 + i * 5) % greatest(length(url) - 4, 1) AS INT), CAST(9 + (page_id + i) % 17 AS INT))) AS value FROM {pages} CROSS JOIN (SELECT explode(sequence(0, 19)) AS i) "
    "UNION ALL SELECT substr(url, CAST(9 + page_id % 5 AS INT), CAST(1 + page_id % 3 AS INT)) FROM {pages} WHERE page_id % 125 = 0 UNION ALL SELECT concat('# page ', CAST(page_id AS STRING)) FROM {pages} UNION ALL SELECT '  ' FROM {pages}"
)


def _terms(spark, sf_dir):
    folder = scratch_path(spark, "terms")
    evidence.select(spark, sf_dir, MANY_TERMS).write.text(folder)
    return search.read_terms(spark, folder)


@query(SQL + f", terms AS (SELECT DISTINCT trim(value) AS term FROM ({MANY_TERMS.replace('(SELECT explode(sequence(0, 19)) AS i)', 'range(20) t(i)')}) WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%') "
       f"SELECT e.seq, t.term, e.timestamp_ns, e.browser, e.url AS match, k.evidence_source, k.state, k.basis, k.action, k.confidence, k.rule_id FROM ev e JOIN (SELECT url, term FROM (SELECT DISTINCT url FROM ev) u JOIN terms ON contains(u.url, term)) t ON t.url = e.url JOIN {KINDS_SQL} ON k.artifact = e.artifact")
def find_many_terms(spark, sf_dir):
    return search.find_many(activity(spark, sf_dir), _terms(spark, sf_dir), ["url"])


# profiles

def _profiles(spark, sf_dir):
    return readers.discover_profiles(evidence.select(spark, sf_dir, rq.PATHS))


FOUND = "(" + rq.ORACLE_SQL["read_discovery"] + ") p"


@query(f"SELECT browser, profile, path, \"user\" FROM {FOUND} WHERE browser = 'Chromium' AND profile = 'Profile 0' AND \"user\" = 'u7'")
def select_profiles(spark, sf_dir):
    return profiles.select_profiles(_profiles(spark, sf_dir), "Brave", "chrome/profile 0", "U7").select("browser", "profile", "path", "user")


NAMES = ("History", "Login Data", "places.sqlite", "cookies.sqlite", "History.db", "logins.json", "notes.txt")
FILES = "SELECT event_id, concat('/home/u/', element_at(array('Chrome', 'Mozilla', 'Safari', 'other'), CAST(event_id % 4 + 1 AS INT)), '/', element_at(array(" + ", ".join(f"'{n}'" for n in NAMES) + "), CAST(event_id % 7 + 1 AS INT))) AS path FROM {events}"
FILES_DUCK = "SELECT event_id, '/home/u/' || ['Chrome', 'Mozilla', 'Safari', 'other'][CAST(event_id % 4 + 1 AS INT)] || '/' || [" + ", ".join(f"'{n}'" for n in NAMES) + "][CAST(event_id % 7 + 1 AS INT)] AS path, event_id % 4 AS f, event_id % 7 AS n FROM events"


@query(f"WITH p AS ({FILES_DUCK}) SELECT event_id, CASE WHEN f = 2 AND n = 4 THEN 'Safari' WHEN f = 0 AND n IN (0, 1) THEN 'Chromium' WHEN n = 2 THEN 'Firefox' WHEN f = 1 AND n IN (3, 5) THEN 'Firefox' END AS family, CASE WHEN n = 4 THEN 'Safari' WHEN n IN (2, 3, 5) THEN 'Firefox' END AS by_name FROM p")
def detect_browser(spark, sf_dir):
    rows = evidence.select(spark, sf_dir, FILES)
    return rows.select("event_id", profiles.detect_browser(F.col("path")).alias("family"), profiles.browser_of_name(F.col("path")).alias("by_name"))


@query(f"SELECT e.event_id AS seq, CASE p.browser WHEN 'Chromium' THEN 'Chrome' WHEN 'InternetExplorer' THEN 'IE' ELSE p.browser END || '/' || p.profile AS origin_profile, p.\"user\" AS origin_user FROM (SELECT event_id, regexp_replace(path, '/[^/]+$', '') AS folder FROM ({evidence.duckdb(rq.PATHS).replace('SELECT ', 'SELECT event_id, ', 1)})) e LEFT JOIN (SELECT path, min(browser) AS browser, min(profile) AS profile, min(\"user\") AS \"user\" FROM {FOUND} GROUP BY 1 HAVING count(*) = 1) p ON p.path = e.folder")
def stamp_origin(spark, sf_dir):
    found = _profiles(spark, sf_dir)
    alone = found.groupBy("path").agg(F.min("browser").alias("browser"), F.min("profile").alias("profile"), F.min("user").alias("user"), F.count("*").alias("n")).where("n = 1").drop("n")
    rows = evidence.select(spark, sf_dir, rq.PATHS.replace("SELECT ", "SELECT event_id AS seq, ", 1)).withColumnRenamed("path", "source")
    return profiles.stamp_origin(rows, alone).select("seq", "origin_profile", "origin_user")


@query(SQL + "SELECT seq, artifact, browser FROM ev WHERE NOT (artifact = 'History' AND browser = 'Firefox') UNION ALL SELECT seq + 5000000, artifact, browser FROM ev WHERE artifact = 'History' AND browser = 'Firefox' AND is_redirect")
def prefer_visits(spark, sf_dir):
    e = activity(spark, sf_dir)
    detail = e.where("artifact = 'History' AND browser = 'Firefox' AND is_redirect").withColumn("seq", F.col("seq") + 5_000_000)
    return profiles.prefer_visits(e, detail).select("seq", "artifact", "browser")


@query(SQL + "SELECT url, 'visit' AS kind, timestamp_ns, is_redirect, chain_end FROM ev WHERE browser = 'Chromium' AND artifact = 'History'")
def assistant_records(spark, sf_dir):
    return profiles.records(activity(spark, sf_dir)).select("url", "kind", "timestamp_ns", "is_redirect", "chain_end")


# integrity

_FOUR = "lpad(hex(CAST({} AS BIGINT)), 8, '0')"
HEADERS = (
    "SELECT event_id, concat('f', CAST(event_id AS STRING)) AS path, concat('53514C69746520666F726D6174203300', '0200', '0', CAST(event_id % 4 AS STRING), '01', '00402020', "
    + ", ".join([_FOUR.format("event_id % 5 + 1"), _FOUR.format("event_id % 3 + 1"), "'00000000'", _FOUR.format("event_id % 2"), "repeat('00', 52)", _FOUR.format("event_id % 4 + 1"), "'002E6300'"]) + ", repeat('00', 412), repeat('00', 512)) AS hexed FROM {events}"
)


def _headers(spark, sf_dir):
    return evidence.select(spark, sf_dir, HEADERS).select("path", F.unhex("hexed").alias("content"))


@query("SELECT 'f' || event_id AS path, t.tag, event_id % 2 AS free_pages, event_id % 3 + 1 AS header_pages, CAST(2 AS BIGINT) AS file_pages FROM events, (VALUES ('FreelistGrowth'), ('PageCountMismatch')) t(tag) WHERE CASE t.tag WHEN 'FreelistGrowth' THEN event_id % 2 > 0 ELSE event_id % 5 = event_id % 4 AND event_id % 3 <> 1 END")
def page_anomalies(spark, sf_dir):
    return integrity.page_anomalies(_headers(spark, sf_dir))


@query("SELECT 'f' || event_id AS path, t.tag FROM events, (VALUES ('ChangeCounterMismatch'), ('HeaderVersionAnomaly')) t(tag) WHERE CASE t.tag WHEN 'ChangeCounterMismatch' THEN event_id % 5 <> event_id % 4 ELSE event_id % 4 IN (0, 3) END")
def header_anomalies(spark, sf_dir):
    return integrity.header_anomalies(_headers(spark, sf_dir)).select("path", "tag")


@query("SELECT 'h' || event_id || '-wal' AS path, 'WalPresent' AS tag FROM events WHERE event_id % 3 = 1")
def logs_present(spark, sf_dir):
    name = F.concat(F.lit("h"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise("-wal"))
    return integrity.logs_present(table(spark, sf_dir, "events").select(name.alias("path"), F.when(F.col("event_id") % 3 == 1, "x").otherwise("").cast("binary").alias("content")))


_STORES = {
    "urls": rq.URLS, "visits": rq.VISITS, "sqlite_sequence": f"SELECT DISTINCT {rq.STORE}, 'urls' AS name, CAST(CASE WHEN event_id < 2500 THEN 99999999 ELSE 5 END AS BIGINT) AS seq FROM {{events}}",
    "history_tombstones": f"SELECT {rq.STORE}, concat('https://gone', CAST(event_id AS STRING), '.example/') AS url FROM {{events}} WHERE event_id % 100 = 3",
    "cookies": f"SELECT {rq.STORE}, event_id AS rowid, {rq.WEBKIT} AS creation_utc, {rq.WEBKIT} + CASE WHEN event_id % 50 = 7 THEN -9 ELSE 9 END AS last_access_utc FROM {{events}}",
}
#: When the files were last written: 900 s after the first visit.
_WRITTEN = 1_705_527_300
_TAMPER = ", ".join(f"{t} AS ({evidence.duckdb(sql)})" for t, sql in _STORES.items())


@query(
    f"WITH {_TAMPER}, v AS (SELECT store, url, count(*) AS n, max(visit_time) AS latest FROM visits GROUP BY 1, 2), r AS (SELECT store, id, visit_time, lag(visit_time) OVER (PARTITION BY store ORDER BY id) AS before FROM visits) "
    f"SELECT 'profile/' || store AS path, tag, 'profile/' || store || ': ' || said AS observation, alternative FROM ("
    "SELECT u.store, 'VisitCountMismatch' AS tag, 'URL ' || u.id || ' claims ' || visit_count || ' visits, ' || coalesce(n, 0) || ' are left' AS said FROM urls u LEFT JOIN v ON v.store = u.store AND v.url = u.id WHERE visit_count > coalesce(n, 0) UNION ALL "
    "SELECT u.store, 'LastVisitMismatch', 'URL ' || u.id || ' claims a last visit at ' || last_visit_time || ', the latest left is at ' || latest FROM urls u JOIN v ON v.store = u.store AND v.url = u.id WHERE last_visit_time > 0 AND last_visit_time <> latest UNION ALL "
    "SELECT store, 'TimestampNonMonotonic', 'row ' || min(id) || ' has time ' || arg_min(visit_time, id) || ', before the time ' || arg_min(before, id) || ' of the row in front of it' FROM r WHERE visit_time < before GROUP BY 1 UNION ALL "
    f"SELECT store, 'TimestampInFuture', 'row ' || id || ' has time ' || visit_time || ', after the file was last written' FROM visits WHERE visit_time > {_WRITTEN * 1_000_000 + 11_644_473_600_000_000} UNION ALL "
    "SELECT store, 'CookieTimestampAnomaly', 'cookie ' || rowid || ' was created at ' || (creation_utc - 11644473600000000) * 1000 || ', after its last access at ' || (last_access_utc - 11644473600000000) * 1000 FROM cookies WHERE creation_utc > last_access_utc UNION ALL "
    "SELECT store, 'HistoryTombstoneFound', 'a deletion record names ' || url FROM history_tombstones UNION ALL "
    "SELECT s.store, 'AutoIncrementGap', seq || ' rows were numbered, the highest left is ' || m FROM sqlite_sequence s JOIN (SELECT store, max(id) AS m FROM urls GROUP BY 1) USING (store) WHERE seq > 5 * m) JOIN (VALUES " + ", ".join(f"('{t}', '{a.replace(chr(39), chr(39) * 2)}')" for t, (_, a) in integrity.TEXTS.items()) + ") x(tag, alternative) USING (tag)"
)
def tamper_indicators(spark, sf_dir):
    files = evidence.sqlite_stores({t: evidence.select(spark, sf_dir, sql) for t, sql in _STORES.items()}).withColumn("modificationTime", F.timestamp_seconds(F.lit(_WRITTEN)))
    return integrity.tamper_indicators(files).select("path", "tag", "observation", "alternative")


@query(f"SELECT DISTINCT 'profile/' || store AS source FROM ({evidence.duckdb(rq.URLS)}) WHERE store % 2 = 1 AND (SELECT count(*) FROM events) > 2500")
def broken_databases(spark, sf_dir):
    """Files whose second page is overwritten in every other store."""
    files = evidence.sqlite_stores({"urls": evidence.select(spark, sf_dir, rq.URLS)})
    odd = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 2 == 1
    broken = F.concat(F.expr("substring(content, 1, 4096)"), F.unhex(F.repeat(F.lit("FF"), 64)), F.expr("substring(content, 4161)"))
    return integrity_failures(files.withColumn("content", F.when(odd, broken).otherwise(F.col("content")))).select("source").distinct()


@query("WITH c AS (SELECT user_id % 3 AS f, CASE WHEN event_type = 'click' THEN 'urls' WHEN event_type = 'view' THEN 'visits' ELSE 'other' END AS t, event_id % 2 AS kept FROM events) SELECT 'f' || f AS path, 'RecoveredDeletedHistory' AS tag, t AS \"table\", count(*) FILTER (WHERE kept = 0) AS recovered_rows, count(*) FILTER (WHERE kept = 1 AND t = 'urls') AS live_rows FROM c WHERE t <> 'other' GROUP BY 1, 3")
def recovered_history(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "urls").when(F.col("event_type") == "view", "visits").otherwise("other")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("path"), kind.alias("table"), (F.col("event_id") % 2).alias("kept"))
    live = rows.where("kept = 1 AND table = 'urls'").groupBy("path", "table").agg(F.count("*").alias("rows"))
    return integrity.recovered_history(rows.where("kept = 0"), live)


@query(SQL + "SELECT seq, regexp_extract(url, '^[^:]*://([^/?#:@]*)', 1) AS host FROM ev")
def tamper_hosts(spark, sf_dir):
    return activity(spark, sf_dir).select("seq", ur.authority_host(F.col("url")).alias("host"))


# recovery and reports

KINDS = ("Carved", "Cache", "RecoveredDomain", "RecoveredBookmark", "Memory", "History")
RECOVERED = "SELECT event_id AS seq, event_id % 6 AS k, event_id % 4 AS m, concat('d', CAST(event_id AS STRING)) AS description, concat('u', CAST(user_id AS STRING)) AS url FROM {events}"


def _recovered(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("k") + 1).cast("int"))
    rows = evidence.select(spark, sf_dir, RECOVERED)
    quality, method = F.when(F.col("m") % 2 == 0, F.when(F.col("k") == 0, "complete").otherwise("full")).otherwise("partial"), F.when(F.col("m") == 3, "wal").otherwise("free_page")
    return rows.select("seq", kind.alias("artifact"), F.lit("Chromium").alias("browser"), "description", "url", F.col("url").alias("domain"), F.lit("DIPS").alias("source_artifact"), quality.alias("recovery_quality"), method.alias("recovery_method"), F.lit(0).alias("timestamp_ns"), F.lit("s").alias("source"))


@query(
    f"WITH r AS ({RECOVERED}) SELECT seq, ['medium', 'info', 'info', 'medium', 'info'][CAST(k + 1 AS INT)] AS priority, CASE WHEN k = 3 THEN 'medium' WHEN k IN (2, 4) THEN 'low' WHEN m % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence, "
    "['recover.carve.deleted_record.v1', 'recover.cache_carve.evicted.v1', 'recover.recovered_domain.v1', 'recover.deleted_bookmark.v1', 'recover.memory.carved.v1'][CAST(k + 1 AS INT)] AS rule_id, "
    "CASE WHEN k = 0 AND m = 3 THEN 'deleted' ELSE ['carved', 'deleted', 'inferred', 'deleted', 'carved'][CAST(k + 1 AS INT)] END AS state, CASE WHEN k = 2 THEN url || ' (recovered from DIPS)' WHEN k IN (0, 1) THEN description ELSE url END AS evidence FROM r WHERE k < 5"
)
def recovery_findings(spark, sf_dir):
    return findings.recovery_findings(_recovered(spark, sf_dir)).select("seq", "priority", "confidence", "rule_id", "state", "evidence")


@query(f"WITH r AS ({RECOVERED}) SELECT DISTINCT ['recover.carve.deleted_record.v1', 'recover.cache_carve.evicted.v1', 'recover.recovered_domain.v1', 'recover.deleted_bookmark.v1', 'recover.memory.carved.v1'][CAST(k + 1 AS INT)] AS rule_id FROM r WHERE k < 5")
def rule_versions(spark, sf_dir):
    return reports.rule_versions(findings.recovery_findings(_recovered(spark, sf_dir)))


def _installed(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Extensions").when(F.col("event_type") == "view", "Cookies").otherwise("History")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("artifact"), F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("source"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("name"), F.lit("d").alias("description"), F.when(F.col("event_id") % 3 > 0, "ENCRYPTED").alias("encrypted_value"))


@query("SELECT min(event_id) AS seq, 'extension' AS evidence_source, count(*) || ' extension(s) installed: ' || string_agg('x' || event_id, ', ' ORDER BY 'x' || event_id) AS evidence FROM events WHERE event_type = 'click' GROUP BY user_id % 40 UNION ALL SELECT 0, 'cookie', count(*) || ' cookie value(s) stored encrypted (not recoverable without keys)' FROM events WHERE event_type = 'view' AND event_id % 3 > 0")
def aggregate_findings(spark, sf_dir):
    e = _installed(spark, sf_dir)
    return findings.extension_findings(e).unionByName(findings.cookie_finding(e)).select("seq", "evidence_source", "evidence")


@query("SELECT concat_ws(',', 'info', 'low', 'investigate.extension_present.v1', 'extension', 'live', '', CASE WHEN count(*) > 1 THEN '\"' ELSE '' END || count(*) || ' extension(s) installed: ' || string_agg('x' || event_id, ', ' ORDER BY 'x' || event_id) || CASE WHEN count(*) > 1 THEN '\"' ELSE '' END) AS line FROM events WHERE event_type = 'click' GROUP BY user_id % 40")
def finding_lines(spark, sf_dir):
    return findings.finding_lines(findings.extension_findings(_installed(spark, sf_dir)))


@query(SQL + "SELECT artifact, count(*) AS events FROM ev GROUP BY 1")
def artifact_counts(spark, sf_dir):
    return reports.artifact_counts(activity(spark, sf_dir))


@query(SQL + "SELECT " + HOST.format("url") + " AS host, count(*) AS events FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_domains(spark, sf_dir):
    return reports.top_domains(activity(spark, sf_dir))


#: A file a page, some of them changed, gone or new since.
_BEFORE, _AFTER = "page_id % 7 <> 3", "page_id % 5 <> 2"
_NOW = "CASE WHEN page_id % 4 = 1 THEN html || '!' ELSE html END"


def _manifests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    path = F.concat(F.lit("d"), (F.col("page_id") % 9).cast("string"), F.lit("/p"), F.col("page_id").cast("string"))
    found = []
    for kept, content in ((_BEFORE, F.col("html")), (_AFTER, F.when(F.col("page_id") % 4 == 1, F.concat("html", F.lit("!"))).otherwise(F.col("html")))):
        folder = scratch_path(spark, "files")
        evidence.write_files(pages.where(kept).select(path.alias("path"), content.cast("binary").alias("content")), folder)
        made = manifest.manifest(manifest.listed(spark, folder))
        found.append(made.withColumn("path", F.regexp_extract("path", "(d[0-9]+/p[0-9]+)$", 1)))
    return found


@query(f"SELECT 'd' || page_id % 9 || '/p' || page_id AS path, octet_length(encode(html)) AS size_bytes, sha256(html) AS sha256, md5(html) AS md5, CAST(NULL AS VARCHAR) AS error FROM pages WHERE html IS NOT NULL AND {_BEFORE}")
def custody_manifest(spark, sf_dir):
    """Files hashed from a listing, the manifest written in order and read again."""
    folder = scratch_path(spark, "manifest")
    ordered.write_ordered(manifest.manifest_lines(_manifests(spark, sf_dir)[0], {"tool": "waylens"}), folder, ["at", "path"], suffix="jsonl")
    return manifest.read_manifest(spark, folder)


@query(f"SELECT 'd' || page_id % 9 || '/p' || page_id AS path, CASE WHEN NOT ({_BEFORE}) THEN 'added' WHEN NOT ({_AFTER}) THEN 'removed' WHEN page_id % 4 = 1 THEN 'changed' ELSE 'same' END AS status, CASE WHEN {_BEFORE} THEN sha256(html) END AS before_sha256, CASE WHEN {_AFTER} THEN sha256({_NOW}) END AS after_sha256 FROM pages WHERE html IS NOT NULL AND (({_BEFORE}) OR ({_AFTER}))")
def compared_manifests(spark, sf_dir):
    return manifest.compared(*_manifests(spark, sf_dir))


# ordered outputs

def _ordered(spark, rows, order, **options):
    """The lines as they stand in the written files, with their places in the whole order."""
    folder = scratch_path(spark, "ordered")
    ordered.write_ordered(rows, folder, order, **options)
    return ordered.read_placed(spark, folder)


_LINE = f"'[' || {STAMP} || '] ' || browser || '/' || artifact || ' ' || domain || '  ' || description"
_HOSTS = f"SELECT domain AS host, count(*) AS total, min(nullif(timestamp_ns, 0)) AS first, max(nullif(timestamp_ns, 0)) AS last, string_agg(DISTINCT browser, ', ' ORDER BY browser) AS browsers FROM dm GROUP BY 1"
_STAMP_OF = lambda c: STAMP.replace("timestamp_ns", c)


@query(
    SQL + f""", dm AS (SELECT *, {DOMAIN.format('fullhost')} AS domain FROM (SELECT *, {HOST.format('url')} AS fullhost FROM ev2)), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, timestamp_ns, artifact ORDER BY seq) AS rn FROM dm) WHERE rn = 1),
c AS (SELECT count(*) FILTER (WHERE timestamp_ns <> 0) AS timed, count(*) FILTER (WHERE timestamp_ns = 0) AS untimed, (SELECT count(*) FROM ev2) - count(*) AS dups FROM kept), r AS ({_HOSTS}),
k AS (SELECT domain AS host, string_agg(artifact || '=' || n, ' ' ORDER BY artifact) AS kinds FROM (SELECT domain, artifact, count(*) AS n FROM dm GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT 0 AS s, 0 AS a, 0 AS b, '' AS h, '== Unified cross-artifact timeline (' || (timed + untimed) || ' event(s): ' || timed || ' timed, ' || untimed || ' untimed, ' || dups || ' duplicate(s) removed) ==' AS line FROM c
UNION ALL SELECT CASE WHEN timestamp_ns <> 0 THEN 1 ELSE 3 END, timestamp_ns, seq, '', {_LINE} FROM kept UNION ALL SELECT 2, 0, 0, '', '-- untimed (' || untimed || ') --' FROM c WHERE untimed > 0
UNION ALL SELECT 4, 0, 0, '', '' UNION ALL SELECT 4, 1, 0, '', '== Per-host rollup (' || count(*) || ' host(s)) ==' FROM r
UNION ALL SELECT 5, -total, 0, host, '  ' || host || '  total=' || total || '  ' || {_STAMP_OF('first')} || '..' || {_STAMP_OF('last')} || '  [' || browsers || ']  ' || kinds FROM r JOIN k USING (host))
SELECT row_number() OVER (ORDER BY s, a, b, h) - 1 AS rank, line FROM l"""
)
def correlation_text(spark, sf_dir):
    return _ordered(spark, reports.correlation_lines(with_copies(activity(spark, sf_dir))), reports.CORRELATION_ORDER)


@query(
    SQL + f""", kept AS (SELECT *, {DOMAIN.format('fullhost')} AS domain FROM (SELECT *, {HOST.format('url')} AS fullhost FROM (SELECT *, row_number() OVER (PARTITION BY url, timestamp_ns, artifact ORDER BY seq) AS rn FROM ev2) WHERE rn = 1))
SELECT CAST(0 AS BIGINT) AS rank, '{reports.TIMELINE_HEADER}' AS line UNION ALL SELECT row_number() OVER (ORDER BY timestamp_ns = 0, timestamp_ns, seq), concat_ws(',', {STAMP}, browser, artifact, domain, source, {QUOTED.format('description')}, {QUOTED.format('url')}) FROM kept"""
)
def correlation_csv(spark, sf_dir):
    return _ordered(spark, reports.correlation_lines(with_copies(activity(spark, sf_dir)), "csv"), reports.CORRELATION_ORDER, header=reports.TIMELINE_HEADER, suffix="csv")


@query("SELECT row_number() OVER (ORDER BY seq, \"offset\", kind, value) - 1 AS rank, seq || ' ' || \"offset\" || ' ' || kind || ' ' || value AS line FROM (" + _planted(*PARTS) + ")")
def indicators_in_order(spark, sf_dir):
    found = indicators.all_indicators(evidence.select(spark, sf_dir, TEXTS))
    line = F.concat_ws(" ", F.col("seq").cast("string"), F.col("offset").cast("string"), "kind", "value")
    return _ordered(spark, found.withColumn("line", line), ["seq", "offset", "kind", "value"])


# Safari's cache

#: Responses, some without a receiver or a blob; half of the bodies stand in files of their own, some of which are gone.
SAFARI = {
    "cfurl_cache_response": f"SELECT CAST(floor(page_id / 100) AS BIGINT) AS store, page_id AS entry_ID, url AS request_key FROM {{pages}}",
    "cfurl_cache_receiver_data": "SELECT CAST(floor(page_id / 100) AS BIGINT) AS store, page_id AS entry_ID, page_id % 2 AS isDataOnFS, CASE WHEN page_id % 2 = 1 THEN concat('UUID-', CAST(page_id AS STRING)) ELSE html END AS receiver_data FROM {pages} WHERE page_id % 9 > 0",
    "cfurl_cache_blob_data": "SELECT CAST(floor(page_id / 100) AS BIGINT) AS store, page_id AS entry_ID, concat('<plist version=\"1.0\"><dict><key>Array</key><array><string>a</string><string>b</string><real>1.5</real><integer>', CAST(200 + page_id % 3 AS STRING), '</integer><dict><key>Content-Encoding</key><string>', CASE WHEN page_id % 4 = 0 THEN 'gzip' ELSE 'identity' END, '</string></dict><string>-</string><string>text/html</string></array></dict></plist>') AS response_object FROM {pages} WHERE page_id % 8 > 0",
}


@query(
    "WITH p AS (SELECT *, page_id % 9 > 0 AS received, page_id % 8 > 0 AS answered, page_id % 2 = 1 AND page_id % 9 > 0 AS beside FROM pages), b AS (SELECT *, CASE WHEN NOT received THEN '' WHEN beside AND page_id % 11 = 0 THEN '' ELSE html END AS body FROM p) "
    "SELECT page_id AS entry, url, CASE WHEN answered THEN CAST(200 + page_id % 3 AS INT) END AS status, CASE WHEN answered THEN 'text/html' END AS content_type, CASE WHEN answered THEN CASE WHEN page_id % 4 = 0 THEN 'gzip' ELSE 'identity' END END AS content_encoding, sha256(body) AS body_sha256, sha256(body) AS decoded_sha256, "
    "CASE WHEN beside AND page_id % 11 = 0 THEN 'no file UUID-' || page_id WHEN answered AND page_id % 4 = 0 AND body <> '' THEN 'stored unpacked though its encoding is gzip' END AS note FROM b"
)
def safari_cache_entries(spark, sf_dir):
    folder = scratch_path(spark, "safari")
    stores = evidence.sqlite_stores({t: evidence.select(spark, sf_dir, sql) for t, sql in SAFARI.items()}, "s").withColumn("path", F.concat("path", F.lit("/Cache.db")))
    pages = table(spark, sf_dir, "pages").where("page_id % 2 = 1 AND page_id % 11 > 0")
    beside = pages.select(F.concat(F.lit("s/"), F.floor(F.col("page_id") / 100).cast("string"), F.lit("/fsCachedData/UUID-"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    evidence.write_files(stores.unionByName(beside), folder)
    databases = evidence_files(spark, folder + "/s/*/Cache.db")
    found = safari_cache.safari_cache(databases)
    return found.select("entry", "url", "status", "content_type", "content_encoding", F.sha2("body", 256).alias("body_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.regexp_replace("note", "no file .*/", "no file ").alias("note"))


# catalog and schemas

_KEYS = {"chain_end": "BOOLEAN", "from_visit": "BIGINT", "is_redirect": "BOOLEAN", "k": "BIGINT", "profile": "BIGINT", "redirect_kind": "STRING", "url": "STRING", "visit_id": "BIGINT"}
_KEY_SQL = SQL + ", n AS (SELECT artifact, count(*) AS events FROM ev GROUP BY 1), a AS (" + " UNION ALL ".join(f"SELECT artifact, '{k}' AS key, '{t}' AS type, count({k}) AS n FROM ev GROUP BY 1" for k, t in _KEYS.items()) + ")"


@query(_KEY_SQL + " SELECT artifact, key, type, n, events, n = events AS required FROM a JOIN n USING (artifact) WHERE n > 0")
def artifact_keys(spark, sf_dir):
    return catalog.artifact_keys(activity(spark, sf_dir))


_KNOWN = ", ".join(f"('{a[0]}', '{a[1]}', '{a[2]}')" for a in ARTIFACTS)


@query(
    _KEY_SQL + f", q AS (SELECT artifact, string_agg(key, ',' ORDER BY key) AS keys FROM a WHERE n > 0 GROUP BY 1), k(artifact, evidence_source, state) AS (VALUES {_KNOWN}) SELECT artifact, evidence_source, state, coalesce(events, 0) AS events, coalesce(keys, '') AS keys FROM k FULL JOIN n USING (artifact) LEFT JOIN q USING (artifact)"
)
def artifact_catalog(spark, sf_dir):
    return catalog.catalog(activity(spark, sf_dir)).withColumn("keys", F.array_join("keys", ","))


_COMMON = ",".join(f'"{k}":{{"type":"{t}"}}' for k, t in catalog.COMMON.items())


@query(
    _KEY_SQL + ", p AS (SELECT artifact, string_agg('\"' || key || '\":{\"type\":\"' || CASE type WHEN 'BIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'string' END || '\"}', ',' ORDER BY key) AS properties, string_agg('\"' || key || '\"', ',' ORDER BY key) FILTER (WHERE n = events) AS needed FROM a JOIN n USING (artifact) WHERE n > 0 GROUP BY 1) "
    f"SELECT artifact, '{{\"title\":\"' || artifact || '\",\"type\":\"object\",\"properties\":{{{_COMMON},\"attrs\":{{\"type\":\"object\",\"properties\":{{' || properties || '}},\"required\":[' || coalesce(needed, '') || ']}}}}}}' AS line FROM p"
)
def artifact_schemas(spark, sf_dir):
    return catalog.json_schemas(activity(spark, sf_dir))


@query("SELECT sha256(html) || '  p' || page_id AS line FROM pages")
def bundle_sums(spark, sf_dir):
    return reports.bundle_sums(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content")))


# caches and pages

CACHED = "SELECT page_id, printf('%016x', page_id) AS name, url, 200 + page_id % 5 AS status, CASE WHEN page_id % 2 = 0 THEN 'gzip' ELSE '' END AS encoding, html FROM {pages}"


def _cached(spark, sf_dir):
    rows = evidence.select(spark, sf_dir, CACHED).select("name", "url", "status", F.lit("text/html").alias("content_type"), "encoding", F.col("html").cast("binary").alias("body"))
    return cache.simple_cache(evidence.simple_cache_files(rows))


@query("SELECT 'cache/' || printf('%016x', page_id) || '_0' AS source, url, CAST(200 + page_id % 5 AS INT) AS status, 'text/html' AS content_type, CASE WHEN page_id % 2 = 0 THEN 'gzip' END AS content_encoding, sha256(html) AS body_sha256, CAST(NULL AS VARCHAR) AS note FROM pages")
def cache_entries(spark, sf_dir):
    return _cached(spark, sf_dir).select("source", "url", "status", "content_type", "content_encoding", F.sha2("body", 256).alias("body_sha256"), "note")


@query("SELECT url FROM pages WHERE page_id % 3 = 0")
def cache_orphans(spark, sf_dir):
    index = evidence.select(spark, sf_dir, CACHED).where("page_id % 3 > 0").select(F.upper("name").alias("hash"))
    return cache.orphaned(_cached(spark, sf_dir), index).select("url")


@query("SELECT regexp_replace(url, '#.*$', '') AS key, max(page_id) AS seq FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '#a' ELSE url END AS url FROM pages UNION ALL SELECT page_id + 1000000, url FROM pages WHERE page_id % 5 = 0) GROUP BY 1")
def resource_index(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("seq"), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("#a"))).otherwise(F.col("url")).alias("url"))
    again = p.where("page_id % 5 = 0").select((F.col("page_id") + 1_000_000).alias("seq"), "url")
    return cache.resource_index(rows.unionByName(again)).select("key", "seq")


#: References of every kind, and what they are in a page at ``https://H<i>.example/a/b/c.html?x#y``.
REFERENCES = {
    "../s.css": "/a/s.css", "i.png": "/a/b/i.png", "/r.js": "/r.js", "./k/../l.js?v=1": "/a/b/l.js?v=1", "?q=2": "/a/b/c.html?q=2", "../../../z": "/z", "//CDN.example/x": None, "https://o.example/p#f": None, "": None,
}
_CASES = ", ".join(f"'{r}'" for r in REFERENCES)


@query("WITH c AS (SELECT event_id, CAST(event_id % 9 AS INT) AS r FROM events) SELECT event_id, CASE r WHEN 6 THEN 'https://cdn.example/x' WHEN 7 THEN 'https://o.example/p' WHEN 8 THEN NULL ELSE 'https://h' || event_id || '.example' || [" + ", ".join(f"'{v or ''}'" for v in REFERENCES.values()) + "][r + 1] END AS url FROM c")
def resolved_references(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://H"), F.col("event_id").cast("string"), F.lit(".example/a/b/c.html?x#y")).alias("base"), F.expr(f"element_at(array({_CASES}), CAST(event_id % 9 + 1 AS INT))").alias("ref"))
    return rows.select("event_id", ur.resolve_ref(F.col("base"), F.col("ref")).alias("url"))


PAGES = "SELECT page_id, concat('https://h', CAST(page_id AS STRING), '.example/d/') AS url, concat('<html><link rel=\"stylesheet\" href=\"s', CAST(page_id AS STRING), '.css\"><link rel=\"next\" href=\"n\"><script src=\"/j.js\"></script><img src=\"i.png\" srcset=\"a.png 1x, b.png 2x\"><p style=\"background:url(../bg.png)\">', CAST(page_id AS STRING), '</p><a href=\"away\">x</a>') AS html FROM {pages}"


#: A page's style sheet, which has an image of its own.
STYLE = "concat('p{{background:url(\"i.png\")}} /* ', CAST(page_id AS STRING), ' */')".replace("{{", "{").replace("}}", "}")


def _resources(spark, sf_dir):
    made = evidence.select(spark, sf_dir, PAGES)
    images = made.where("page_id % 2 = 0").select(F.col("page_id").alias("seq"), F.concat("url", F.lit("i.png#z")).alias("url"), F.lit("image/png").alias("content_type"), F.lit("PNG").cast("binary").alias("body"))
    sheets = made.where("page_id % 3 = 0").select(F.col("page_id").alias("seq"), F.concat("url", F.lit("s"), F.col("page_id").cast("string"), F.lit(".css")).alias("url"), F.lit("text/css").alias("content_type"), F.expr(STYLE).cast("binary").alias("body"))
    return cache.resource_index(images.unionByName(sheets))


@query("SELECT page_id, k.kind, replace(k.ref, '@', CAST(page_id AS VARCHAR)) AS ref, 'https://h' || page_id || '.example' || replace(k.path, '@', CAST(page_id AS VARCHAR)) AS url, (k.ref = 'i.png' AND page_id % 2 = 0) OR (k.kind = 'link' AND page_id % 3 = 0) AS found FROM pages, (VALUES ('link', 's@.css', '/d/s@.css'), ('script', '/j.js', '/j.js'), ('media', 'i.png', '/d/i.png'), ('media', 'a.png', '/d/a.png'), ('media', 'b.png', '/d/b.png'), ('style_url', '../bg.png', '/bg.png')) k(kind, ref, path)")
def page_resources(spark, sf_dir):
    return cache.rebuilt(evidence.select(spark, sf_dir, PAGES), _resources(spark, sf_dir))


_PNG = "'data:image/png;base64,' || base64('PNG'::BLOB)"


@query(
    f"WITH p AS ({PAGES}), r AS (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN replace({STYLE}, 'i.png', {_PNG}) ELSE {STYLE} END AS style FROM p), s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '\"s' || page_id || '.css\"', '\"data:text/css;base64,' || base64(encode(style)) || '\"') ELSE html END AS html FROM r) "
    f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, '\"i.png\"', '\"' || {_PNG} || '\"') ELSE html END AS html FROM s".replace("STRING", "VARCHAR")
)
def rebuilt_pages(spark, sf_dir):
    return cache.with_local_copies(evidence.select(spark, sf_dir, PAGES), _resources(spark, sf_dir))


#: Ten sheets a site, each importing the next; in every third site the last imports the first. Half of the images are there.
SHEETS = (
    "SELECT g, k, concat('https://s.example/', CAST(g AS STRING), '/') AS base, concat(CASE WHEN k < 9 THEN concat('@import \"', CAST(k + 1 AS STRING), '.css\"; ') WHEN g % 3 = 0 THEN '@import url(0.css); ' ELSE '' END, 'a[url(i', CAST(k % 4 AS STRING), '.png)] b[url( gone.gif )]') AS text "
    "FROM (SELECT CAST(floor(page_id / 10) AS BIGINT) AS g, CAST(page_id % 10 AS BIGINT) AS k FROM {pages})"
)
_SHEET_SQL = f"""WITH RECURSIVE s0 AS ({SHEETS.replace('STRING', 'VARCHAR')}), s1 AS (SELECT *, count(*) OVER (PARTITION BY g) = 10 AND g % 3 = 0 AS ring, max(k) OVER (PARTITION BY g) AS top FROM s0),
s AS (SELECT *, replace(replace(text, '(i0.png)', '(data:image/png;base64,' || base64('PNG0'::BLOB) || ')'), '(i1.png)', '(data:image/png;base64,' || base64('PNG1'::BLOB) || ')') AS own FROM s1),
t AS (SELECT g, k, own AS made FROM s WHERE ring OR k = top UNION ALL SELECT s.g, s.k, replace(s.own, '"' || t.k || '.css"', '"data:text/css;base64,' || base64(encode(t.made)) || '"') FROM t JOIN s ON s.g = t.g AND s.k = t.k - 1 AND NOT s.ring)"""


def _sheets(spark, sf_dir):
    made = evidence.select(spark, sf_dir, SHEETS)
    sheets = made.select(F.concat("base", F.col("k").cast("string"), F.lit(".css")).alias("url"), F.lit("text/css").alias("content_type"), F.col("text").cast("binary").alias("body"))
    images = made.where("k < 2").select(F.concat("base", F.lit("i"), F.col("k").cast("string"), F.lit(".png")).alias("url"), F.lit("image/png").alias("content_type"), F.concat(F.lit("PNG"), F.col("k").cast("string")).cast("binary").alias("body"))
    return stylesheets.inlined_sheets(cache.resource_index(sheets.unionByName(images).withColumn("seq", F.lit(0))))


@query(_SHEET_SQL + " SELECT 'https://s.example/' || g || '/' || k || '.css' AS key, made AS text FROM t")
def inlined_sheets(spark, sf_dir):
    return _sheets(spark, sf_dir)[0].select("key", "text")


@query(
    _SHEET_SQL + " SELECT 'https://s.example/' || g || '/' || k || '.css' AS sheet, ref, reason FROM (SELECT g, k, 'gone.gif' AS ref, 'missing' AS reason FROM s UNION ALL SELECT g, k, 'i' || k % 4 || '.png', 'missing' FROM s WHERE k % 4 > 1 OR k % 4 > top "
    "UNION ALL SELECT g, k, (k + 1) % 10 || '.css', 'cycle' FROM s WHERE ring UNION ALL SELECT g, k, (k + 1) || '.css', 'missing' FROM s WHERE k = top AND k < 9)"
)
def sheet_gaps(spark, sf_dir):
    return _sheets(spark, sf_dir)[1].select("sheet", "ref", "reason")


# profiles anywhere in a tree

#: Ten files a home: in the usual places of browsers, or too deep, or without what marks a profile; some are links.
HOMES = (
    "SELECT concat('/img/', CASE WHEN g % 2 = 0 THEN 'Users' ELSE 'home' END, '/u', CAST(g AS STRING), '/', CASE k WHEN 0 THEN 'AppData/Local/Google/Chrome/User Data/Default/History' WHEN 1 THEN '.config/vivaldi/Profile 1/History' WHEN 2 THEN '.config/vivaldi/Profile 1/Cache/History' WHEN 3 THEN '.mozilla/firefox/x.default/places.sqlite' "
    "WHEN 4 THEN 'Library/Safari/History.db' WHEN 5 THEN 'AppData/Local/Microsoft/Windows/WebCache/WebCacheV01.dat' WHEN 6 THEN '.config/opera/History' WHEN 7 THEN '.config/chromium/Profile 2/History' WHEN 8 THEN 'Library/Application Support/Arc/User Data/Default/History' ELSE 'x/.mozilla/firefox/y/History' END) AS path, k = 7 AND g % 4 = 1 AS link "
    "FROM (SELECT CAST(floor(event_id / 10) AS BIGINT) AS g, CAST(event_id % 10 AS BIGINT) AS k FROM {events})"
)


@query(
    f"WITH h AS ({HOMES.replace('STRING', 'VARCHAR')}), p AS (SELECT *, row_number() OVER () AS i FROM h), m(mark, browser, brand, profile) AS (VALUES ('/Google/Chrome/User Data/Default/History', 'Chromium', 'Chrome', 'Default'), ('/vivaldi/Profile 1/History', 'Chromium', 'Vivaldi', 'Profile 1'), ('/x.default/places.sqlite', 'Firefox', 'Firefox', 'x.default'), "
    "('/Safari/History.db', 'Safari', 'Safari', 'Default'), ('/WebCacheV01.dat', 'InternetExplorer', 'IE', 'WebCache'), ('/chromium/Profile 2/History', 'Chromium', 'Chromium', 'Profile 2'), ('/Arc/User Data/Default/History', 'Chromium', 'Arc', 'Default')) "
    "SELECT DISTINCT browser, brand, profile, regexp_replace(path, '/[^/]*$', '') AS path, array_to_string(string_split(path, '/')[1:4], '/') AS home, string_split(path, '/')[4] AS \"user\" FROM p JOIN m ON ends_with(path, mark) WHERE NOT link"
)
def home_profiles(spark, sf_dir):
    return discovery.home_profiles(evidence.select(spark, sf_dir, HOMES))


#: Ten entries a tree, three folders deeper each: files that mark a profile (which ones differs by tree), embedded browsers, links, and others.
TREES = (
    "SELECT g, k, concat('/ev/t', CAST(g AS STRING), CASE WHEN g % 5 = 4 THEN '/Slack' ELSE '' END, repeat('/d', CAST(k * 3 AS INT)), CASE WHEN k < g % 7 THEN '/notes.txt' WHEN k % 3 = 0 THEN '/Network/Cookies' WHEN k % 3 = 1 THEN '/places.sqlite' WHEN g % 2 = 0 THEN '/old.jsonlz4' ELSE '/IndexedDB/x/1' END) AS path, g % 11 = 3 AND k = g % 7 AS link "
    "FROM (SELECT CAST(floor(event_id / 10) AS BIGINT) AS g, CAST(event_id % 10 AS BIGINT) AS k FROM {events}) UNION ALL SELECT CAST(floor(event_id / 10) AS BIGINT), -1, concat('/ev/t', CAST(floor(event_id / 10) AS BIGINT), '/d/d/d/d'), true FROM {events} WHERE event_id % 130 = 0"
)


@query(
    f"""WITH f AS ({TREES.replace('STRING', 'VARCHAR')}), l AS (SELECT g, path FROM f WHERE link), v AS (SELECT f.g, f.path FROM f WHERE NOT link AND NOT EXISTS (SELECT 1 FROM l WHERE l.g = f.g AND starts_with(f.path, l.path || '/'))),
c AS (SELECT g, regexp_replace(path, '/[^/]*$', '') AS dir, CASE WHEN ends_with(path, '/Cookies') THEN 0 ELSE 1 END AS rank FROM v WHERE regexp_matches(path, '/(Cookies|places.sqlite|old.jsonlz4)$') UNION ALL SELECT g, regexp_replace(path, '/Network/Cookies$', ''), 0 FROM v WHERE ends_with(path, '/Network/Cookies')
  UNION ALL SELECT g, regexp_replace(path, '/IndexedDB/x/1$', ''), 2 FROM v WHERE ends_with(path, '/IndexedDB/x/1') AND contains(path, '/Slack')),
d AS (SELECT g, dir, min(rank) AS rank FROM c WHERE len(string_split(dir, '/')) - 2 <= 24 GROUP BY 1, 2)
SELECT dir AS path, CASE rank WHEN 1 THEN 'Firefox' ELSE 'Chromium' END AS browser, string_split(dir, '/')[-1] AS name, CASE WHEN contains(dir, '/Slack') THEN 'Slack' END AS app, CASE WHEN contains(dir, '/Slack') THEN 'Slack' END AS vendor, CASE WHEN contains(dir, '/Slack') THEN 'Electron' END AS kind
FROM d WHERE NOT EXISTS (SELECT 1 FROM d u WHERE u.g = d.g AND starts_with(d.dir, u.dir || '/'))"""
)
def swept_containers(spark, sf_dir):
    return discovery.swept_containers(evidence.select(spark, sf_dir, TREES), "/ev")


PROFILE = (*rq.NAMES, *rq.PLACED)


@query(rq.expected_profile(PROFILE))
def read_profile(spark, sf_dir):
    """Every reader of the dispatch, over a profile of all stores, row by row; files of other names are there too."""
    files = rq.profile_files(spark, sf_dir, PROFILE)
    other = files.where(F.col("path").endswith("/History")).withColumn("path", F.concat("path", F.lit(".bak")))
    return rq.shown(dispatch.read_all(files.unionByName(other)))


ON_DISK = ("chromium_visits", "firefox_cookies", "chromium_bookmarks", "safari_history")


@query(rq.expected_profile(ON_DISK))
def parse_profile(spark, sf_dir):
    """A folder of files, read by its path."""
    folder = scratch_path(spark, "profile")
    evidence.write_files(rq.profile_files(spark, sf_dir, ON_DISK), folder)
    return rq.shown(dispatch.parse_profile(spark, folder))


RESIDUE = ("chromium_network_state", "chromium_reporting", "chromium_transport_security", "chromium_bounces", "firefox_site_security")


@query(
    f"WITH e AS ({rq.expected_profile(RESIDUE)}), k AS (SELECT CASE WHEN regexp_matches(attrs, '(^|; )domain=') THEN regexp_extract(attrs, '(?:^|; )domain=([^;]*)', 1) WHEN regexp_matches(attrs, '(^|; )host=') THEN regexp_extract(attrs, '(?:^|; )host=([^;]*)', 1) END AS domain, "
    "regexp_extract(attrs, '(?:^|; )source_artifact=([^;]*)', 1) AS source_artifact FROM e) SELECT domain, source_artifact, count(*) AS n FROM k WHERE domain IS NOT NULL GROUP BY 1, 2"
)
def recovered_domains(spark, sf_dir):
    return dispatch.recovered_domains(rq.profile_files(spark, sf_dir, RESIDUE)).groupBy("domain", "source_artifact").agg(F.count("*").alias("n"))


# interpretations

_Q = "concat('w', CAST(event_id AS STRING))"
SEARCHES = f"SELECT event_id, CAST(event_id % 8 AS INT) AS k, CASE event_id % 8 WHEN 0 THEN concat('https://www.google.co.uk/search?q=', {_Q}, '+x&num=20&safe=off') WHEN 1 THEN concat('https://bing.com/?a=1&q=', {_Q}) WHEN 2 THEN concat('https://duckduckgo.com/?q=', {_Q}, '%21') WHEN 3 THEN concat('https://m.youtube.com/results?search_query=', {_Q}) WHEN 4 THEN concat('https://www.amazon.de/s?field-keywords=', {_Q}) WHEN 5 THEN concat('https://shop.example/?query=', {_Q}) WHEN 6 THEN concat('https://shop.example/p/', {_Q}) ELSE concat('https://www.google.com/webhp#q=', {_Q}, '&tbs=qdr:d', CAST(event_id % 9 + 1 AS STRING)) END AS url FROM {{events}}"


@query(f"WITH s AS ({SEARCHES}) SELECT event_id, ['Google', 'Bing', 'DuckDuckGo', 'YouTube', 'Amazon', 'Generic', NULL, 'Google'][k + 1] AS engine, 'w' || event_id || CASE k WHEN 0 THEN ' x' WHEN 2 THEN '!' ELSE '' END AS term FROM s WHERE k <> 6")
def search_queries(spark, sf_dir):
    return evidence.select(spark, sf_dir, SEARCHES).select("event_id", ur.search_query(F.col("url")).alias("s")).where("s IS NOT NULL").select("event_id", "s.engine", "s.term")


@query(
    f"WITH s AS ({SEARCHES}) SELECT event_id, CASE k WHEN 0 THEN 'Searched for \"w' || event_id || ' x\" [ Showing 20 results per page | SafeSearch: off]' WHEN 1 THEN 'a: 1 | q: w' || event_id || ' [Query String Parser]' WHEN 2 THEN 'q: w' || event_id || '! [Query String Parser]' WHEN 3 THEN 'search_query: w' || event_id || ' [Query String Parser]' "
    "WHEN 4 THEN 'field-keywords: w' || event_id || ' [Query String Parser]' WHEN 5 THEN 'query: w' || event_id || ' [Query String Parser]' WHEN 7 THEN 'Searched for \"w' || event_id || '\" [ Results in the past ' || (event_id % 9 + 1) || ' days]' END AS said FROM s"
)
def interpreted_urls(spark, sf_dir):
    return evidence.select(spark, sf_dir, SEARCHES).select("event_id", ur.interpret_url(F.col("url")).alias("said"))


@query("SELECT page_id, 'Generic' AS engine, 'w' || page_id || ' x' AS term FROM pages WHERE url LIKE '%?%'")
def search_terms(spark, sf_dir):
    """Searches on the sites of the pages, which no known engine runs."""
    rows = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?")))
    asked = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("&q=w"), F.col("page_id").cast("string"), F.lit("+x"))
    return rows.select("page_id", ur.search_query(asked).alias("s")).where("s IS NOT NULL").select("page_id", "s.engine", "s.term")


#: Every option of a search, with what it says.
OPTIONS = {
    "'&pws=1'": "'Google personalization turned on'", "'&pws=0'": "'Google personalization turned off'", "concat('&num=', CAST(event_id % 90 + 10 AS STRING))": "'Showing ' || (event_id % 90 + 10) || ' results per page'", "'&filter=1'": "'Omitted results filter on'", "'&filter=0'": "'Similar results filter on'",
    "'&btnl=1'": "'\"I''m Feeling Lucky\" search on'", "'&safe=active'": "'SafeSearch: active'", "concat('&as_qdr=w', CAST(event_id % 7 + 1 AS STRING))": "'Results in the past ' || (event_id % 7 + 1) || ' weeks'", "'&as_qdr=y'": "'Results in the past year'", "'&tbs=dfn:1'": "'Dictionary definition'", "'&tbs=img'": "'Sites with images'",
    "concat('&tbs=cdr:1,cd_min:1/2/', CAST(2000 + event_id % 20 AS STRING), ',cd_max:3/4/2030')": "'Results in custom range 1/2/' || (2000 + event_id % 20) || ' - 3/4/2030'", "concat('&biw=', CAST(event_id AS STRING), '&bih=600')": "'Browser screen ' || event_id || 'x600'", "concat('&pq=p', CAST(event_id AS STRING))": "'Previous query: \"p' || event_id || '\"'",
    "concat('&oq=o', CAST(event_id AS STRING), '&aq=3')": "'Typed \"o' || event_id || '\" before clicking on the third suggestion'", "concat('&oq=o', CAST(event_id AS STRING), '&aq=f')": "'Typed \"o' || event_id || '\" before clicking on a suggestion'", "concat('&as_sitesearch=s', CAST(user_id AS STRING), '.example')": "'Search only s' || user_id || '.example'",
    "'&as_filetype=pdf'": "'Show only pdf files'", "concat('&sourceid=', event_type)": "'Using ' || event_type", "''": "NULL",
}
_CASES_OF = lambda values: f"CASE event_id % {len(OPTIONS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
SEARCHED = f"SELECT event_id, concat('https://www.google.com/search?q=', {_Q}, {_CASES_OF(OPTIONS)}) AS url FROM {{events}}"


@query(f"SELECT event_id, 'Searched for \"w' || event_id || '\"' || coalesce(' [ ' || {_CASES_OF(OPTIONS.values())} || ']', '') AS said FROM events")
def search_options(spark, sf_dir):
    return evidence.select(spark, sf_dir, SEARCHED).select("event_id", ur.interpret_url(F.col("url")).alias("said"))


_AT = "(1300000000 + event_id * 7)"
COOKIES = f"SELECT event_id, CAST(event_id % 7 AS INT) AS k, CASE event_id % 7 WHEN 0 THEN '_ga' WHEN 1 THEN '__utmc' WHEN 2 THEN '__qca' WHEN 3 THEN 'BIGipServer' WHEN 4 THEN '__utma' ELSE 't' END AS name, CASE event_id % 7 WHEN 0 THEN concat('GA1.2.', CAST(user_id AS STRING), '.', CAST({_AT} AS STRING)) WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN concat('P0-12-', CAST({_AT} AS STRING), '000') WHEN 3 THEN concat(CAST(67305985 + event_id AS STRING), '.20480.0000') WHEN 4 THEN concat('1.2.', CAST({_AT} AS STRING), '.', CAST({_AT} AS STRING), '.', CAST({_AT} AS STRING), '.5') WHEN 5 THEN concat('x timestamp=', CAST({_AT} AS STRING), '123;') ELSE event_type END AS value, {_AT} AS at_s, user_id FROM {{events}}"
_SHOWN = "strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d %H:%M:%S.000')"


@query(
    f"WITH c AS ({COOKIES}) SELECT event_id, CASE k WHEN 0 THEN 'Client ID: ' || user_id || '.' || at_s || ' | First Visit: ' || {_SHOWN} || ' | [Google Analytics Cookie]' WHEN 1 THEN 'Domain Hash: ' || event_id || ' | [Google Analytics Cookie]' WHEN 2 THEN {_SHOWN} || ' [Quantcast Cookie Timestamp]' "
    "WHEN 3 THEN 'Server IP: ' || ((67305985 + event_id) & 255) || '.' || ((67305985 + event_id) // 256 & 255) || '.' || ((67305985 + event_id) // 65536 & 255) || '.' || ((67305985 + event_id) // 16777216 & 255) || ' | Server Port: 80 [BIG-IP Cookie]' "
    f"WHEN 4 THEN 'Domain Hash: 1 | Unique Visitor ID: 2 | First Visit: ' || {_SHOWN} || ' | Previous Visit: ' || {_SHOWN} || ' | Last Visit: ' || {_SHOWN} || ' | Number of Sessions: 5 | [Google Analytics Cookie]' WHEN 5 THEN replace({_SHOWN}, '.000', '.123') || ' [potential timestamp]' END AS said FROM c"
)
def interpreted_cookies(spark, sf_dir):
    return evidence.select(spark, sf_dir, COOKIES).select("event_id", interpret_cookie(F.col("name"), F.col("value")).alias("said"))


#: Page views, custom values, and campaigns of four kinds.
CAMPAIGNS = (
    f"SELECT event_id, CAST(event_id % 6 AS INT) AS k, {_AT} AS at_s, user_id, CASE event_id % 6 WHEN 0 THEN '__utmb' WHEN 1 THEN '__utmv' ELSE '__utmz' END AS name, CASE event_id % 6 WHEN 0 THEN concat(CAST(event_id AS STRING), '.', CAST(user_id AS STRING), '.10.', CAST({_AT} AS STRING)) WHEN 1 THEN concat(CAST(event_id AS STRING), '.|1=', event_type, '=x.y') "
    f"ELSE concat(CAST(event_id AS STRING), '.', CAST({_AT} AS STRING), '.2.3.', CASE event_id % 6 WHEN 2 THEN concat('utmcsr=google|utmccn=(organic)|utmcmd=organic|utmctr=w', CAST(user_id AS STRING)) WHEN 3 THEN concat('utmcsr=h', CAST(user_id AS STRING), '.example|utmccn=(referral)|utmcmd=referral|utmcct=/p') WHEN 4 THEN 'utmcsr=news|utmccn=spring|utmctr=cats' ELSE 'utmcsr=x|utmccn=sale|utmcmd=email' END) END AS value, event_type FROM {{events}}"
)
_CAMPAIGN = (
    f"CASE k WHEN 0 THEN 'Domain Hash: ' || event_id || ' | Pages Viewed: ' || user_id || ' | Last Visit: ' || {_SHOWN} || ' | [Google Analytics Cookie]' WHEN 1 THEN 'Domain Hash: ' || event_id || ' | Custom Values: 1=' || event_type || '=x.y | [Google Analytics Cookie]' ELSE 'Domain Hash: ' || event_id || ' | Last Visit: ' || {_SHOWN} || ' | Sessions: 2 | Sources: 3 | ' "
    "|| CASE k WHEN 2 THEN 'Last Type of Access: organic | Search keywords: w' || user_id WHEN 3 THEN 'Referrer: h' || user_id || '.example/p' WHEN 4 THEN 'Last Source Site: news | Ad Campaign Info: spring | Keyword(s) from Search that Found Site: cats' ELSE 'Last Type of Access: sale' END || ' [Google Analytics Cookie]' END"
)


@query(f"SELECT event_id, {_CAMPAIGN} AS said FROM ({evidence.duckdb(CAMPAIGNS)})")
def campaign_cookies(spark, sf_dir):
    return evidence.select(spark, sf_dir, CAMPAIGNS).select("event_id", interpret_cookie(F.col("name"), F.col("value")).alias("said"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS description, {_CAMPAIGN} AS interpretation FROM ({evidence.duckdb(CAMPAIGNS)})")
def export_cookies(spark, sf_dir):
    """Cookies in the export: an event without a URL is interpreted by its name and value."""
    rows = evidence.select(spark, sf_dir, CAMPAIGNS).select(F.col("event_id").alias("seq"), (F.col("at_s") * 1_000_000_000).alias("timestamp_ns"), F.lit("Chromium").alias("browser"), F.lit("Cookies").alias("artifact"), F.lit("p").alias("source"), F.col("event_id").cast("string").alias("description"), "name", "value")
    return writers.export_rows(rows).select("description", "interpretation")


TERMS = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN concat('https://x.example/', CAST(event_id AS STRING)) WHEN 1 THEN concat('10.0.0.', CAST(event_id % 300 AS STRING)) WHEN 2 THEN concat('fe80::', CAST(event_id % 9999 AS STRING)) WHEN 3 THEN lpad(CAST(event_id AS STRING), 32, 'a') WHEN 4 THEN lpad(CAST(event_id AS STRING), 40, 'B') WHEN 5 THEN lpad(CAST(event_id AS STRING), 64, '0') WHEN 6 THEN concat('h', CAST(event_id AS STRING), '.example.com') WHEN 7 THEN concat('-h', CAST(event_id AS STRING), '.com') ELSE concat('two words ', event_type) END AS term FROM {events}"


@query(f"SELECT event_id, CASE WHEN event_id % 9 = 1 AND event_id % 300 > 255 THEN 'literal' ELSE ['url', 'ipv4', 'ipv6', 'md5', 'sha1', 'sha256', 'domain', 'literal', 'literal'][CAST(event_id % 9 + 1 AS INT)] END AS kind FROM ({TERMS})")
def classified_terms(spark, sf_dir):
    return evidence.select(spark, sf_dir, TERMS).select("event_id", ur.classify_term(F.col("term")).alias("kind"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'h' || user_id || '.example' WHEN 1 THEN 'x.co.uk' WHEN 2 THEN '10.0.0.1' END AS first_domain, CASE event_id % 4 WHEN 0 THEN 'h' || user_id || '.example,cdn.example' WHEN 1 THEN 'x.co.uk,cdn.example' WHEN 2 THEN '10.0.0.1,cdn.example' ELSE 'cdn.example' END AS domains FROM (SELECT event_id, user_id FROM events) UNION ALL SELECT -1, NULL, '' WHERE false")
def attribute_domains(spark, sf_dir):
    url = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://www.h"), F.col("user_id").cast("string"), F.lit(".example/p"))).when(F.col("event_id") % 4 == 1, "http://a.b.X.co.uk:8080").when(F.col("event_id") % 4 == 2, "http://10.0.0.1/")
    attrs = F.map_filter(F.create_map(F.lit("referrer_url"), url, F.lit("host"), F.lit(".img.cdn.example"), F.lit("origin"), F.lit("")), lambda k, v: v.isNotNull())
    rows = table(spark, sf_dir, "events").select("event_id", attrs.alias("attrs"))
    first = F.when(F.col("event_id") % 4 < 3, ur.primary_domain(F.col("attrs")))
    return rows.select("event_id", first.alias("first_domain"), F.array_join(ur.attribute_domains(F.col("attrs")), ",").alias("domains"))


@query("SELECT event_id, ['clicked link', 'typed URL', 'bookmark', 'subframe (auto)', 'subframe (manual)', 'generated', 'start page', 'form submit', 'reload', 'keyword search', 'keyword search', 'unknown'][CAST(event_id % 12 + 1 AS INT)] AS label FROM events")
def transition_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.transition_label(tx.transition_core(F.col("event_id") % 12)).alias("label"))


# detection

UNKNOWN = "SELECT event_id, concat('d/f', CAST(event_id AS STRING), CASE WHEN event_id % 10 = 0 THEN '/WebCacheV01.dat' ELSE '' END) AS path, CASE event_id % 5 WHEN 0 THEN '00000000EFCDAB8900' WHEN 1 THEN '6D6F7A4C7A34300001' WHEN 2 THEN '455646090D' WHEN 3 THEN lpad(CAST(event_id AS STRING), 8, '0') ELSE '' END AS hexed FROM {events}"


@query(
    f"SELECT path, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 10 = 0 THEN 'IE/Edge-Legacy WebCacheV01 (ESE)' ELSE 'ESE database' END WHEN 1 THEN 'Firefox mozLz4 (jsonlz4)' WHEN 2 THEN 'EnCase/EWF disk image (E01)' ELSE 'unknown (possible raw disk or memory image)' END AS kind, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 10 = 0 THEN 'high' ELSE 'medium' END WHEN 1 THEN 'high' WHEN 2 THEN 'high' ELSE 'low' END AS confidence FROM ({UNKNOWN}) "
    "UNION ALL SELECT DISTINCT 'profile/' || CAST(floor(event_id / 2500) AS BIGINT) || t.s, t.kind, t.confidence FROM events, (VALUES ('a', 'Chromium History (SQLite)', 'high'), ('b', 'Firefox places (SQLite)', 'high'), ('c', 'SQLite database (unrecognized schema)', 'medium')) t(s, kind, confidence)"
)
def detect_files(spark, sf_dir):
    made = lambda end, **t: evidence.sqlite_stores({k: evidence.select(spark, sf_dir, sql) for k, sql in t.items()}).withColumn("path", F.concat("path", F.lit(end)))
    others = evidence.select(spark, sf_dir, UNKNOWN).select("path", F.unhex("hexed").alias("content"))
    files = others.unionByName(made("a", urls=rq.URLS, visits=rq.VISITS)).unionByName(made("b", moz_places=rq.PLACES)).unionByName(made("c", mine=rq.PLACES))
    return detection.detect_files(files).select("path", "kind", "confidence")


@query(f"SELECT folder AS path, CASE min(CASE name WHEN 'History' THEN 1 WHEN 'places.sqlite' THEN 2 WHEN 'History.db' THEN 3 END) WHEN 1 THEN 'Chromium profile' WHEN 2 THEN 'Firefox profile' WHEN 3 THEN 'Safari profile' ELSE 'browser evidence directory (home/image layout)' END AS kind, CASE WHEN count(*) FILTER (WHERE name IN ('History', 'places.sqlite', 'History.db')) > 0 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT regexp_replace(path, '/[^/]+$', '') AS folder, list_last(string_split(path, '/')) AS name FROM ({evidence.duckdb(rq.PATHS)})) GROUP BY 1")
def detect_folders(spark, sf_dir):
    return detection.detect_folders(evidence.select(spark, sf_dir, rq.PATHS))


@query(
    SQL + f", t AS ({ORACLE_SQL['tamper_indicators']}) SELECT (SELECT count(*) FROM ({ORACLE_SQL['home_profiles']})) AS profiles, (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM t) AS integrity, (SELECT count(*) FROM ({ORACLE_SQL['carved_hits']})) AS carved"
)
def triage_counts(spark, sf_dir):
    carved = QUERIES["carved_hits"](spark, sf_dir)
    return reports.triage_counts(activity(spark, sf_dir), QUERIES["home_profiles"](spark, sf_dir), QUERIES["tamper_indicators"](spark, sf_dir), carved)
