"""The registered queries of the event analytics, each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylens.functions import text as tx
from waylens.functions import urls as ur
from waylens.functions.times import friendly_date
from waylens.operators import correlate, findings, indicators, integrity, reports, search, timeline, views, visits
from waylens.operators.ordering import ranked
from waylens.plans.activity import SQL, activity, table, with_copies
from waylens.plans.scratch import scratch_path
from waylens.sources import writers
from waylens.sources.sqlite import evidence_files, sqlite_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A point in the middle of the events' time, and an hour, in ns.
PIVOT, HOUR = 1_704_412_800_000_000_000, 3_600_000_000_000
SECOND_LEVEL = ", ".join(f"'{x}'" for x in ur.SECOND_LEVEL)
HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1))"
#: Registrable domain of a host column in DuckDB.
DOMAIN = (
    "CASE WHEN {0} LIKE '%:%' OR regexp_full_match({0}, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') OR len(string_split({0}, '.')) <= 2 THEN {0} "
    "WHEN length(string_split({0}, '.')[-1]) = 2 AND string_split({0}, '.')[-2] IN (" + SECOND_LEVEL + ") THEN concat_ws('.', string_split({0}, '.')[-3], string_split({0}, '.')[-2], string_split({0}, '.')[-1]) "
    "ELSE concat_ws('.', string_split({0}, '.')[-2], string_split({0}, '.')[-1]) END"
)
HOSTED = SQL + f", h AS (SELECT *, {HOST.format('url')} AS fullhost FROM ev), hd AS (SELECT *, {DOMAIN.format('fullhost')} AS domain FROM h)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rollup(spark: SparkSession, sf_dir: str, host) -> DataFrame:
    r = correlate.host_rollup(activity(spark, sf_dir), host)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return r.select("host", "total", counts.alias("counts"), "first_seen_ns", "last_seen_ns", F.array_join("browsers", ",").alias("browsers"))


def _rollup_sql(host: str) -> str:
    return HOSTED + f"""
SELECT t.host, t.total, c.counts, t.first_seen_ns, t.last_seen_ns, t.browsers FROM
(SELECT {host} AS host, count(*) AS total, min(nullif(timestamp_ns, 0)) AS first_seen_ns, max(nullif(timestamp_ns, 0)) AS last_seen_ns, string_agg(DISTINCT browser, ',' ORDER BY browser) AS browsers FROM hd GROUP BY 1) t
JOIN (SELECT host, string_agg(artifact || '=' || n, ',' ORDER BY artifact) AS counts FROM (SELECT {host} AS host, artifact, count(*) AS n FROM hd GROUP BY 1, 2) GROUP BY 1) c ON t.host = c.host"""


@query(_rollup_sql("domain"))
def host_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir, ur.domain_of(F.col("url")))


@query(_rollup_sql("fullhost"))
def host_rollup_by_host(spark, sf_dir):
    return _rollup(spark, sf_dir, ur.host_of(F.col("url")))


@query(HOSTED + " SELECT fullhost AS host, artifact, count(*) AS n FROM hd GROUP BY 1, 2")
def host_rollup_kinds(spark, sf_dir):
    r = correlate.host_rollup(activity(spark, sf_dir), ur.host_of(F.col("url")))
    return r.select("host", F.explode("counts").alias("artifact", "n"))


@query(HOSTED + " SELECT fullhost AS host, count(*) AS events FROM hd GROUP BY 1 HAVING count(*) <= 40")
def rare_domains(spark, sf_dir):
    return correlate.rare_domains(activity(spark, sf_dir), ur.host_of(F.col("url")), 40)


@query(SQL + "SELECT seq, url, timestamp_ns, artifact, timestamp_ns <> 0 AS timed FROM (SELECT *, row_number() OVER (PARTITION BY url, timestamp_ns, artifact ORDER BY seq) AS rn FROM ev2) WHERE rn = 1")
def unified_timeline(spark, sf_dir):
    return timeline.deduplicated(with_copies(activity(spark, sf_dir))).select("seq", "url", "timestamp_ns", "artifact", "timed")


@query(SQL + """SELECT count(*) FILTER (WHERE timestamp_ns <> 0) AS timed, count(*) FILTER (WHERE timestamp_ns = 0) AS untimed, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed
FROM (SELECT url, timestamp_ns, artifact, count(*) AS n FROM ev2 GROUP BY ALL)""")
def timeline_stats(spark, sf_dir):
    return timeline.timeline_stats(with_copies(activity(spark, sf_dir)))


SESSIONS = SQL + f""", s AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY profile ORDER BY timestamp_ns, seq)),
ses AS (SELECT seq, profile, timestamp_ns, CAST(sum(fresh) OVER (PARTITION BY profile ORDER BY timestamp_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM s)"""


@query(SESSIONS + " SELECT seq, profile, session_id FROM ses")
def sessionize(spark, sf_dir):
    return timeline.sessionize(activity(spark, sf_dir), 6 * HOUR).select("seq", "profile", "session_id")


@query(SESSIONS + " SELECT profile, session_id, count(*) AS events, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns FROM ses GROUP BY 1, 2")
def session_summary(spark, sf_dir):
    return timeline.session_summary(timeline.sessionize(activity(spark, sf_dir), 6 * HOUR))


CHAINS = SQL.replace("WITH base", "WITH RECURSIVE base") + """, hist AS (SELECT * FROM ev WHERE artifact = 'History'),
walk AS (SELECT seq, from_visit AS cur, profile, 0 AS depth FROM hist UNION ALL
  SELECT w.seq, p.from_visit, w.profile, w.depth + 1 FROM walk w JOIN hist p ON p.profile = w.profile AND p.visit_id = w.cur WHERE w.cur <> 0),
deep AS (SELECT seq, CAST(max(depth) AS BIGINT) AS nav_depth FROM walk GROUP BY 1)"""


def _history(spark, sf_dir):
    return activity(spark, sf_dir).where("artifact = 'History'")


@query(CHAINS + " SELECT h.seq, h.visit_id, p.url AS referrer_url, d.nav_depth FROM hist h JOIN deep d USING (seq) LEFT JOIN hist p ON p.profile = h.profile AND p.visit_id = h.from_visit AND h.from_visit <> 0")
def referrer_depth(spark, sf_dir):
    return visits.referrer_chains(_history(spark, sf_dir)).select("seq", "visit_id", "referrer_url", "nav_depth")


REDIRECTS = SQL.replace("WITH base", "WITH RECURSIVE base") + """, hist AS (SELECT * FROM ev WHERE artifact = 'History'),
red AS (SELECT r.*, p.visit_id AS parent, p.is_redirect AS pred, p.url AS purl, row_number() OVER (PARTITION BY r.profile, r.from_visit ORDER BY r.seq) AS nth
  FROM (SELECT * FROM hist WHERE is_redirect) r LEFT JOIN hist p ON p.profile = r.profile AND p.visit_id = r.from_visit),
heads AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS chain_id FROM red WHERE NOT coalesce(pred, false)),
run AS (SELECT chain_id, profile, visit_id, url, redirect_kind AS kind, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS position FROM heads UNION ALL
  SELECT c.chain_id, c.profile, r.visit_id, r.url, r.redirect_kind, c.position + 1 FROM run c JOIN red r ON r.profile = c.profile AND r.from_visit = c.visit_id AND r.nth = 1),
hops AS (SELECT * FROM run UNION ALL SELECT chain_id, profile, parent, purl, NULL, 0 FROM heads WHERE parent IS NOT NULL),
roled AS (SELECT profile, chain_id, CAST(position AS BIGINT) AS position, visit_id, url, kind,
  CASE WHEN position = count(*) OVER (PARTITION BY chain_id) - 1 THEN 'landing' WHEN position = 0 THEN 'start' ELSE 'hop' END AS role FROM hops)"""


@query(REDIRECTS + " SELECT * FROM roled")
def redirect_chains(spark, sf_dir):
    return visits.redirect_chains(_history(spark, sf_dir))


@query(REDIRECTS + ", t AS (SELECT profile, visit_id, max(chain_id) AS redirect_chain_id, arg_max(role, chain_id) AS redirect_role FROM roled GROUP BY 1, 2) SELECT h.seq, t.redirect_chain_id, t.redirect_role FROM hist h LEFT JOIN t USING (profile, visit_id)")
def redirect_tags(spark, sf_dir):
    return visits.redirect_tags(_history(spark, sf_dir)).select("seq", "redirect_chain_id", "redirect_role")


@query(SQL + "SELECT seq, url FROM ev WHERE artifact = 'History' AND NOT (is_redirect AND NOT chain_end)")
def collapse_redirects(spark, sf_dir):
    return timeline.collapse_redirects(_history(spark, sf_dir)).select("seq", "url")


PLACED = HOSTED + ", t AS (SELECT seq, timestamp_ns AS ts, domain AS host, row_number() OVER (ORDER BY timestamp_ns, seq) AS place FROM hd WHERE timestamp_ns <> 0 AND {0})"
NEAR = f"SELECT least(a.host, b.host) AS src, greatest(a.host, b.host) AS dst, count(*) AS weight FROM t a JOIN t b ON b.place > a.place AND b.place <= a.place + {correlate.NEIGHBOURS} AND b.ts - a.ts <= {{0}} WHERE a.host <> b.host GROUP BY 1, 2"
EDGES = PLACED.format("artifact = 'History'").replace("WITH base", "WITH RECURSIVE base") + f""", he AS (SELECT * FROM hd WHERE artifact = 'History'),
edges AS (SELECT p.domain AS src, e.domain AS dst, CASE WHEN e.is_redirect THEN 'redirect' ELSE 'referrer' END AS kind, count(*) AS weight
  FROM he e JOIN he p ON p.profile = e.profile AND p.visit_id = e.from_visit WHERE e.from_visit <> 0 AND p.domain <> e.domain GROUP BY 1, 2, 3 UNION ALL SELECT src, dst, 'co-occurrence', weight FROM ({NEAR.format(600 * 10**9)})),
nodes AS (SELECT domain AS id, count(*) AS events, list_sort(list(DISTINCT browser)) AS browsers FROM he GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {correlate.MAX_NODES})"""


def _graph(spark, sf_dir, **caps):
    chained = visits.referrers(_history(spark, sf_dir))
    return correlate.entity_graph(chained, ur.domain_of(F.col("url")), ur.domain_of(F.col("referrer_url")), 600 * 10**9, **caps)


@query(EDGES + " SELECT * FROM nodes")
def entity_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


#: All edges: each event with all others of its window.
WHOLE_EDGES = EDGES.replace(f" AND b.place <= a.place + {correlate.NEIGHBOURS}", "")


@query(WHOLE_EDGES + " SELECT src, dst, kind, weight FROM edges")
def entity_graph_edges(spark, sf_dir):
    return correlate.whole_edges(visits.referrers(_history(spark, sf_dir)), ur.domain_of(F.col("url")), ur.domain_of(F.col("referrer_url")), 600 * 10**9)


@query(EDGES + " SELECT (SELECT count(*) FROM nodes) > 2 AS nodes_truncated, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM nodes ORDER BY events DESC, id LIMIT 2) AND dst IN (SELECT id FROM nodes ORDER BY events DESC, id LIMIT 2)) > 3 AS edges_truncated")
def entity_graph_flags(spark, sf_dir):
    return _graph(spark, sf_dir, most_nodes=2, most_edges=3)[2]


@query(PLACED.format("true") + " " + NEAR.format(600 * 10**9))
def cooccurrence(spark, sf_dir):
    return correlate.cooccurrence(activity(spark, sf_dir), ur.domain_of(F.col("url")), 600 * 10**9)


@query(PLACED.format("true").replace("domain AS host", "fullhost AS host") + " " + NEAR.format(600 * 10**9))
def cooccurrence_by_host(spark, sf_dir):
    return correlate.cooccurrence(activity(spark, sf_dir), ur.host_of(F.col("url")), 600 * 10**9)


@query(SQL + "SELECT seq, url FROM ev WHERE contains(url, 'blog.')")
def filter_substring(spark, sf_dir):
    return search.filter_events(activity(spark, sf_dir), "blog.", ["url", "description"]).select("seq", "url")


@query(SQL + r"SELECT seq, url FROM ev WHERE regexp_matches(url, '/(en|fr)/[0-9]+\?')")
def filter_regex(spark, sf_dir):
    return search.filter_events(activity(spark, sf_dir), r"/(en|fr)/[0-9]+\?", ["url"], regex=True).select("seq", "url")


@query(SQL + f"SELECT seq, timestamp_ns FROM ev WHERE timestamp_ns BETWEEN {PIVOT} AND {PIVOT + 48 * HOUR}")
def filter_time_window(spark, sf_dir):
    return search.filter_events(activity(spark, sf_dir), start_ns=PIVOT, end_ns=PIVOT + 48 * HOUR).select("seq", "timestamp_ns")


@query(SQL + f"SELECT seq, timestamp_ns FROM ev WHERE timestamp_ns BETWEEN {PIVOT - 24 * HOUR} AND {PIVOT + 24 * HOUR}")
def around_pivot(spark, sf_dir):
    return timeline.around(activity(spark, sf_dir), PIVOT, 24 * HOUR).select("seq", "timestamp_ns")


@query(SQL + f"SELECT seq, timestamp_ns FROM ev WHERE artifact = 'Cache' AND timestamp_ns > 0 AND timestamp_ns <= {PIVOT}")
def tabs_open_at(spark, sf_dir):
    return timeline.tabs_open_at(activity(spark, sf_dir), PIVOT, "Cache").select("seq", "timestamp_ns")


KINDS_SQL = "(VALUES " + ", ".join(f"('{a}', '{s}', '{st}', '{'surrounding_page' if a == 'Cache' else 'explicit'}', '{ac}', '{'high' if st == 'live' else 'low'}', 'find.{s}.{st}.v1')" for a, s, st, ac in (("History", "history", "live", "visited"), ("Downloads", "download", "live", "downloaded"), ("Autofill", "history", "live", "observed_string"), ("Cache", "cache", "live", "observed_string"))) + ") k(artifact, evidence_source, state, basis, action, confidence, rule_id)"


@query(SQL + f"SELECT e.seq, t.term, e.timestamp_ns, e.browser, e.url AS match, k.evidence_source, k.state, k.basis, k.action, k.confidence, k.rule_id FROM ev e JOIN (VALUES ('blog.'), ('example.org'), ('ref=x')) t(term) ON contains(e.url, t.term) JOIN {KINDS_SQL} ON k.artifact = e.artifact")
def find_hits(spark, sf_dir):
    return search.find_hits(activity(spark, sf_dir), ["blog.", "example.org", "ref=x"], ["url", "description"])


@query(SQL + f"SELECT k.evidence_source, k.state, count(*) AS hits FROM ev e JOIN {KINDS_SQL} ON k.artifact = e.artifact WHERE contains(e.url, 'example.net') AND k.evidence_source IN ('history', 'cache') GROUP BY 1, 2")
def find_by_source(spark, sf_dir):
    hits = search.find_hits(activity(spark, sf_dir), ["example.net"], ["url", "description"]).where(F.col("evidence_source").isin("history", "cache"))
    return hits.groupBy("evidence_source", "state").agg(F.count("*").alias("hits"))


BLOCKED = ["# comment", "example.org", " Blog.THINON.example.com.", "", "example.org", "spam-farm.example.org"]


@query(f"WITH h AS (SELECT page_id, {HOST.format('url')} AS host FROM pages) SELECT page_id, host, d.domain FROM h JOIN (VALUES ('example.org'), ('blog.thinon.example.com'), ('spam-farm.example.org')) d(domain) ON host = domain OR host LIKE '%.' || domain")
def blocklist_match(spark, sf_dir):
    listed = search.normalized_blocklist(spark.createDataFrame([(x,) for x in BLOCKED], "value string"))
    return search.blocklist_hits(table(spark, sf_dir, "pages"), ur.host_of(F.col("url")), F.broadcast(listed)).select("page_id", "host", "domain")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _found_sql(pattern: str, where: str = "true") -> str:
    return f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents) WHERE {where} GROUP BY 1, 2"


LUHN = "list_sum(list_transform(range(1, len(value) + 1), lambda i: CASE WHEN (len(value) - i) % 2 = 0 THEN CAST(substr(value, i, 1) AS INT) ELSE (CAST(substr(value, i, 1) AS INT) * 2) // 10 + (CAST(substr(value, i, 1) AS INT) * 2) % 10 END)) % 10 = 0"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _counted(rows):
    return rows.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(_found_sql(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"))
def ioc_email(spark, sf_dir):
    return _counted(indicators.emails(_texts(spark, sf_dir)))


@query(_found_sql(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", f"regexp_full_match(value, '{OCTET}(\\.{OCTET}){{3}}')"))
def ioc_ipv4(spark, sf_dir):
    return _counted(indicators.ipv4(_texts(spark, sf_dir)))


@query(_found_sql(r"\b[0-9]{13,19}\b", LUHN))
def ioc_card(spark, sf_dir):
    return _counted(indicators.cards(_texts(spark, sf_dir)))


@query("WITH " + ", ".join(f"{k} AS ({_found_sql(p, w)})" for k, p, w in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", f"regexp_full_match(value, '{OCTET}(\\.{OCTET}){{3}}')"), ("card", r"\b[0-9]{13,19}\b", LUHN), ("eth", r"\b0x[0-9a-fA-F]{40}\b", "true"))) + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(sum(n) AS BIGINT) AS found, count(DISTINCT doc_id) AS documents FROM {k} HAVING count(*) > 0" for k in ("email", "ipv4", "card", "eth")))
def ioc_all(spark, sf_dir):
    return indicators.all_indicators(_texts(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("found"), F.count_distinct("doc_id").alias("documents"))


@query(r"""SELECT page_id, string_agg(replace(x, '=', ': '), ' | ' ORDER BY i) || ' [Query String Parser]' AS text FROM (
SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS x, generate_subscripts(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), 1) AS i FROM pages WHERE regexp_matches(url, '\?[^#]')) WHERE x LIKE '%=_%' GROUP BY 1""")
def query_string_interp(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ur.query_string(F.col("url")).alias("text")).where("text IS NOT NULL")


@query(SQL + "SELECT seq, strftime(make_timestamp(timestamp_ns // 1000000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS shown FROM ev WHERE timestamp_ns <> 0")
def friendly_dates(spark, sf_dir):
    rows = activity(spark, sf_dir).where("timestamp_ns <> 0")
    return rows.select("seq", friendly_date(F.expr("timestamp_ns div 1000000")).alias("shown"))


CODE = "(k % 12) + (k % 3) * 1073741824 + (k % 2) * 536870912"


@query(SQL + f""", c AS (SELECT seq, {CODE} AS code FROM ev) SELECT seq, code,
coalesce(['link', 'typed', 'auto_bookmark', 'auto_subframe', 'manual_subframe', 'generated', 'auto_toplevel', 'form_submit', 'reload', 'keyword', 'keyword_generated'][CAST((code & 255) + 1 AS INT)], 'unknown') AS core,
(code & 3221225472) <> 0 AS redirects, (code & 536870912) <> 0 AS ends_chain, CASE WHEN (code & 2147483648) <> 0 THEN 'server' WHEN (code & 1073741824) <> 0 THEN 'client' END AS kind FROM c""")
def transition_decode(spark, sf_dir):
    rows = activity(spark, sf_dir).select("seq", F.expr(CODE).alias("code"))
    code = F.col("code")
    flags = tx.CLIENT_REDIRECT | tx.SERVER_REDIRECT
    return rows.select("seq", "code", tx.transition_core(code).alias("core"), tx.has_flag(code, flags).alias("redirects"), tx.has_flag(code, tx.CHAIN_END).alias("ends_chain"), tx.redirect_kind(code).alias("kind"))


VISITS_SQL = "vis AS (SELECT l_linestatus || l_returnflag AS db, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS url_id, epoch_us(l_shipdate) AS ts FROM lineitem)"
URLS_SQL = "url AS (SELECT o_orderkey AS id, o_orderkey % 9 AS visit_count, epoch_us(o_orderdate) + (o_orderkey % 3) * 86400000000 * 30 AS last_visit FROM orders)"


def _visit_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("db"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("url_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"))


def _url_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), (key % 9).alias("visit_count"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (key % 3) * 86400000000 * 30).alias("last_visit"))


@query(f"WITH {VISITS_SQL}, g AS (SELECT db, id AS next_id, lag(id) OVER (PARTITION BY db ORDER BY id) AS after_id FROM vis) SELECT db, min(after_id) AS after_id, arg_min(next_id, after_id) AS next_id FROM g WHERE next_id - after_id > 1 GROUP BY 1")
def visit_id_gaps(spark, sf_dir):
    return integrity.id_gaps(_visit_rows(spark, sf_dir))


@query(f"WITH {VISITS_SQL}, g AS (SELECT db, id, ts, lag(ts) OVER (PARTITION BY db ORDER BY id) AS before FROM vis) SELECT db, min(id) AS id, arg_min(ts, id) AS ts, arg_min(before, id) AS before FROM g WHERE ts < before GROUP BY 1")
def nonmonotonic_times(spark, sf_dir):
    return integrity.time_reversals(_visit_rows(spark, sf_dir))


@query(f"WITH {VISITS_SQL}, {URLS_SQL} SELECT u.id, u.visit_count, coalesce(n, 0) AS found FROM url u LEFT JOIN (SELECT url_id, count(*) AS n FROM vis GROUP BY 1) v ON v.url_id = u.id WHERE u.visit_count > coalesce(n, 0)")
def visit_count_mismatch(spark, sf_dir):
    return integrity.visit_count_mismatches(_url_rows(spark, sf_dir), _visit_rows(spark, sf_dir))


@query(f"WITH {VISITS_SQL}, {URLS_SQL} SELECT u.id, u.last_visit, v.latest FROM url u JOIN (SELECT url_id, max(ts) AS latest FROM vis GROUP BY 1) v ON v.url_id = u.id WHERE u.last_visit > 0 AND u.last_visit <> v.latest")
def last_visit_mismatch(spark, sf_dir):
    return integrity.last_visit_mismatches(_url_rows(spark, sf_dir), _visit_rows(spark, sf_dir))


LIMIT_US = 900_000_000_000_000


@query(f"WITH {VISITS_SQL} SELECT id, ts FROM vis WHERE ts > {LIMIT_US}")
def future_timestamps(spark, sf_dir):
    return integrity.future_times(_visit_rows(spark, sf_dir), F.lit(LIMIT_US)).select("id", "ts")


@query("SELECT o_orderkey AS id, epoch_us(o_orderdate) * 1000 AS created_ns, (epoch_us(o_orderdate) + (o_custkey % 3 - 1) * 1000000) * 1000 AS last_access_ns FROM orders WHERE o_custkey % 3 = 0 AND epoch_us(o_orderdate) > 1000000")
def cookie_anomaly(spark, sf_dir):
    created = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), created.alias("created"), (created + (F.col("o_custkey") % 3 - 1) * 1000000).alias("last_access"))
    return integrity.cookie_anomalies(rows)


SEQUENCES = [("orders", 10_000_000), ("customer", 1), ("gone", 5)]


@query("WITH s(name, seq) AS (VALUES ('orders', 10000000::BIGINT), ('customer', 1), ('gone', 5)), t AS (SELECT 'orders' AS name, max(o_orderkey) AS m FROM orders UNION ALL SELECT 'customer', max(c_custkey) FROM customer) SELECT s.name, s.seq, coalesce(m, 0) AS max_rowid FROM s LEFT JOIN t USING (name) WHERE s.seq > coalesce(m, 0)")
def sequence_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("rowid")).unionByName(table(spark, sf_dir, "customer").select(F.lit("customer").alias("name"), F.col("c_custkey").alias("rowid")))
    return integrity.sequence_gaps(spark.createDataFrame(SEQUENCES, "name string, seq bigint"), rows)


@query("WITH u AS (SELECT l_linestatus AS db, max(l_orderkey) AS m FROM lineitem GROUP BY 1), s(db, seq) AS (VALUES ('F', 1::BIGINT), ('O', 100000000), ('X', 4)) SELECT s.db, CASE WHEN m IS NULL THEN 'HistoryCleared' ELSE 'AutoIncrementGap' END AS tag, s.seq, m AS max_id FROM s LEFT JOIN u USING (db) WHERE (m IS NULL AND s.seq > 0) OR (m > 0 AND s.seq > 5 * m)")
def history_cleared(spark, sf_dir):
    urls = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("db"), F.col("l_orderkey").alias("id"))
    return integrity.cleared_history(urls, spark.createDataFrame([("F", 1), ("O", 100_000_000), ("X", 4)], "db string, seq bigint"))


@query(f"WITH h AS (SELECT page_id, regexp_replace({HOST.format('url')}, '^www\\.', '') AS d FROM pages) SELECT DISTINCT d AS domain, CASE WHEN page_id % 2 = 0 THEN 'cookies' ELSE 'favicons' END AS source FROM h WHERE page_id % 3 = 0 AND d NOT IN (SELECT d FROM h WHERE page_id % 3 = 1)")
def incognito_residue(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", ur.host_of(F.col("url")).alias("domain"))
    residual = rows.where("page_id % 3 = 0").select("domain", F.when(F.col("page_id") % 2 == 0, "cookies").otherwise("favicons").alias("source"))
    return integrity.incognito_residue(residual, rows.where("page_id % 3 = 1"))


@query(SQL + "SELECT url, arg_max(description || seq, timestamp_ns::HUGEINT * 10000000000 + seq) AS title, max(timestamp_ns) AS backup_date FROM ev WHERE artifact = 'Cache' AND url NOT IN (SELECT url FROM ev WHERE artifact = 'Downloads' AND k % 9 = 0) GROUP BY 1")
def deleted_bookmarks(spark, sf_dir):
    e = activity(spark, sf_dir)
    backups = e.where("artifact = 'Cache'").select("url", F.concat("description", F.col("seq").cast("string")).alias("title"), F.col("timestamp_ns").alias("backup_date"), F.col("seq").alias("name"))
    return integrity.deleted_bookmarks(backups, e.where("artifact = 'Downloads' AND k % 9 = 0")).select("url", "title", "backup_date")


DOWNLOADS = SQL + """, d AS (SELECT seq, browser, '/home/u/' || ['setup.exe', 'notes.txt', 'tool.SH', 'a.pdf'][CAST(k % 4 + 1 AS INT)] AS evidence, CASE WHEN k % 10 = 3 THEN 2 ELSE 0 END AS danger FROM ev WHERE artifact = 'Downloads'),
f AS (SELECT seq, 'high' AS priority, 'medium' AS confidence, 'exec_download.v1' AS rule_id, 'download' AS evidence_source, 'live' AS state, evidence, browser FROM d WHERE danger <> 0 OR evidence LIKE '%.exe' OR evidence LIKE '%.SH')"""


def _downloads(spark, sf_dir):
    e = activity(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(x) for x in ("setup.exe", "notes.txt", "tool.SH", "a.pdf")]), (F.col("k") % 4 + 1).cast("int"))
    return findings.executable_downloads(e, F.concat(F.lit("/home/u/"), name), F.when(F.col("k") % 10 == 3, 2).otherwise(0))


@query(DOWNLOADS + " SELECT * FROM f")
def exec_downloads(spark, sf_dir):
    return _downloads(spark, sf_dir)


TAGS = ("HistoryCleared", "VisitIdGap", "SqliteSequenceGap", "TimestampInFuture")
FINDINGS = DOWNLOADS + """, i AS (SELECT seq, CASE WHEN k % 4 IN (0, 2) THEN 'high' ELSE 'medium' END AS priority, 'medium' AS confidence, 'integrity.' || ['HistoryCleared', 'VisitIdGap', 'SqliteSequenceGap', 'TimestampInFuture'][CAST(k % 4 + 1 AS INT)] || '.v1' AS rule_id,
'history' AS evidence_source, CASE WHEN k % 4 IN (0, 2) THEN 'deleted' ELSE 'inferred' END AS state, 'profile ' || profile AS evidence, CAST(NULL AS VARCHAR) AS browser FROM ev WHERE artifact = 'Autofill'), al AS (SELECT * FROM f UNION ALL SELECT * FROM i)"""


def _findings(spark, sf_dir):
    e = activity(spark, sf_dir).where("artifact = 'Autofill'")
    tags = e.select("seq", F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.col("k") % 4 + 1).cast("int")).alias("tag"), F.concat(F.lit("profile "), F.col("profile").cast("string")).alias("observation"))
    return _downloads(spark, sf_dir).unionByName(findings.integrity_findings(tags))


@query(FINDINGS + " SELECT seq, priority, rule_id, evidence, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank_key FROM al")
def findings_ranked(spark, sf_dir):
    return findings.ranked(_findings(spark, sf_dir)).select("seq", "priority", "rule_id", "evidence", "rank_key")


@query(FINDINGS + " SELECT min(seq) AS seq, evidence, evidence_source, state FROM al GROUP BY 2, 3, 4")
def findings_dedup(spark, sf_dir):
    return findings.deduplicated(_findings(spark, sf_dir)).select("seq", "evidence", "evidence_source", "state")


RECORDS = HOSTED + ", r AS (SELECT *, CASE artifact WHEN 'History' THEN 'visit' WHEN 'Cache' THEN 'open_tab' WHEN 'Downloads' THEN 'search' ELSE 'closed_tab' END AS kind FROM hd)"
ALLOWED = "(fullhost = 'example.com' OR fullhost LIKE '%.example.com')"


def _records(spark, sf_dir):
    kind = F.when(F.col("artifact") == "History", "visit").when(F.col("artifact") == "Cache", "open_tab").when(F.col("artifact") == "Downloads", "search").otherwise("closed_tab")
    return activity(spark, sf_dir).withColumn("kind", kind).withColumn("title", F.col("description"))


ELIGIBLE = f"(kind IN ('open_tab', 'closed_tab') OR (timestamp_ns >= {PIVOT} AND NOT (kind = 'visit' AND is_redirect AND NOT chain_end)))"


@query(RECORDS + f" SELECT kind, place, timestamp_ns, regexp_replace(url, '[?#].*$', '') AS url, 'visit ' || CASE WHEN regexp_full_match(url, '[A-Za-z0-9+/=_.-]{{24,}}') AND regexp_matches(url, '[0-9]') THEN '[redacted]' ELSE url END AS title FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY timestamp_ns DESC, seq) AS place FROM r WHERE {ELIGIBLE} AND {ALLOWED}) WHERE place <= 20")
def browsing_context(spark, sf_dir):
    return views.browsing_context(_records(spark, sf_dir), PIVOT + 15 * 60 * 10**9, ["example.com"])


@query(RECORDS + f" SELECT count(*) AS omitted FROM r WHERE {ELIGIBLE} AND NOT {ALLOWED}")
def omitted_by_policy(spark, sf_dir):
    return views.omitted_by_policy(_records(spark, sf_dir), PIVOT + 15 * 60 * 10**9, ["example.com"])


@query(RECORDS + f" SELECT seq, timestamp_ns, regexp_replace(url, '[?#].*$', '') AS url FROM r WHERE contains(lower(url), 'blog') AND {ALLOWED}")
def did_user_visit(spark, sf_dir):
    return views.did_user_visit(_records(spark, sf_dir), "BLOG", ["example.com"])


@query(SQL + "SELECT DISTINCT browser FROM ev")
def list_browsers(spark, sf_dir):
    return views.list_browsers(activity(spark, sf_dir))


@query(r"""SELECT conv_id, turn, string_agg(CASE WHEN regexp_matches(x, '^[^@]+@[^@]*') AND regexp_matches(regexp_replace(x, '^[^@]*@', ''), '\.') AND NOT regexp_matches(x, '\.$') THEN '[redacted-email]'
WHEN regexp_full_match(x, '[A-Za-z0-9+/=_.-]{24,}') AND regexp_matches(x, '[0-9]') THEN '[redacted]' ELSE x END, ' ' ORDER BY i) AS masked
FROM (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT conv_id, turn, string_split_regex(text, '\s+') AS p FROM conversations)) WHERE x <> '' GROUP BY 1, 2""")
def redact_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("text").rlike(r"\S")).select("conv_id", "turn", "text")
    masked = rows.select("conv_id", "turn", tx.mask_secrets(F.col("text")).alias("masked"))
    return masked


SLOT = "CASE artifact WHEN 'History' THEN 'A' WHEN 'Downloads' THEN 'B' ELSE 'A' END"
LABEL = "CASE artifact WHEN 'History' THEN 'Last Visited Time' WHEN 'Downloads' THEN 'Download Started Time' WHEN 'Autofill' THEN 'Last Used Time' ELSE 'Last Access Time' END"


@query(SQL + f"SELECT '0|[' || lower(browser) || ' ' || lower(artifact) || '] ' || url || ' (' || {LABEL} || ')|0|0|0|0|0|' || CASE WHEN {SLOT} = 'A' THEN timestamp_ns // 1000000000 ELSE 0 END || '|0|0|' || CASE WHEN {SLOT} = 'B' THEN timestamp_ns // 1000000000 ELSE 0 END AS line FROM ev")
def bodyfile(spark, sf_dir):
    return writers.bodyfile(activity(spark, sf_dir))


STAMP = "strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp_ns % 1000000000 = 0 THEN '' WHEN timestamp_ns % 1000000 = 0 THEN '.' || lpad(CAST(timestamp_ns % 1000000000 // 1000000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(timestamp_ns % 1000000000 // 1000 AS VARCHAR), 6, '0') END || '+00:00'"
QUOTED = """CASE WHEN regexp_matches({0}, '[",\n\r]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""
#: What the query string of a URL says, for URLs of no search engine.
SAID = """(SELECT url, string_agg(replace(x, '=', ': '), ' | ' ORDER BY i) || ' [Query String Parser]' AS said FROM (
SELECT url, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS x, generate_subscripts(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), 1) AS i FROM (SELECT DISTINCT url FROM pages) WHERE regexp_matches(url, '\\?[^#]')) WHERE x LIKE '%=_%' GROUP BY 1)"""
EXTRA = "concat_ws('; ', 'chain_end=' || chain_end, 'from_visit=' || from_visit, 'host=' || fullhost, 'is_redirect=' || is_redirect, 'k=' || k, 'profile=' || profile, 'redirect_kind=' || redirect_kind, 'url=' || url, 'user=' || 'u' || profile, 'visit_id=' || visit_id)"


def _attributed(spark, sf_dir):
    return activity(spark, sf_dir).withColumns({"host": ur.host_of(F.col("url")), "user": F.concat(F.lit("u"), F.col("profile").cast("string"))})


@query(HOSTED + f""" SELECT strftime(make_timestamp(timestamp_ns // 1000), '%m/%d/%Y') || ',' || strftime(make_timestamp(timestamp_ns // 1000), '%H:%M:%S') || ',UTC,' || CASE WHEN {SLOT} = 'A' THEN '.A..' ELSE '...B' END || ',WEBHIST,' || browser || ' ' || artifact || ',' || {LABEL} || ',u' || profile || ',' || fullhost || ','
|| description || ',' || description || ' [' || url || '],2,' || source || ',,,waylens,' || {QUOTED.format(EXTRA)} AS line FROM hd""")
def l2t_csv(spark, sf_dir):
    return writers.l2t_csv(_attributed(spark, sf_dir))


@query(SQL + f"SELECT {STAMP} AS timestamp, browser, artifact, ev.url, '' AS title, description, coalesce(said, '') AS interpretation, source FROM ev LEFT JOIN {SAID} s ON s.url = ev.url")
def export_rows(spark, sf_dir):
    return writers.export_rows(activity(spark, sf_dir))


@query(SQL + f"SELECT concat_ws(',', {STAMP}, browser, artifact, {QUOTED.format('ev.url')}, '', {QUOTED.format('description')}, {QUOTED.format("coalesce(said, '')")}, source) AS line FROM ev LEFT JOIN {SAID} s ON s.url = ev.url")
def export_csv(spark, sf_dir):
    return writers.export_lines(activity(spark, sf_dir), "csv")


@query(SQL + f"SELECT '[' || {STAMP} || '] ' || browser || '/' || artifact || ': ' || description || '  <' || ev.url || '>' || CASE WHEN said IS NULL THEN '' ELSE '  {{' || said || '}}' END AS line FROM ev LEFT JOIN {SAID} s ON s.url = ev.url")
def export_text(spark, sf_dir):
    return writers.export_lines(activity(spark, sf_dir), "text")


@query(SQL + f"SELECT to_json({{'artifact': artifact, 'browser': browser, 'description': description, 'interpretation': coalesce(said, ''), 'source': source, 'timestamp': {STAMP}, 'title': '', 'url': ev.url}}) AS line FROM ev LEFT JOIN {SAID} s ON s.url = ev.url")
def export_jsonl(spark, sf_dir):
    return writers.export_lines(activity(spark, sf_dir), "jsonl")


@query(SQL + f"SELECT '{{\"artifact\":\"' || artifact || '\",\"browser\":\"' || browser || '\",\"chain_end\":' || chain_end || ',\"description\":\"' || description || '\",\"from_visit\":' || from_visit || ',\"is_redirect\":' || is_redirect || ',\"k\":' || k || ',\"profile\":' || profile || CASE WHEN redirect_kind IS NULL THEN '' ELSE ',\"redirect_kind\":\"' || redirect_kind || '\"' END || ',\"source\":\"' || source || '\",\"timestamp\":\"' || {STAMP} || '\",\"timestamp_ns\":' || timestamp_ns || ',\"title\":\"\",\"url\":\"' || url || '\",\"visit_id\":' || visit_id || '}}' AS line FROM ev")
def event_jsonl(spark, sf_dir):
    return writers.event_lines(activity(spark, sf_dir), "jsonl")


@query(SQL + f"SELECT concat_ws(',', {STAMP}, browser, artifact, {QUOTED.format('url')}, '') AS line FROM ev")
def event_csv(spark, sf_dir):
    return writers.event_lines(activity(spark, sf_dir), "csv")


@query(SQL + f"SELECT concat_ws(',', {STAMP}, browser, artifact, source, {QUOTED.format('description')}) AS line FROM ev")
def event_source_csv(spark, sf_dir):
    return writers.event_lines(activity(spark, sf_dir), "source_csv")


@query(SQL + f"SELECT '[' || {STAMP} || '] ' || browser || '/' || artifact || ': ' || description || '  <' || url || '>' AS line FROM ev")
def event_text(spark, sf_dir):
    return writers.event_lines(activity(spark, sf_dir), "text")


@query(SQL + f"SELECT concat_ws(',', 'blog.', k.evidence_source, k.state, k.confidence, k.rule_id, k.basis, k.action, {QUOTED.format('e.url')}) AS line FROM ev e JOIN {KINDS_SQL} ON k.artifact = e.artifact WHERE contains(e.url, 'blog.')")
def find_hits_csv(spark, sf_dir):
    return writers.hit_lines(search.find_hits(activity(spark, sf_dir), ["blog."]), "csv")


@query(SQL + f"SELECT {STAMP} AS timestamp, browser, artifact, ev.url, '' AS title, description, coalesce(said, '') AS interpretation, source FROM ev LEFT JOIN {SAID} s ON s.url = ev.url")
def export_sqlite(spark, sf_dir):
    """The export written as SQLite files in tasks, and read back from them."""
    folder = scratch_path(spark, "export")
    writers.write_sqlite(writers.export_rows(activity(spark, sf_dir)), folder)
    return sqlite_rows(evidence_files(spark, folder), "timeline").select(F.from_json("row", ", ".join(f"{c} string" for c in writers.EXPORT)).alias("r")).select("r.*")


@query(FINDINGS.replace(", al AS", ", aq AS (SELECT seq, priority, rule_id, evidence, 0 AS kind FROM f UNION ALL SELECT seq, priority, rule_id, evidence, 1 FROM i UNION ALL SELECT 0, 'info', 'investigate.encrypted_cookies.v1', count(*) || ' cookie value(s) stored encrypted (not recoverable without keys)', 2 FROM ev WHERE artifact = 'Cache' AND k % 2 = 0 HAVING count(*) > 0), al AS")
       + " SELECT seq, priority, rule_id, evidence, CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, kind, seq) - 1 AS BIGINT) AS rank FROM aq")
def assembled_findings(spark, sf_dir):
    """Findings of all kinds in one order, which ranks over ranges number."""
    e = activity(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(x) for x in ("setup.exe", "notes.txt", "tool.SH", "a.pdf")]), (F.col("k") % 4 + 1).cast("int"))
    rows = e.withColumns({
        "target_path": F.when(F.col("artifact") == "Downloads", F.concat(F.lit("/home/u/"), name)), "danger_type": F.when(F.col("k") % 10 == 3, "2").otherwise("0"),
        "encrypted_value": F.when((F.col("artifact") == "Cache") & (F.col("k") % 2 == 0), "ENCRYPTED"), "artifact": F.when(F.col("artifact") == "Cache", "Cookies").otherwise(F.col("artifact")),
    })
    tags = e.where("artifact = 'Autofill'").select("seq", F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.col("k") % 4 + 1).cast("int")).alias("tag"), F.concat(F.lit("profile "), F.col("profile").cast("string")).alias("observation"))
    return ranked(findings.assembled(rows, tags), "place").select("seq", "priority", "rule_id", "evidence", "rank")


@query(FINDINGS + " SELECT seq, priority, rule_id, evidence, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank_key FROM al ORDER BY rank_key, seq LIMIT 7")
def visible_findings(spark, sf_dir):
    return findings.visible(_findings(spark, sf_dir)).select("seq", "priority", "rule_id", "evidence", "rank_key")


@query(SQL + "SELECT seq, url FROM ev WHERE contains(url[1:22], 'www') OR contains(('visit ' || url)[1:22], 'www')")
def filter_bounded(spark, sf_dir):
    """Only the first bytes of a field count."""
    return search.filter_events(activity(spark, sf_dir), "www", ["url", "description"], limit=22).select("seq", "url")


def _escaped(c: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{sign}', '{name}')"
    return c


def _row(*cells: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || {_escaped(c)} || '</td>'" for c in cells) + " || '</tr>'"


_FIXED = [
    "<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8"><title>Case &lt;1&gt;</title></head><body>', "<h1>Case &lt;1&gt;</h1>", "<h2>Ranked findings</h2>", "<table><tr><th>Priority</th><th>Confidence</th><th>Rule</th><th>Evidence</th></tr>", *["</table>"] * 4,
    "<h2>Artifacts observed</h2>", "<table><tr><th>Artifact</th><th>Count</th></tr>", "<h2>Top domains</h2>", "<table><tr><th>Domain</th><th>Events</th></tr>", "<h2>Observations</h2>", "<ul>", "<li>a &amp; b</li>", "</ul>", "<h2>Timeline</h2>",
    "<table><tr><th>Time</th><th>Browser</th><th>Artifact</th><th>Description</th></tr>", "</body></html>",
]


@query(
    FINDINGS + f", hh AS (SELECT *, {HOST.format('url')} AS host FROM ev) SELECT line FROM (VALUES " + ", ".join(f"('{x}')" for x in _FIXED) + f") t(line) UNION ALL (SELECT {_row('priority', 'confidence', 'rule_id', 'evidence')} FROM al ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, seq LIMIT 1000) "
    f"UNION ALL SELECT {_row('artifact', 'CAST(n AS VARCHAR)')} FROM (SELECT artifact, count(*) AS n FROM ev GROUP BY 1) UNION ALL (SELECT {_row('host', 'CAST(n AS VARCHAR)')} FROM (SELECT host, count(*) AS n FROM hh GROUP BY 1) ORDER BY n DESC, host LIMIT 10) "
    f"UNION ALL (SELECT {_row(STAMP, 'browser', 'artifact', 'description')} FROM ev WHERE timestamp_ns <> 0 ORDER BY timestamp_ns, seq LIMIT 1000)"
)
def html_report(spark, sf_dir):
    html = reports.html_report(activity(spark, sf_dir), findings.ranked(_findings(spark, sf_dir)), "Case <1>", flags=("a & b",))
    return spark.createDataFrame([(x,) for x in html.split("\n")], "line string")


@query(EDGES + f", kept AS (SELECT src, dst, kind, weight FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) ORDER BY weight DESC, src, dst, kind LIMIT {correlate.MAX_EDGES}) SELECT 'digraph hosts ' || chr(123) AS line UNION ALL SELECT chr(125) UNION ALL SELECT '  \"' || id || '\" [events=' || events || '];' FROM nodes UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\" [kind=' || kind || ', weight=' || weight || '];' FROM kept")
def graph_dot(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return spark.createDataFrame([(x,) for x in writers.graph_dot(nodes, edges).split("\n")], "line string")


@query(EDGES + " SELECT 'node' AS part, id AS a, array_to_string(browsers, ',') AS b, events AS n FROM nodes UNION ALL SELECT kind, src, dst, weight FROM edges UNION ALL SELECT 'window', '', '', 600 UNION ALL SELECT 'truncated', '', '', 0")
def graph_json(spark, sf_dir):
    """The graph as JSON, taken apart again."""
    text = writers.graph_json(*_graph(spark, sf_dir), 600)
    made = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", "nodes array<struct<id:string,event_count:bigint,browsers:array<string>>>, edges array<struct<from:string,to:string,kind:string,weight:bigint>>, cooccurrence_window_secs bigint, nodes_truncated boolean, edges_truncated boolean").alias("g")).select("g.*")
    nodes = made.select(F.explode("nodes").alias("x")).select(F.lit("node").alias("part"), F.col("x.id").alias("a"), F.array_join("x.browsers", ",").alias("b"), F.col("x.event_count").alias("n"))
    edges = made.select(F.explode("edges").alias("x")).select(F.col("x.kind").alias("part"), F.col("x.from").alias("a"), F.col("x.to").alias("b"), F.col("x.weight").alias("n"))
    cuts = (F.col("nodes_truncated") | F.col("edges_truncated")).cast("bigint")
    facts = made.select(F.explode(F.array(F.struct(F.lit("window").alias("part"), F.col("cooccurrence_window_secs").alias("n")), F.struct(F.lit("truncated").alias("part"), cuts.alias("n")))).alias("x")).select("x.part", F.lit("").alias("a"), F.lit("").alias("b"), "x.n")
    return nodes.unionByName(edges).unionByName(facts)


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, octet_length(encode(text)) AS bytes FROM documents")
def file_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return writers.hashes(d, "doc_id")


@query(r"""SELECT page_id, kind, ref, count(*) AS n FROM (
SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(html, '<link[^>]*\shref="([^"]*)"', 1)) AS ref FROM pages UNION ALL
SELECT page_id, 'src', unnest(regexp_extract_all(html, '<(?:script|img|source|video|audio)[^>]*\ssrc="([^"]*)"', 1)) FROM pages UNION ALL
SELECT page_id, 'anchor', unnest(regexp_extract_all(html, '<a[^>]*\shref="([^"]*)"', 1)) FROM pages) GROUP BY 1, 2, 3""")
def page_references(spark, sf_dir):
    return writers.page_references(table(spark, sf_dir, "pages"))
