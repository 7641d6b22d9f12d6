"""Queries over the readers: stores made of driver tables, read back, against SQL over the same tables.

Each case names the SQL of a store's tables and what DuckDB must say about them: the rows, their time, description and
attributes. Attributes come as ``key=value`` sorted by key, so that all of them are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import stores as evidence
from waylens.plans.scratch import GROUP_BYTES, cut, scratch_path
from waylens.sources import binary, json_readers, leveldb, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The stores of the cases: SQL of a database's tables, or a function that makes other files.
STORES: dict[str, dict[str, str]] = {}
FILES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

STORE = "CAST(floor(event_id / 2500) AS BIGINT) AS store"
#: A time in WebKit and Unix microseconds and seconds, and in seconds since 2001, of an event.
WEBKIT, UNIX, SECONDS, APPLE = "(13350000000000000 + event_id * 1000003)", "(1705526400000000 + event_id * 1000003)", "(1705526400 + event_id)", "(727219200.5 + event_id)"
URL = "concat('https://h', CAST(user_id % 50 AS STRING), '.example/p?i=', CAST(event_id AS STRING))"
SOME = "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE concat(event_type, ' page') END"


def ns_of_webkit(c: str) -> str:
    return f"({c} - 11644473600000000) * 1000"


def shown(events: DataFrame) -> DataFrame:
    """The compared columns of events: attributes as one string, the path left out."""
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return events.select("timestamp_ns", "browser", "artifact", "description", F.array_join(pairs, "; ").alias("attrs"))


def expected(tables: dict[str, str], rows: str, browser: str, artifact: str, ns: str, description: str, attrs: dict[str, str]) -> str:
    """DuckDB SQL of the events of ``rows``, a FROM clause."""
    parts = ", ".join(f"'{k}=' || CAST({attrs[k]} AS VARCHAR)" for k in sorted(attrs))
    made = ", ".join(f"{t} AS ({evidence.duckdb(sql)})" for t, sql in tables.items())
    return f"WITH {made} SELECT CAST({ns} AS BIGINT) AS timestamp_ns, '{browser}' AS browser, '{artifact}' AS artifact, {description} AS description, concat_ws('; ', {parts}) AS attrs FROM {rows}"


def case(name: str, tables: dict[str, str], rows: str, browser: str, artifact: str, ns: str, description: str, /, **attrs: str) -> None:
    """Registers the query of the reader ``name``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = evidence.sqlite_stores({t: evidence.select(spark, sf_dir, sql) for t, sql in tables.items()})
        return shown(readers.read_files(files, name))

    STORES[name] = tables
    QUERIES[f"read_{name}"] = run
    ORACLE_SQL[f"read_{name}"] = expected(tables, rows, browser, artifact, ns, description, attrs)


URLS = f"SELECT {STORE}, event_id AS id, {URL} AS url, {SOME} AS title, event_id % 9 AS visit_count, CASE WHEN event_id % 11 = 0 THEN 0 ELSE {WEBKIT} END AS last_visit_time FROM {{events}}"
case(
    "chromium_history", {"urls": URLS}, "urls WHERE last_visit_time > 0", "Chromium", "History", ns_of_webkit("last_visit_time"),
    "CASE WHEN coalesce(title, '') = '' THEN url ELSE '[' || visit_count || ' visits] ' || title || ' — ' || url END", url="url", title="coalesce(title, '')", visit_count="visit_count",
)

FLAGS = "CASE event_id % 6 WHEN 0 THEN 1073741824 WHEN 1 THEN -2147483648 WHEN 2 THEN 805306368 WHEN 3 THEN 33554432 WHEN 4 THEN -1073741824 ELSE 0 END"
VISITS = f"SELECT {STORE}, event_id AS id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id - event_id % 5 END AS url, CASE WHEN event_id % 17 = 0 THEN 0 ELSE {WEBKIT} END AS visit_time, CASE WHEN event_id % 2 = 0 THEN event_id - 1 END AS from_visit, event_id % 12 + {FLAGS} AS transition, CASE WHEN event_id % 4 > 0 THEN event_id * 10 END AS visit_duration FROM {{events}}"
_CORE = "CASE ((v.transition & 255)) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate("link typed auto_bookmark auto_subframe manual_subframe generated auto_toplevel form_submit reload keyword keyword_generated".split())) + " ELSE 'unknown' END"
case(
    "chromium_visits", {"urls": URLS, "visits": VISITS}, "visits v JOIN urls u ON u.id = v.url AND u.store = v.store WHERE v.visit_time > 0", "Chromium", "History", ns_of_webkit("visit_time"),
    "CASE WHEN coalesce(title, '') = '' THEN u.url ELSE title END", url="u.url", title="coalesce(title, '')", transition=_CORE, is_redirect="(v.transition & 3221225472) <> 0", chain_start="(v.transition & 268435456) <> 0", chain_end="(v.transition & 536870912) <> 0",
    from_address_bar="(v.transition & 33554432) <> 0", visit_duration_us="coalesce(visit_duration, 0)", visit_id="v.id", from_visit="coalesce(from_visit, 0)", redirect_kind="CASE WHEN (v.transition & 2147483648) <> 0 THEN 'server' WHEN (v.transition & 1073741824) <> 0 THEN 'client' END",
)

DOWNLOADS = f"SELECT {STORE}, event_id AS id, concat('/home/u', CAST(user_id AS STRING), '/get/', event_type, CAST(event_id AS STRING), '.exe') AS target_path, CASE WHEN event_id % 7 = 0 THEN 0 ELSE {WEBKIT} END AS start_time, event_id * 3 AS total_bytes, event_id % 3 AS state, event_id % 5 AS danger_type FROM {{events}}"
CHAINS = f"SELECT {STORE}, event_id AS id, event_id % 2 AS chain_index, {URL} AS url FROM {{events}} WHERE event_id % 3 > 0"
case(
    "chromium_downloads", {"downloads": DOWNLOADS, "downloads_url_chains": CHAINS}, "downloads d LEFT JOIN downloads_url_chains c ON c.id = d.id AND c.store = d.store AND c.chain_index = 0 WHERE start_time > 0", "Chromium", "Downloads", ns_of_webkit("start_time"),
    "list_last(string_split(target_path, '/')) || ' (' || total_bytes || ' bytes)'", url="coalesce(url, '')", target_path="target_path", total_bytes="total_bytes", state="state", danger_type="danger_type",
)

COOKIES = f"SELECT {STORE}, CASE WHEN event_id % 8 = 0 THEN 0 ELSE {WEBKIT} END AS creation_utc, concat('.h', CAST(user_id AS STRING), '.example') AS host_key, event_type AS name, 'hidden' AS value, '/' AS path, {WEBKIT} + 5 AS expires_utc, event_id % 2 AS is_secure, event_id % 3 AS is_httponly, event_id % 4 - 1 AS samesite, CASE WHEN event_id % 5 = 0 THEN 'https://top.example' ELSE '' END AS top_frame_site_key FROM {{events}}"
_COOKIE = {
    "host": "host_key", "name": "name", "path": "path", "is_secure": "is_secure <> 0", "is_httponly": "is_httponly <> 0", "samesite": "samesite", "expires_utc": "expires_utc", "encrypted_value": "'ENCRYPTED'", "top_frame_site_key": "top_frame_site_key", "partitioned": "top_frame_site_key <> ''",
}
for _name, _store in (("chromium_cookies", "default"), ("extension_cookies", "extension")):
    case(_name, {"cookies": COOKIES}, "cookies WHERE creation_utc > 0", "Chromium", "Cookies", ns_of_webkit("creation_utc"), "host_key || ' — ' || name || ' (path=' || path || ')'", **_COOKIE, cookie_store=f"'{_store}'")

case(
    "chromium_autofill", {"autofill": f"SELECT {STORE}, event_type AS name, concat('v', CAST(user_id AS STRING)) AS value, event_id % 4 AS count, CASE WHEN event_id % 6 = 0 THEN 0 ELSE {SECONDS} END AS date_created, {SECONDS} + 9 AS date_last_used FROM {{events}}"},
    "autofill WHERE date_created > 0", "Chromium", "Autofill", "date_created * 1000000000", "name || ': ' || value", name="name", value="value", count="count", date_last_used="date_last_used",
)
case(
    "chromium_logins", {"logins": f"SELECT {STORE}, {URL} AS origin_url, {SOME} AS action_url, event_type AS username_value, 'hidden' AS password_value, 'r' AS signon_realm, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {WEBKIT} END AS date_created, event_id AS date_last_used, event_id + 1 AS date_password_modified, event_id % 9 AS times_used, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS blacklisted_by_user FROM {{events}}"},
    "logins WHERE date_created > 0 OR blacklisted_by_user = 1", "Chromium", "LoginData", f"CASE WHEN date_created > 0 THEN {ns_of_webkit('date_created')} ELSE 0 END", "origin_url", origin_url="origin_url", action_url="coalesce(action_url, '')", username="username_value", signon_realm="signon_realm",
    date_last_used="date_last_used", date_password_modified="date_password_modified", times_used="times_used", blacklisted_by_user="blacklisted_by_user = 1", password="'ENCRYPTED'",
)
case(
    "chromium_favicons",
    {
        "icon_mapping": f"SELECT {STORE}, CASE WHEN event_id % 10 = 0 THEN '' ELSE {URL} END AS page_url, event_id AS icon_id FROM {{events}}",
        "favicons": f"SELECT {STORE}, event_id AS id, concat({URL}, '.ico') AS url FROM {{events}} WHERE event_id % 4 > 0",
        "favicon_bitmaps": f"SELECT {STORE}, event_id AS icon_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {WEBKIT} END AS last_updated, event_id % 5 AS width FROM {{events}} WHERE event_id % 7 > 0",
    },
    "icon_mapping m JOIN favicons f ON f.id = m.icon_id AND f.store = m.store JOIN favicon_bitmaps b ON b.icon_id = m.icon_id AND b.store = m.store WHERE page_url <> ''", "Chromium", "Favicon", f"CASE WHEN last_updated > 0 THEN {ns_of_webkit('last_updated')} ELSE 0 END", "page_url || ' — favicon'",
    url="page_url", page_url="page_url", icon_url="f.url", width="width", last_updated="last_updated",
)
case(
    "chromium_top_sites", {"top_sites": f"SELECT {STORE}, CASE WHEN event_id % 10 = 0 THEN '' ELSE {URL} END AS url, event_id % 20 AS url_rank, {SOME} AS title FROM {{events}}"}, "top_sites WHERE url <> ''", "Chromium", "TopSite", "0",
    "CASE WHEN coalesce(title, '') = '' THEN url ELSE title END || ' (top-site rank ' || url_rank || ')'", url="url", title="coalesce(title, '')", url_rank="url_rank",
)
case(
    "chromium_shortcuts", {"omni_box_shortcuts": f"SELECT {STORE}, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS text, 'f' AS fill_into_edit, {URL} AS url, 'c' AS contents, CASE WHEN event_id % 4 = 0 THEN 0 ELSE {WEBKIT} END AS last_access_time, event_id % 6 AS number_of_hits FROM {{events}}"},
    "omni_box_shortcuts WHERE text <> ''", "Chromium", "Shortcut", f"CASE WHEN last_access_time > 0 THEN {ns_of_webkit('last_access_time')} ELSE 0 END", "'typed “' || text || '” → ' || url", typed_text="text", fill_into_edit="fill_into_edit", url="url", contents="contents", last_access_time="last_access_time", number_of_hits="number_of_hits",
)
case(
    "chromium_predictions", {"network_action_predictor": f"SELECT {STORE}, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS user_text, {URL} AS url, event_id % 6 AS number_of_hits, event_id % 4 AS number_of_misses FROM {{events}}"},
    "network_action_predictor WHERE user_text <> ''", "Chromium", "NetworkPrediction", "0", "'typed “' || user_text || '” → ' || url", typed_text="user_text", url="url", number_of_hits="number_of_hits", number_of_misses="number_of_misses",
)
case(
    "chromium_cards", {"credit_cards": f"SELECT {STORE}, {SOME} AS name_on_card, event_id % 12 + 1 AS expiration_month, 2030 + event_id % 5 AS expiration_year, {WEBKIT} AS date_modified, event_id % 3 AS use_count, event_id AS use_date FROM {{events}}"},
    "credit_cards", "Chromium", "CreditCard", ns_of_webkit("date_modified"), "printf('stored card: %s (exp %02d/%d)', coalesce(name_on_card, ''), expiration_month, expiration_year)", name_on_card="coalesce(name_on_card, '')", expiration_month="expiration_month", expiration_year="expiration_year", use_count="use_count", use_date="use_date", card_type="'local'", card_number="'ENCRYPTED'",
)
case(
    "chromium_server_cards", {"masked_credit_cards": f"SELECT {STORE}, {SOME} AS name_on_card, 'visa' AS network, CAST(1000 + event_id % 9000 AS STRING) AS last_four, event_id % 12 + 1 AS exp_month, 2031 AS exp_year, CASE WHEN event_id % 2 = 0 THEN 'bank' END AS bank_name FROM {{events}}"},
    "masked_credit_cards", "Chromium", "CreditCard", "0", "'server card: ' || network || ' ****' || last_four || ' (' || coalesce(name_on_card, '') || ')'", name_on_card="coalesce(name_on_card, '')", network="network", last_four="last_four", expiration_month="exp_month", expiration_year="exp_year",
    bank_name="coalesce(bank_name, '')", card_type="'masked_server'",
)
case("chromium_tokens", {"token_service": f"SELECT {STORE}, CASE WHEN event_id % 5 > 0 THEN concat('s', CAST(event_id AS STRING)) END AS service FROM {{events}}"}, "token_service WHERE service IS NOT NULL", "Chromium", "AuthToken", "0", "'auth token for service: ' || service", service="service", token="'ENCRYPTED'")
_GUID = "concat('g', CAST(event_id AS STRING)) AS guid"
case(
    "chromium_profiles",
    {
        "autofill_profiles": f"SELECT {STORE}, {_GUID}, {WEBKIT} AS date_modified, event_id % 3 AS use_count, event_id AS use_date FROM {{events}}",
        "autofill_profile_names": f"SELECT {STORE}, {_GUID}, event_type AS first_name, {SOME} AS middle_name, concat('u', CAST(user_id AS STRING)) AS last_name FROM {{events}} WHERE event_id % 4 > 0",
        "autofill_profile_emails": f"SELECT {STORE}, {_GUID}, concat('u', CAST(user_id AS STRING), '@x.example') AS email FROM {{events}} WHERE event_id % 5 > 0",
        "autofill_profile_phones": f"SELECT {STORE}, {_GUID}, concat('+', CAST(event_id AS STRING)) AS number FROM {{events}} WHERE event_id % 6 > 0",
    },
    "(SELECT p.*, coalesce(concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), nullif(last_name, '')), '') AS full_name, coalesce(email, '') AS email, coalesce(number, '') AS phone FROM autofill_profiles p LEFT JOIN autofill_profile_names USING (store, guid) LEFT JOIN autofill_profile_emails USING (store, guid) LEFT JOIN autofill_profile_phones USING (store, guid))",
    "Chromium", "Autofill", ns_of_webkit("date_modified"), "'autofill profile: ' || full_name || ' <' || email || '> ' || phone", guid="guid", full_name="full_name", email="email", phone="phone", use_count="use_count", use_date="use_date",
)
_SITE = f"SELECT {STORE}, CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('h', CAST(user_id AS STRING), '.example') END"
case(
    "chromium_media",
    {
        "playbackSession": f"SELECT {STORE}, CASE WHEN event_id % 9 = 0 THEN '' ELSE {URL} END AS url, event_id AS duration_ms, CASE WHEN event_id % 2 = 0 THEN 5 END AS position_ms, {SOME} AS title, {SOME} AS source_title, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 13350000000 + event_id END AS last_updated_time_s FROM {{events}}",
    },
    "playbackSession WHERE url <> ''", "Chromium", "MediaPlayback", "CASE WHEN last_updated_time_s > 0 THEN (last_updated_time_s - 11644473600) * 1000000000 ELSE 0 END",
    "CASE WHEN coalesce(title, '') = '' THEN url ELSE title || ' — ' || url END || ' (position ' || coalesce(position_ms, 0) || 'ms / ' || duration_ms || 'ms)'", url="url", media_kind="'session'", title="coalesce(title, '')", source_title="coalesce(source_title, '')", duration_ms="duration_ms",
    position_ms="coalesce(position_ms, 0)", last_updated_time_s="last_updated_time_s",
)
case(
    "chromium_reporting", {"nel_policies": f"{_SITE} AS origin_host, event_type AS group_name, CASE WHEN event_id % 4 = 0 THEN 0 ELSE {WEBKIT} END AS last_access_us_since_epoch FROM {{events}}"}, "nel_policies WHERE origin_host <> ''", "Chromium", "RecoveredDomain",
    f"CASE WHEN last_access_us_since_epoch > 0 THEN {ns_of_webkit('last_access_us_since_epoch')} ELSE 0 END", "'NEL policy ' || origin_host", host="origin_host", group_name="group_name", source_artifact="'nel'",
)

PLACES = f"SELECT {STORE}, event_id AS id, {URL} AS url, {SOME} AS title, event_id % 9 AS visit_count, CASE WHEN event_id % 11 > 0 THEN {UNIX} END AS last_visit_date FROM {{events}}"
_PLACE = "JOIN moz_places p ON p.store = x.store AND p.id = x."
case(
    "firefox_history", {"moz_places": PLACES}, "moz_places WHERE last_visit_date IS NOT NULL", "Firefox", "History", "last_visit_date * 1000", "CASE WHEN coalesce(title, '') = '' THEN url ELSE '[' || visit_count || ' visits] ' || title || ' — ' || url END", url="url", title="coalesce(title, '')", visit_count="visit_count",
)
_TYPES = "CASE visit_type " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate("link typed bookmark embed redirect_permanent redirect_temporary download framed_link reload".split(), 1)) + " ELSE 'unknown' END"
case(
    "firefox_visits", {"moz_historyvisits": f"SELECT {STORE}, event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id - 1 END AS from_visit, event_id - event_id % 5 AS place_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE {UNIX} END AS visit_date, event_id % 11 AS visit_type, event_id % 4 AS session FROM {{events}}", "moz_places": PLACES},
    f"moz_historyvisits x {_PLACE}place_id WHERE visit_date > 0", "Firefox", "History", "visit_date * 1000", "CASE WHEN coalesce(title, '') = '' THEN url ELSE title END", url="url", title="coalesce(title, '')", visit_id="x.id", from_visit="coalesce(from_visit, 0)", transition=_TYPES, is_redirect="visit_type IN (5, 6)",
    redirect_kind="CASE WHEN visit_type IN (5, 6) THEN 'server' END", session="nullif(session, 0)",
)
case(
    "firefox_cookies", {"moz_cookies": f"SELECT {STORE}, concat('.h', CAST(user_id AS STRING), '.example') AS host, event_type AS name, '/' AS path, CASE WHEN event_id % 8 = 0 THEN 0 ELSE {UNIX} END AS creationTime, event_id AS expiry, event_id % 2 AS isSecure, event_id % 3 AS isHttpOnly, event_id % 4 AS sameSite FROM {{events}}"},
    "moz_cookies WHERE creationTime > 0", "Firefox", "Cookies", "creationTime * 1000", "host || ' — ' || name", host="host", name="name", path="path", expiry="expiry", is_secure="isSecure <> 0", is_httponly="isHttpOnly <> 0", samesite="sameSite",
)
case(
    "firefox_bookmarks", {"moz_bookmarks": f"SELECT {STORE}, event_id % 3 AS type, event_id AS fk, {SOME} AS title, CASE WHEN event_id % 7 = 0 THEN 0 ELSE {UNIX} END AS dateAdded FROM {{events}}", "moz_places": PLACES},
    f"moz_bookmarks x {_PLACE}fk WHERE type = 1 AND dateAdded > 0", "Firefox", "Bookmarks", "dateAdded * 1000", "coalesce(x.title, '')", url="url", title="coalesce(x.title, '')",
)
case(
    "firefox_autofill", {"moz_formhistory": f"SELECT {STORE}, event_type AS fieldname, concat('v', CAST(event_id AS STRING)) AS value, event_id % 5 AS timesUsed, CASE WHEN event_id % 7 = 0 THEN 0 ELSE {UNIX} END AS firstUsed, {UNIX} + 3 AS lastUsed FROM {{events}}"},
    "moz_formhistory WHERE firstUsed > 0", "Firefox", "Autofill", "firstUsed * 1000", "fieldname || ': ' || value", name="fieldname", value="value", count="timesUsed", last_used="lastUsed",
)
ANNOS = f"SELECT {STORE}, event_id AS place_id, event_id % 3 AS anno_attribute_id, concat('file:///get/', CAST(event_id AS STRING)) AS content, {UNIX} AS dateAdded FROM {{events}} WHERE event_id % 2 = 0"
NAMES = f"SELECT {STORE}, event_id % 3 AS id, CASE WHEN event_id % 3 = 1 THEN 'downloads/destinationFileURI' ELSE concat('kind', CAST(event_id % 3 AS STRING)) END AS name FROM {{events}} WHERE event_id % 2500 IN (0, 1)"
_ANNO = {"moz_annos": ANNOS, "moz_anno_attributes": NAMES, "moz_places": PLACES}
_ANNO_ROWS = f"moz_annos x {_PLACE}place_id JOIN moz_anno_attributes n ON n.store = x.store AND n.id = x.anno_attribute_id"
case("firefox_annotations", _ANNO, _ANNO_ROWS, "Firefox", "Annotation", "dateAdded * 1000", "name || ' — ' || url", url="url", name="name", value="content")
case("firefox_downloads", _ANNO, _ANNO_ROWS + " WHERE name = 'downloads/destinationFileURI'", "Firefox", "Downloads", "dateAdded * 1000", "content", url="url", target_path="content")
case(
    "firefox_typed", {"moz_inputhistory": f"SELECT {STORE}, event_id AS place_id, event_type AS input, (event_id % 8) + 0.5E0 AS use_count FROM {{events}} WHERE event_id % 3 = 0", "moz_places": PLACES}, f"moz_inputhistory x {_PLACE}place_id", "Firefox", "TypedInput", "0", "'typed “' || input || '” → ' || url", url="url", typed_text="input", use_count="use_count",
)
_SETTING = "CASE permission WHEN 1 THEN 'allow' WHEN 2 THEN 'deny' WHEN 3 THEN 'prompt' ELSE 'unknown' END"
case(
    "firefox_permissions", {"moz_perms": f"SELECT {STORE}, {URL} AS origin, event_type AS type, event_id % 5 AS permission, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {SECONDS} * 1000 END AS modificationTime FROM {{events}}"}, "moz_perms", "Firefox", "Permission", "CASE WHEN modificationTime > 0 THEN modificationTime * 1000000 ELSE 0 END",
    f"origin || ' ' || type || '=' || {_SETTING}", origin="origin", permission="type", setting=_SETTING,
)
case(
    "firefox_local_storage", {"webappsstore2": f"SELECT {STORE}, concat('elpmaxe.', CAST(user_id AS STRING), '.:https:443') AS scope, event_type AS key, CAST(event_id AS STRING) AS value FROM {{events}}"}, "webappsstore2", "Firefox", "LocalStorage", "0",
    "ltrim(reverse(string_split(scope, ':')[1]), '.') || ' ' || key", host="ltrim(reverse(string_split(scope, ':')[1]), '.')", key="key", value="value",
)
case(
    "safari_history",
    {"history_items": f"SELECT {STORE}, event_id AS id, {URL} AS url, event_id % 9 AS visit_count FROM {{events}}", "history_visits": f"SELECT {STORE}, event_id AS id, event_id - event_id % 4 AS history_item, CASE WHEN event_id % 7 = 0 THEN -1.5E0 ELSE CAST({APPLE} AS DOUBLE) END AS visit_time FROM {{events}}"},
    "history_visits v JOIN history_items i ON i.id = v.history_item AND i.store = v.store WHERE visit_time > 0", "Safari", "History", "(CAST(trunc(visit_time) AS BIGINT) + 978307200) * 1000000000", "url", url="url", visit_count="visit_count",
)
case(
    "safari_cookies", {"cookies": f"SELECT {STORE}, event_type AS name, 'hidden' AS value, concat('h', CAST(user_id AS STRING), '.example') AS domain, '/' AS path, CASE WHEN event_id % 7 = 0 THEN 0E0 ELSE CAST({APPLE} AS DOUBLE) END AS creation, (event_id % 50) + 0.5E0 AS expiry, event_id % 2 AS is_secure, event_id % 3 AS is_httponly FROM {{events}}"},
    "cookies WHERE creation > 0", "Safari", "Cookies", "(CAST(trunc(creation) AS BIGINT) + 978307200) * 1000000000", "domain || ' — ' || name", host="domain", name="name", path="path", expiry="expiry", is_secure="is_secure <> 0", is_httponly="is_httponly <> 0",
)


def file_case(name: str, reader: Callable[[DataFrame], DataFrame], tables: dict[str, str], content: str, rows: str, browser: str, artifact: str, ns: str, description: str, /, located: str = "concat('profile/', store)", more: str | None = None, **attrs: str) -> None:
    """Registers a reader of other files: ``content`` is the Spark expression of a file's bytes from the first table, whose
    rows of one store come as the array ``r``; ``more`` is further DuckDB SQL of expected events."""
    first = next(iter(tables.values()))

    def files(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = evidence.select(spark, sf_dir, first)
        grouped = made.groupBy("store").agg(F.sort_array(F.collect_list(F.struct(*[c for c in made.columns if c != "store"]))).alias("r"))
        return grouped.select(F.expr(located).alias("path"), F.expr(content).alias("content"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("modificationTime"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(reader(files(spark, sf_dir)))

    FILES[name] = files
    QUERIES[f"read_{name}"] = run
    sql = expected(tables, rows, browser, artifact, ns, description, attrs)
    ORACLE_SQL[f"read_{name}"] = sql if more is None else f"{sql} UNION ALL {more}"


def _json(expression: str) -> str:
    return f"CAST(to_json({expression}) AS BINARY)"


file_case(
    "firefox_logins", json_readers.firefox_logins, {"l": f"SELECT {STORE}, {URL} AS hostname, {SOME} AS formSubmitURL, event_type AS usernameField, {SECONDS} * 1000 AS timeCreated, CASE WHEN event_id % 2 = 0 THEN event_id END AS timesUsed, event_id AS timeLastUsed, event_id + 1 AS timePasswordChanged FROM {{events}}"},
    _json("named_struct('nextId', 1, 'logins', r)"), "l", "Firefox", "LoginData", "timeCreated * 1000000", "hostname", hostname="hostname", form_submit_url="coalesce(formSubmitURL, '')", username_field="usernameField", times_used="coalesce(timesUsed, 0)", time_last_used="timeLastUsed",
    time_password_changed="timePasswordChanged", password="'ENCRYPTED'",
)
file_case(
    "firefox_extensions", json_readers.firefox_extensions, {"l": f"SELECT {STORE}, concat('{{', CAST(event_id AS STRING), '}}') AS id, concat(CAST(event_id % 7 AS STRING), '.0') AS version, event_type AS name, CASE WHEN event_id % 3 > 0 THEN {SECONDS} * 1000 END AS installDate FROM {{events}}".replace("'{'", "'('").replace("'}'", "')'")},
    _json("named_struct('addons', transform(r, x -> named_struct('id', x.id, 'version', x.version, 'defaultLocale', named_struct('name', x.name), 'installDate', x.installDate)))"), "l", "Firefox", "Extensions", "coalesce(installDate, 0) * 1000000", "name || ' v' || version",
    id="id", name="name", version="version",
)
file_case(
    "firefox_session", json_readers.firefox_session, {"l": f"SELECT {STORE}, {SECONDS} * 1000 AS seen, {URL} AS url, {SOME} AS title FROM {{events}}"},
    _json("named_struct('windows', array(named_struct('tabs', transform(r, x -> named_struct('lastAccessed', x.seen, 'entries', array(named_struct('url', 'about:home', 'title', 'old'), named_struct('url', x.url, 'title', x.title)))))))"), "l", "Firefox", "Session", "seen * 1000000",
    "CASE WHEN coalesce(title, '') = '' THEN url ELSE title END", url="url", title="coalesce(title, '')",
)
file_case(
    "chromium_extensions", json_readers.chromium_extensions,
    {"l": "SELECT concat('x', CAST(event_id % 700 AS STRING), '/', CAST(100 + floor(event_id / 700) AS STRING)) AS store, concat('x', CAST(event_id % 700 AS STRING)) AS id, event_id, event_type AS name, concat('1.', CAST(event_id AS STRING)) AS version, concat('about ', event_type) AS description FROM {events}"},
    _json("element_at(r, 1)"), "(SELECT id, max_by(name, event_id) AS name, max_by(version, event_id) AS version, max_by(description, event_id) AS description FROM l GROUP BY id)", "Chromium", "Extensions", "1700000000000000000", "name || ' v' || version",
    located="concat('u/Extensions/', store, '/manifest.json')", name="name", version="version", id="id", description="description",
)
file_case(
    "chromium_preferences", json_readers.preferences, {"l": f"SELECT event_id AS store, {URL} AS homepage, event_id % 5 AS restore, {WEBKIT} AS created, event_type AS name FROM {{events}}"},
    _json("named_struct('homepage', r[0].homepage, 'homepage_is_newtabpage', r[0].restore = 0, 'session', named_struct('restore_on_startup', r[0].restore, 'startup_urls', array(r[0].homepage)), 'profile', named_struct('name', r[0].name, 'creation_time', cast(r[0].created as string)), 'account_info', array(named_struct('email', r[0].name, 'gaia', '7')))"),
    "(SELECT store, unnest([{'k': 'homepage', 'v': homepage}, {'k': 'homepage_is_newtabpage', 'v': CAST(restore = 0 AS VARCHAR)}, {'k': 'session.restore_on_startup', 'v': CAST(restore AS VARCHAR)}, {'k': 'profile.name', 'v': name}, {'k': 'profile.creation_time', 'v': CAST(created AS VARCHAR)}, {'k': 'session.startup_urls', 'v': homepage}]) AS p, created FROM l)",
    "Chromium", "Preferences", f"CASE WHEN p.k = 'profile.creation_time' THEN {ns_of_webkit('created')} ELSE 0 END", "p.k || ' = ' || p.v", key="p.k", value="p.v",
    more="SELECT 0, 'Chromium', 'Preferences', 'account_info = ' || name || ' () gaia=7', 'email=' || name || '; full_name=; gaia=7; key=account_info' FROM l",
)
_NOTE = f"'{json_readers.CONTACTED}'"
file_case(
    "chromium_network_state", json_readers.network_state, {"l": f"SELECT {STORE}, event_id AS i, {URL} AS server, event_id % 2 = 0 AS spdy, {SECONDS} AS until, event_type AS host FROM {{events}}"},
    _json("named_struct('net', named_struct('http_server_properties', named_struct('servers', transform(r, x -> named_struct('server', x.server, 'supports_spdy', x.spdy, 'alternative_service', array(named_struct('protocol_str', 'h3')))), 'broken_alternative_services', transform(r, x -> named_struct('host', x.host, 'protocol_str', 'quic', 'broken_until', cast(x.until as string), 'broken_count', x.i)))))"),
    "(SELECT *, regexp_extract(server, '//([^/]*)', 1) AS domain FROM l)", "Chromium", "RecoveredDomain", "0", "domain || ' — contacted (HTTP server properties)'", domain="domain", origin="server", source_artifact="'Network Persistent State'", supports_spdy="spdy", alt_protocols="'[\"h3\"]'", recovery_note=_NOTE,
    more=f"SELECT until * 1000000000, 'Chromium', 'RecoveredDomain', host || ' — contacted (broken alt-svc quic)', 'alt_svc_broken=true; broken_count=' || i || '; domain=' || host || '; protocol=quic; recovery_note=' || {_NOTE} || '; source_artifact=Network Persistent State' FROM l",
)
file_case(
    "chromium_bookmarks", readers.chromium_bookmarks, {"l": f"SELECT {STORE}, {SOME} AS name, {URL} AS url, CASE WHEN event_id % 4 = 0 THEN 0 ELSE {WEBKIT} END AS added FROM {{events}}"},
    _json("named_struct('roots', named_struct('bar', named_struct('type', 'folder', 'name', 'Bar', 'children', array(named_struct('type', 'folder', 'name', 'In', 'children', transform(r, x -> named_struct('type', 'url', 'name', coalesce(x.name, ''), 'url', x.url, 'date_added', cast(x.added as string))))))))"),
    "l", "Chromium", "Bookmarks", f"CASE WHEN added > 0 THEN {ns_of_webkit('added')} ELSE 0 END", "CASE WHEN coalesce(name, '') = '' THEN url ELSE name END", url="url", title="coalesce(name, '')", folder="'/Bar/In'",
)
file_case(
    "chromium_permissions", json_readers.permissions, {"l": f"SELECT {STORE}, {URL} AS origin, event_id % 7 AS setting, CASE WHEN event_id % 4 = 0 THEN 0 ELSE {WEBKIT} END AS modified FROM {{events}}"},
    _json("named_struct('profile', named_struct('content_settings', named_struct('exceptions', named_struct('geolocation', map_from_entries(transform(r, x -> struct(x.origin, named_struct('setting', x.setting, 'last_modified', cast(x.modified as string)))))))))"),
    "(SELECT *, ['default', 'allow', 'block', 'ask', 'session_only', 'detect_important_content', 'unknown'][setting + 1] AS label FROM l)", "Chromium", "Permission", f"CASE WHEN modified > 0 THEN {ns_of_webkit('modified')} ELSE 0 END", "'geolocation ' || label || ' for ' || origin",
    origin="origin", permission="'geolocation'", setting="label",
)
file_case(
    "chromium_local_state", json_readers.profiles, {"l": f"SELECT {STORE}, concat('Profile ', CAST(event_id AS STRING)) AS folder, event_type AS name, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'me@x.example' END AS mail, {SECONDS} AS active FROM {{events}}"},
    _json("named_struct('profile', named_struct('info_cache', map_from_entries(transform(r, x -> struct(x.folder, named_struct('name', x.name, 'user_name', x.mail, 'active_time', x.active))))))"),
    "l", "Chromium", "Session", "active * 1000000000", "'Profile ' || folder || ': ' || name || CASE WHEN mail = '' THEN '' ELSE ' (' || mail || ')' END", profile_dir="folder", profile_name="name", user_name="mail", active_time="substr(CAST(active AS VARCHAR), 1, 1) || '.' || rtrim(substr(CAST(active AS VARCHAR), 2), '0') || 'E9'",
)
file_case(
    "chromium_transport_security", json_readers.transport_security, {"l": f"SELECT {STORE}, concat('hash', CAST(event_id AS STRING)) AS host, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {SECONDS} END AS seen FROM {{events}}"},
    _json("named_struct('version', 2, 'sts', transform(r, x -> named_struct('host', x.host, 'sts_observed', x.seen)))"), "l", "Chromium", "RecoveredDomain", "seen * 1000000000", "'HSTS entry (hashed host)'", host_hash="host", enumerable="false", source_artifact="'transport_security'",
)
_PLIST = "CAST(concat('<?xml version=\"1.0\"?><plist version=\"1.0\">', {}, '</plist>') AS BINARY)"
file_case(
    "safari_top_sites", binary.safari_top_sites, {"l": f"SELECT {STORE}, CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('https://h', CAST(event_id AS STRING), '.example/') END AS url, coalesce({SOME}, '') AS title FROM {{events}}"},
    _PLIST.format("concat('<dict><key>TopSites</key><array>', array_join(transform(r, x -> concat('<dict><key>TopSiteURLString</key><string>', x.url, '</string><key>TopSiteTitle</key><string>', x.title, '</string></dict>')), ''), '</array></dict>')"),
    "l WHERE url <> ''", "Safari", "History", "0", "CASE WHEN title = '' THEN url ELSE title || ' -- ' || url END", url="url", title="title", source_type="'topsites'",
)
file_case(
    "safari_downloads", binary.safari_downloads, {"l": f"SELECT {STORE}, concat('https://h', CAST(event_id AS STRING), '.example/') AS url, concat('/Users/a/', event_type, CAST(event_id AS STRING)) AS path, event_id + 700000000 AS added, event_id AS total FROM {{events}}"},
    _PLIST.format("concat('<dict><key>DownloadHistory</key><array>', array_join(transform(r, x -> concat('<dict><key>DownloadEntryURL</key><string>', x.url, '</string><key>DownloadEntryPath</key><string>', x.path, '</string><key>DownloadEntryDateAddedKey</key><real>', x.added, '.5</real><key>DownloadEntryProgressTotalToLoad</key><integer>', x.total, '</integer></dict>')), ''), '</array></dict>')"),
    "l", "Safari", "Downloads", "(added + 978307200) * 1000000000", "list_last(string_split(path, '/')) || ' from ' || url", url="url", path="path", total_bytes="total",
)
file_case(
    "safari_extensions", binary.safari_extensions, {"l": f"SELECT {STORE}, concat(event_type, CAST(event_id AS STRING)) AS name, event_id % 2 = 0 AS yes FROM {{events}}"},
    _PLIST.format("concat('<dict><key>Installed Extensions</key><array>', array_join(transform(r, x -> concat('<dict><key>Bundle Directory Name</key><string>', x.name, '</string><key>Enabled</key>', if(x.yes, '<true/>', '<false/>'), '</dict>')), ''), '</array></dict>')"),
    "l", "Safari", "Extensions", "0", "name", bundle_name="name", enabled="yes",
)
file_case(
    "safari_bookmarks", binary.safari_bookmarks, {"l": f"SELECT {STORE}, concat('https://h', CAST(event_id AS STRING), '.example/') AS url, event_type AS title FROM {{events}}"},
    _PLIST.format("concat('<dict><key>WebBookmarkType</key><string>WebBookmarkTypeList</string><key>Children</key><array><dict><key>WebBookmarkType</key><string>WebBookmarkTypeList</string><key>Children</key><array>', array_join(transform(r, x -> concat('<dict><key>WebBookmarkType</key><string>WebBookmarkTypeLeaf</string><key>URLString</key><string>', x.url, '</string><key>URIDictionary</key><dict><key>title</key><string>', x.title, '</string></dict></dict>')), ''), '</array></dict></array></dict>')"),
    "l", "Safari", "Bookmarks", "0", "title", url="url", title="title",
)
_BOUNCE = f"{_SITE} AS site, CASE WHEN event_id % 2 = 0 THEN {WEBKIT} END AS first_site_storage_time, CASE WHEN event_id % 3 = 0 THEN {WEBKIT} + 7 END AS last_user_interaction_time, event_id AS other FROM {{events}}"


STORES["chromium_bounces"] = {"bounces": _BOUNCE}


def read_chromium_bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(readers.chromium_bounces(evidence.sqlite_stores({"bounces": evidence.select(spark, sf_dir, _BOUNCE)})))


QUERIES["read_chromium_bounces"] = read_chromium_bounces
_TIMES = "concat_ws(',', '\"first_site_storage_time\":\"' || first_site_storage_time || '\"', '\"last_user_interaction_time\":\"' || last_user_interaction_time || '\"')"
ORACLE_SQL["read_chromium_bounces"] = (
    f"WITH b AS ({evidence.duckdb(_BOUNCE)}), w AS (SELECT *, coalesce(last_user_interaction_time, first_site_storage_time, 0) AS t FROM b WHERE site <> '') "
    f"SELECT CAST(CASE WHEN t > 0 THEN {ns_of_webkit('t')} ELSE 0 END AS BIGINT) AS timestamp_ns, 'Chromium' AS browser, 'RecoveredDomain' AS artifact, 'site state ' || site AS description, 'host=' || site || '; source_artifact=bounces; times={{' || {_TIMES} || '}}' AS attrs FROM w"
)


def line_case(name: str, reader: Callable[[SparkSession, str], DataFrame], line: str, rows: str, browser: str, artifact: str, ns: str, description: str, /, **attrs: str) -> None:
    """Registers a reader of text files: ``line`` is SQL of one column, whose rows are written as lines."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "lines")
        evidence.select(spark, sf_dir, line).write.text(path)
        return shown(reader(spark, path))

    def files(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a file every 2,500 lines of a task: larger tables make more files, as in the other cases
        made = evidence.select(spark, sf_dir, line).groupBy(F.floor(F.monotonically_increasing_id() / 2500).alias("store")).agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
        return made.select(F.concat(F.lit("profile/"), F.col("store").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("modificationTime"))

    FILES[name] = files
    QUERIES[f"read_{name}"] = run
    ORACLE_SQL[f"read_{name}"] = expected({"l": line}, rows, browser, artifact, ns, description, attrs)


line_case(
    "firefox_preferences", readers.firefox_preferences, "SELECT CASE WHEN event_id % 5 = 0 THEN '// a comment' WHEN event_id % 2 = 0 THEN concat('user_pref(\"k.', CAST(event_id AS STRING), '\", ', CAST(user_id AS STRING), ');') ELSE concat('user_pref(\"s.', CAST(event_id AS STRING), '\", \"', event_type, '\");') END AS line FROM {events}",
    "(SELECT string_split(line, '\"')[2] AS name, regexp_extract(line, ', (.*)\\);$', 1) AS setting FROM l WHERE line LIKE 'user_pref%')", "Firefox", "Preferences", "0", "name || ' = ' || setting", name="name", value="trim(setting, '\"')",
)
line_case(
    "firefox_site_security", readers.firefox_site_security,
    "SELECT concat('h', CAST(event_id AS STRING), '.example', CASE WHEN event_id % 3 = 0 THEN '^partitionKey=x' ELSE '' END, CASE WHEN event_id % 4 = 0 THEN ':HPKP' ELSE ':HSTS' END, chr(9), '0', chr(9), CAST(19000 + user_id AS STRING), chr(9), CAST(1700000000000 + event_id AS STRING), ',1,0') AS line FROM {events}",
    "(SELECT regexp_extract(line, '^[^^:]*', 0) AS host, CAST(string_split(line, chr(9))[3] AS BIGINT) AS days, string_split(string_split(line, chr(9))[4], ',')[1] AS expiry FROM l WHERE line LIKE '%:HSTS%')", "Firefox", "RecoveredDomain", "days * 86400 * 1000000000", "'HSTS ' || host", host="host", expiry_ms="expiry",
    source_artifact="'site_security'",
)


def read_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.discover_profiles(evidence.select(spark, sf_dir, PATHS))


#: Files of many homes, some of them markers of a browser.
PATHS = (
    "SELECT concat('/mnt/', CASE WHEN event_id % 2 = 0 THEN 'Users' ELSE 'home' END, '/u', CAST(user_id AS STRING), '/app/Profile ', CAST(event_id % 3 AS STRING), '/', CASE event_id % 6 WHEN 0 THEN 'History' WHEN 1 THEN 'places.sqlite' WHEN 2 THEN 'History.db' WHEN 3 THEN 'Cookies' WHEN 4 THEN 'WebCacheV01.dat' ELSE 'notes.txt' END) AS path FROM {events}"
)
QUERIES["read_discovery"] = read_discovery
ORACLE_SQL["read_discovery"] = (
    f"WITH f AS ({evidence.duckdb(PATHS)}), n AS (SELECT list_last(string_split(path, '/')) AS name, regexp_replace(path, '/[^/]+$', '') AS folder FROM f) "
    "SELECT DISTINCT CASE WHEN name = 'places.sqlite' THEN 'Firefox' WHEN name = 'History.db' THEN 'Safari' WHEN name IN ('History', 'Cookies') THEN 'Chromium' ELSE 'InternetExplorer' END AS browser, list_last(string_split(folder, '/')) AS profile, folder AS path, string_split(folder, '/')[4] AS \"user\" "
    "FROM n WHERE name <> 'notes.txt'"
)


_WEB = f"SELECT {STORE}, event_id, user_id % 40 AS site, event_type, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS gone FROM {{events}}"
_ORIGIN = "concat('https://h', CAST(site AS STRING), '.example')"


def _local_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of changing length and encoding, deleted ones, times of origins that change, and records of other shapes."""
    web = evidence.select(spark, sf_dir, _WEB)
    number = F.col("event_id")
    value = F.concat(F.unhex(F.lit("01")), F.repeat(F.col("event_type"), (number % 50 + 1).cast("int")).cast("binary"))
    data = web.select("store", number.alias("seq"), F.concat(F.lit("_").cast("binary"), F.expr(_ORIGIN).cast("binary"), F.unhex(F.lit("0001")), F.concat(F.lit("k"), number.cast("string")).cast("binary")).alias("key"), F.when(F.col("gone") == 0, value).alias("value"))
    # field 1, seven bits a byte: 24 * 2^49, plus the event's number in the 49 bits below
    low = lambda n: F.hex((F.shiftright(number, 7 * n).bitwiseAND(127) + 128).cast("long"))
    times = web.where("event_id % 3 = 0").select("store", (number + 1_000_000).alias("seq"), F.concat(F.lit("META:").cast("binary"), F.expr(_ORIGIN).cast("binary")).alias("key"), F.unhex(F.concat(F.lit("08"), *[low(n) for n in range(7)], F.lit("18"))).alias("value"))
    other = web.where("event_id % 100 = 1").select("store", (number + 2_000_000).alias("seq"), F.lit("VERSION").cast("binary").alias("key"), F.lit("1").cast("binary").alias("value"))
    return evidence.leveldb_logs(data.unionByName(times).unionByName(other))


def read_chromium_local_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(leveldb.local_storage(_local_storage(spark, sf_dir)))


FILES["chromium_local_storage"] = _local_storage
QUERIES["read_chromium_local_storage"] = read_chromium_local_storage
ORACLE_SQL["read_chromium_local_storage"] = (
    f"WITH w AS ({evidence.duckdb(_WEB)}), m AS (SELECT store, site, max(event_id) AS meta FROM w WHERE event_id % 3 = 0 GROUP BY 1, 2), d AS (SELECT w.*, meta, 'https://h' || site || '.example' AS origin, CASE WHEN gone = 1 THEN '' ELSE repeat(event_type, CAST(event_id % 50 + 1 AS INT)) END AS v FROM w LEFT JOIN m USING (store, site)) "
    f"SELECT CASE WHEN meta IS NULL THEN CAST(0 AS BIGINT) ELSE {ns_of_webkit('(meta + 13510798882111488)')} END AS timestamp_ns, 'Chromium' AS browser, 'LocalStorage' AS artifact, origin || ' — k' || event_id || ' = ' || v AS description, 'deleted=' || (gone = 1) || '; key=k' || event_id || '; origin=' || origin || '; record=data; seq=' || event_id || '; storage_type=local_storage; value=' || v AS attrs FROM d "
    "UNION ALL SELECT 0, 'Chromium', 'LocalStorage', 'unrecognized local_storage record (key 7 bytes)', 'deleted=false; key_hex=56455253494f4e; record=other; seq=' || (event_id + 2000000) || '; storage_type=local_storage' FROM w WHERE event_id % 100 = 1"
)


def _session_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = evidence.select(spark, sf_dir, _WEB)
    number = F.col("event_id")
    data = web.select("store", number.alias("seq"), F.concat(F.lit("map-"), F.col("site").cast("string"), F.lit("-k"), number.cast("string")).cast("binary").alias("key"), F.when(F.col("gone") == 0, F.encode(F.concat(F.col("event_type"), F.lit("é")), "UTF-16LE")).alias("value"))
    owners = web.where("event_id % 50 = 7").select("store", (number + 1_000_000).alias("seq"), F.concat(F.lit("namespace-a_b-h"), number.cast("string"), F.lit(".example")).cast("binary").alias("key"), F.col("site").cast("string").cast("binary").alias("value"))
    return evidence.leveldb_logs(data.unionByName(owners))


def read_chromium_session_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(leveldb.session_storage(_session_storage(spark, sf_dir)))


FILES["chromium_session_storage"] = _session_storage
QUERIES["read_chromium_session_storage"] = read_chromium_session_storage
ORACLE_SQL["read_chromium_session_storage"] = (
    f"WITH w AS ({evidence.duckdb(_WEB)}), o AS (SELECT store, site, 'h' || max(event_id) || '.example' AS host FROM w WHERE event_id % 50 = 7 GROUP BY 1, 2), d AS (SELECT w.*, host, CASE WHEN gone = 1 THEN '' ELSE event_type || 'é' END AS v FROM w LEFT JOIN o USING (store, site)) "
    "SELECT CAST(0 AS BIGINT) AS timestamp_ns, 'Chromium' AS browser, 'LocalStorage' AS artifact, coalesce(host, '<unknown host>') || ' — k' || event_id || ' = ' || v AS description, concat_ws('; ', 'deleted=' || (gone = 1), 'host=' || host, 'key=k' || event_id, 'map_id=' || site, 'record=map', 'seq=' || event_id, 'storage_type=session_storage', 'value=' || v) AS attrs FROM d"
)

file_case(
    "reporting_json", readers.reporting_json, {"l": f"SELECT {STORE}, {URL} AS origin, event_type AS grp, event_id AS i FROM {{events}}"},
    _json("named_struct('net', named_struct('nel', named_struct('policies', transform(r, x -> named_struct('origin', x.origin, 'report_to', x.grp))), 'reporting', named_struct('endpoints', transform(r, x -> named_struct('origin', x.origin, 'url', concat('https://To', cast(x.i as string), '.example/r'), 'group', x.grp)))))"),
    "(SELECT *, regexp_extract(origin, '//([^/]*)', 1) AS host FROM l)", "Chromium", "RecoveredDomain", "0", "'NEL policy ' || host", host="host", group_name="grp", source_artifact="'nel'",
    more="SELECT 0, 'Chromium', 'RecoveredDomain', 'reporting endpoint ' || h, 'group_name=' || grp || '; host=' || h || '; report_to_host=to' || i || '.example; source_artifact=reporting; url=https://To' || i || '.example/r' FROM (SELECT *, regexp_extract(origin, '//([^/]*)', 1) AS h FROM l)",
)
#: Backups of a day each; some bookmarks are in several, some are bookmarks still.
BACKUPS = f"SELECT CAST(event_id % 7 AS BIGINT) AS store, concat('https://b', CAST(user_id % 300 AS STRING), '.example/') AS url, concat('t', CAST(event_id AS STRING)) AS title, {UNIX} AS added, event_id FROM {{events}}"


def _backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile every 17,500 events, with a backup of each day: larger tables make more files, as in the other cases."""
    profile = F.floor(F.col("event_id") / 17_500).cast("string").alias("profile")
    made = evidence.select(spark, sf_dir, BACKUPS).groupBy(profile, "store").agg(F.sort_array(F.collect_list(F.struct("event_id", "url", "title", "added"))).alias("r"))
    tree = F.expr("CAST(to_json(named_struct('children', array(named_struct('title', 'menu', 'children', transform(r, x -> named_struct('uri', x.url, 'title', x.title, 'dateAdded', x.added)))))) AS BINARY)")
    return made.select(F.concat(F.lit("p"), "profile", F.lit("/bookmarkbackups/bookmarks-2024-01-0"), (F.col("store") + 1).cast("string"), F.lit("_9_x.json")).alias("path"), tree.alias("content"))


def read_firefox_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of backups that are none now, newest backup first."""
    current = evidence.select(spark, sf_dir, BACKUPS).where("event_id % 50 = 1").select("url")
    return shown(readers.recovered_bookmarks(readers.firefox_backups(_backups(spark, sf_dir)), current))


QUERIES["read_firefox_backups"] = read_firefox_backups
ORACLE_SQL["read_firefox_backups"] = (
    f"WITH b AS ({evidence.duckdb(BACKUPS)}), n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY store DESC, added DESC) AS k FROM b), o AS (SELECT *, 'bookmarks-2024-01-0' || (store + 1) || '_9_x.json' AS name FROM n WHERE k = 1 AND url NOT IN (SELECT url FROM b WHERE event_id % 50 = 1)) "
    "SELECT CAST(added * 1000 AS BIGINT) AS timestamp_ns, 'Firefox' AS browser, 'RecoveredBookmark' AS artifact, 'bookmark of backup ' || name || ' that is none now: ' || title AS description, 'backup_date=2024-01-0' || (store + 1) || '; source_backup=' || name || '; title=' || title || '; url=' || url AS attrs FROM o"
)

# whole profiles

#: What the stores of each case are called in a profile; the history without visits isn't read there.
NAMES = {
    "chromium_visits": "History", "chromium_downloads": "History", "chromium_cookies": "Network/Cookies", "extension_cookies": "Extension Cookies", "chromium_autofill": "Web Data", "chromium_logins": "Login Data", "chromium_favicons": "Favicons",
    "chromium_top_sites": "Top Sites", "chromium_shortcuts": "Shortcuts", "chromium_predictions": "Network Action Predictor", "chromium_cards": "Web Data", "chromium_server_cards": "Web Data", "chromium_tokens": "Web Data", "chromium_profiles": "Web Data",
    "chromium_media": "Media History", "chromium_reporting": "Network/Reporting and NEL", "chromium_bounces": "DIPS", "chromium_bookmarks": "Bookmarks", "chromium_network_state": "Network/Network Persistent State",
    "chromium_transport_security": "TransportSecurity", "chromium_local_state": "Local State", "firefox_visits": "places.sqlite", "firefox_bookmarks": "places.sqlite", "firefox_downloads": "places.sqlite", "firefox_annotations": "places.sqlite", "firefox_typed": "places.sqlite",
    "firefox_cookies": "cookies.sqlite", "firefox_autofill": "formhistory.sqlite", "firefox_permissions": "permissions.sqlite", "firefox_local_storage": "webappsstore.sqlite", "firefox_logins": "logins.json", "firefox_extensions": "extensions.json",
    "firefox_session": "recovery.js", "firefox_preferences": "prefs.js", "firefox_site_security": "SiteSecurityServiceState.txt", "safari_history": "History.db", "safari_cookies": "Cookies.db", "safari_bookmarks": "Bookmarks.plist", "safari_downloads": "Downloads.plist",
    "safari_extensions": "Extensions.plist", "safari_top_sites": "TopSites.plist",
}
#: Cases whose files keep their names, below what folder.
PLACED = {"chromium_extensions": "", "chromium_local_storage": "Local Storage/leveldb/", "chromium_session_storage": "Session Storage/"}


def profile_files(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """The stores of the cases ``names`` in folders of their own, as ``path, content, modificationTime``. All databases are made in
    one job, and all files are written once: a profile is read several times."""
    # both readers of annotations read every places.sqlite, so theirs is made once
    names = tuple(n for n in names if n != "firefox_annotations" or "firefox_downloads" not in names)
    tables = [(t, evidence.select(spark, sf_dir, sql).withColumn("store", F.concat_ws("/", F.lit(n), F.col("store").cast("string"), F.lit(NAMES[n])))) for n in names if n in STORES for t, sql in STORES[n].items()]
    files = None
    if tables:
        files = evidence.sqlite_stores(tables).withColumn("modificationTime", F.timestamp_seconds(F.lit(1_700_000_000)))
    for n in (n for n in names if n in FILES):
        own = FILES[n](spark, sf_dir)
        path = F.concat(F.lit(f"{n}/"), "path", F.lit("/" + NAMES[n])) if n in NAMES else F.concat(F.lit(f"{n}/"), F.regexp_replace("path", "/([^/]+)$", f"/{PLACED[n]}$1"))
        own = own.select(path.alias("path"), "content", F.timestamp_seconds(F.lit(1_700_000_000)).alias("modificationTime"))
        files = own if files is None else files.unionByName(own)
    return cut(files, "profile-files", GROUP_BYTES)


def expected_profile(names: tuple[str, ...]) -> str:
    """What SQL says about these cases: the columns of ``shown``."""
    return " UNION ALL ".join(f"SELECT timestamp_ns, browser, artifact, description, attrs FROM ({ORACLE_SQL[f'read_{n}']})" for n in names)
