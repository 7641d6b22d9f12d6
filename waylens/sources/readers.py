"""Browser stores to events. A reader names the tables it needs and the columns of its events; joins are DataFrame joins.

Events have ``timestamp_ns, browser, artifact, source, description, attrs_json`` and ``attrs`` (the same as a map).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions import text as tx
from waylens.functions import times as tm
from waylens.functions.urls import host_of
from waylens.sources.batches import contents, gathered
from waylens.sources.sqlite import evidence_files, sqlite_rows, sqlite_tables

Tables = dict[str, DataFrame]
READERS: dict[str, tuple[dict[str, str], Callable[[Tables], DataFrame]]] = {}


def events(rows: DataFrame, ns: Column, browser: str, artifact: str, description: Column, /, **attrs: Column) -> DataFrame:
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in attrs.items()]))
    found = rows.select(ns.cast("long").alias("timestamp_ns"), F.lit(browser).alias("browser"), F.lit(artifact).alias("artifact"), "source", description.alias("description"), packed.alias("attrs_json"))
    return found.withColumn("attrs", F.from_json("attrs_json", "map<string,string>"))


def reader(name: str, **tables: str):
    def register(f):
        READERS[name] = (tables, f)
        return f

    return register


def read_files(files: DataFrame, name: str) -> DataFrame:
    """Events of SQLite files (``path, content``) by one reader."""
    tables, make = READERS[name]
    return make(sqlite_tables(files, tables))


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Events of all SQLite files below ``path`` by one reader."""
    return read_files(evidence_files(spark, path), name)


def c(name: str) -> Column:
    return F.col(name)


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def or_else(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def visited(title: Column, url: Column, count: Column) -> Column:
    return F.when(title == "", url).otherwise(F.concat(F.lit("["), count.cast("string"), F.lit(" visits] "), title, F.lit(" — "), url))


URLS = "id bigint, url string, title string, visit_count bigint, last_visit_time bigint"


@reader("chromium_history", urls=URLS)
def chromium_history(t: Tables) -> DataFrame:
    rows = t["urls"].where("last_visit_time > 0")
    return events(rows, tm.webkit_micros(c("last_visit_time")), "Chromium", "History", visited(text("title"), c("url"), c("visit_count")), url=c("url"), title=text("title"), visit_count=c("visit_count"))


@reader("chromium_visits", visits="id bigint, url bigint, visit_time bigint, from_visit bigint, transition bigint, visit_duration bigint", urls=URLS)
def chromium_visits(t: Tables) -> DataFrame:
    u = t["urls"].select("source", c("id").alias("url_id"), c("url").alias("address"), "title")
    rows = t["visits"].where("visit_time > 0").withColumnRenamed("url", "url_id").join(u, ["source", "url_id"])
    code = c("transition")
    return events(
        rows, tm.webkit_micros(c("visit_time")), "Chromium", "History", or_else(text("title"), c("address")), url=c("address"), title=text("title"), transition=tx.transition_core(code),
        is_redirect=tx.has_flag(code, tx.CLIENT_REDIRECT | tx.SERVER_REDIRECT), chain_start=tx.has_flag(code, tx.CHAIN_START), chain_end=tx.has_flag(code, tx.CHAIN_END), from_address_bar=tx.has_flag(code, tx.FROM_ADDRESS_BAR),
        visit_duration_us=F.coalesce("visit_duration", F.lit(0)), visit_id=c("id"), from_visit=F.coalesce("from_visit", F.lit(0)), redirect_kind=tx.redirect_kind(code),
    )


@reader("chromium_downloads", downloads="id bigint, target_path string, start_time bigint, total_bytes bigint, state bigint, danger_type bigint", downloads_url_chains="id bigint, chain_index bigint, url string")
def chromium_downloads(t: Tables) -> DataFrame:
    first = t["downloads_url_chains"].where("chain_index = 0").select("source", "id", "url")
    rows = t["downloads"].where("start_time > 0").join(first, ["source", "id"], "left")
    name = F.regexp_extract("target_path", "([^/]*)/*$", 1)
    return events(rows, tm.webkit_micros(c("start_time")), "Chromium", "Downloads", F.concat(name, F.lit(" ("), c("total_bytes").cast("string"), F.lit(" bytes)")), url=text("url"), target_path=c("target_path"), total_bytes=c("total_bytes"), state=c("state"), danger_type=c("danger_type"))


@reader("chromium_cookies", cookies="creation_utc bigint, host_key string, name string, path string, expires_utc bigint, is_secure bigint, is_httponly bigint, samesite bigint, top_frame_site_key string")
def chromium_cookies(t: Tables, store: str = "default") -> DataFrame:
    rows = t["cookies"].where("creation_utc > 0")
    return events(
        rows, tm.webkit_micros(c("creation_utc")), "Chromium", "Cookies", F.concat(c("host_key"), F.lit(" — "), c("name"), F.lit(" (path="), c("path"), F.lit(")")), host=c("host_key"), name=c("name"), path=c("path"),
        is_secure=c("is_secure") != 0, is_httponly=c("is_httponly") != 0, samesite=c("samesite"), expires_utc=c("expires_utc"), encrypted_value=F.lit("ENCRYPTED"), cookie_store=F.lit(store),
        top_frame_site_key=c("top_frame_site_key"), partitioned=c("top_frame_site_key") != "",
    )


@reader("extension_cookies", **READERS["chromium_cookies"][0])
def extension_cookies(t: Tables) -> DataFrame:
    """The cookie store of extensions."""
    return chromium_cookies(t, "extension")


@reader("chromium_autofill", autofill="name string, value string, count bigint, date_created bigint, date_last_used bigint")
def chromium_autofill(t: Tables) -> DataFrame:
    rows = t["autofill"].where("date_created > 0")
    return events(rows, tm.unix_seconds(c("date_created")), "Chromium", "Autofill", F.concat(c("name"), F.lit(": "), c("value")), name=c("name"), value=c("value"), count=c("count"), date_last_used=c("date_last_used"))


@reader("chromium_logins", logins="origin_url string, action_url string, username_value string, signon_realm string, date_created bigint, date_last_used bigint, date_password_modified bigint, times_used bigint, blacklisted_by_user bigint")
def chromium_logins(t: Tables) -> DataFrame:
    rows = t["logins"].where("date_created > 0 OR blacklisted_by_user = 1")
    return events(
        rows, F.when(c("date_created") > 0, tm.webkit_micros(c("date_created"))).otherwise(0), "Chromium", "LoginData", c("origin_url"), origin_url=c("origin_url"), action_url=text("action_url"), username=c("username_value"), signon_realm=c("signon_realm"),
        date_last_used=c("date_last_used"), date_password_modified=c("date_password_modified"), times_used=c("times_used"), blacklisted_by_user=c("blacklisted_by_user") != 0, password=F.lit("ENCRYPTED"),
    )


@reader("chromium_favicons", icon_mapping="page_url string, icon_id bigint", favicons="id bigint, url string", favicon_bitmaps="icon_id bigint, last_updated bigint, width bigint")
def chromium_favicons(t: Tables) -> DataFrame:
    icons = t["favicons"].select("source", c("id").alias("icon_id"), c("url").alias("icon_url"))
    rows = t["icon_mapping"].where("page_url <> ''").join(icons, ["source", "icon_id"]).join(t["favicon_bitmaps"], ["source", "icon_id"])
    ns = F.when(c("last_updated") > 0, tm.webkit_micros(c("last_updated"))).otherwise(0)
    return events(rows, ns, "Chromium", "Favicon", F.concat(c("page_url"), F.lit(" — favicon")), url=c("page_url"), page_url=c("page_url"), icon_url=c("icon_url"), width=c("width"), last_updated=c("last_updated"))


@reader("chromium_top_sites", top_sites="url string, url_rank bigint, title string")
def chromium_top_sites(t: Tables) -> DataFrame:
    label = F.concat(or_else(text("title"), c("url")), F.lit(" (top-site rank "), c("url_rank").cast("string"), F.lit(")"))
    return events(t["top_sites"].where("url <> ''"), F.lit(0), "Chromium", "TopSite", label, url=c("url"), title=text("title"), url_rank=c("url_rank"))


@reader("chromium_shortcuts", omni_box_shortcuts="text string, fill_into_edit string, url string, contents string, last_access_time bigint, number_of_hits bigint")
def chromium_shortcuts(t: Tables) -> DataFrame:
    ns = F.when(c("last_access_time") > 0, tm.webkit_micros(c("last_access_time"))).otherwise(0)
    label = F.concat(F.lit("typed “"), c("text"), F.lit("” → "), c("url"))
    return events(t["omni_box_shortcuts"].where("text <> ''"), ns, "Chromium", "Shortcut", label, typed_text=c("text"), fill_into_edit=c("fill_into_edit"), url=c("url"), contents=c("contents"), last_access_time=c("last_access_time"), number_of_hits=c("number_of_hits"))


@reader("chromium_predictions", network_action_predictor="user_text string, url string, number_of_hits bigint, number_of_misses bigint")
def chromium_predictions(t: Tables) -> DataFrame:
    label = F.concat(F.lit("typed “"), c("user_text"), F.lit("” → "), c("url"))
    return events(t["network_action_predictor"].where("user_text <> ''"), F.lit(0), "Chromium", "NetworkPrediction", label, typed_text=c("user_text"), url=c("url"), number_of_hits=c("number_of_hits"), number_of_misses=c("number_of_misses"))


PLACES = "id bigint, url string, title string, visit_count bigint, last_visit_date bigint"


def _with_place(rows: DataFrame, t: Tables, key: str) -> DataFrame:
    places = t["moz_places"].select("source", c("id").alias("__place"), c("url").alias("address"), c("title").alias("page_title"))
    return rows.join(places, (rows["source"] == places["source"]) & (rows[key] == c("__place"))).drop(places["source"])


@reader("firefox_history", moz_places=PLACES)
def firefox_history(t: Tables) -> DataFrame:
    rows = t["moz_places"].where("last_visit_date IS NOT NULL")
    return events(rows, tm.unix_micros(c("last_visit_date")), "Firefox", "History", visited(text("title"), c("url"), c("visit_count")), url=c("url"), title=text("title"), visit_count=c("visit_count"))


@reader("firefox_visits", moz_historyvisits="id bigint, from_visit bigint, place_id bigint, visit_date bigint, visit_type bigint, session bigint", moz_places=PLACES)
def firefox_visits(t: Tables) -> DataFrame:
    rows = _with_place(t["moz_historyvisits"].where("visit_date > 0"), t, "place_id")
    redirect = c("visit_type").isin(5, 6)
    return events(
        rows, tm.unix_micros(c("visit_date")), "Firefox", "History", or_else(text("page_title"), c("address")), url=c("address"), title=text("page_title"), visit_id=c("id"), from_visit=F.coalesce("from_visit", F.lit(0)),
        transition=tx.firefox_type(c("visit_type")), is_redirect=redirect, redirect_kind=F.when(redirect, "server"), session=F.when(c("session") != 0, c("session")),
    )


@reader("firefox_cookies", moz_cookies="host string, name string, path string, creationTime bigint, expiry bigint, isSecure bigint, isHttpOnly bigint, sameSite bigint")
def firefox_cookies(t: Tables) -> DataFrame:
    rows = t["moz_cookies"].where("creationTime > 0")
    return events(rows, tm.unix_micros(c("creationTime")), "Firefox", "Cookies", F.concat(c("host"), F.lit(" — "), c("name")), host=c("host"), name=c("name"), path=c("path"), expiry=c("expiry"), is_secure=c("isSecure") != 0, is_httponly=c("isHttpOnly") != 0, samesite=c("sameSite"))


@reader("firefox_bookmarks", moz_bookmarks="type bigint, fk bigint, title string, dateAdded bigint", moz_places=PLACES)
def firefox_bookmarks(t: Tables) -> DataFrame:
    rows = _with_place(t["moz_bookmarks"].where("type = 1 AND dateAdded > 0"), t, "fk")
    return events(rows, tm.unix_micros(c("dateAdded")), "Firefox", "Bookmarks", text("title"), url=c("address"), title=text("title"))


@reader("firefox_autofill", moz_formhistory="fieldname string, value string, timesUsed bigint, firstUsed bigint, lastUsed bigint")
def firefox_autofill(t: Tables) -> DataFrame:
    rows = t["moz_formhistory"].where("firstUsed > 0")
    return events(rows, tm.unix_micros(c("firstUsed")), "Firefox", "Autofill", F.concat(c("fieldname"), F.lit(": "), c("value")), name=c("fieldname"), value=c("value"), count=c("timesUsed"), last_used=c("lastUsed"))


@reader("firefox_annotations", moz_annos="place_id bigint, anno_attribute_id bigint, content string, dateAdded bigint", moz_anno_attributes="id bigint, name string", moz_places=PLACES)
def firefox_annotations(t: Tables) -> DataFrame:
    names = t["moz_anno_attributes"].select("source", c("id").alias("anno_attribute_id"), c("name").alias("kind"))
    rows = _with_place(t["moz_annos"], t, "place_id").join(names, ["source", "anno_attribute_id"])
    return events(rows, F.when(c("dateAdded") > 0, tm.unix_micros(c("dateAdded"))).otherwise(0), "Firefox", "Annotation", F.concat(c("kind"), F.lit(" — "), c("address")), url=c("address"), name=c("kind"), value=c("content"))


@reader("firefox_downloads", moz_annos="place_id bigint, anno_attribute_id bigint, content string, dateAdded bigint", moz_anno_attributes="id bigint, name string", moz_places=PLACES)
def firefox_downloads(t: Tables) -> DataFrame:
    names = t["moz_anno_attributes"].where("name = 'downloads/destinationFileURI'").select("source", c("id").alias("anno_attribute_id"))
    rows = _with_place(t["moz_annos"], t, "place_id").join(names, ["source", "anno_attribute_id"])
    return events(rows, tm.unix_micros(c("dateAdded")), "Firefox", "Downloads", c("content"), url=c("address"), target_path=c("content"))


@reader("firefox_typed", moz_inputhistory="place_id bigint, input string, use_count double", moz_places=PLACES)
def firefox_typed(t: Tables) -> DataFrame:
    rows = _with_place(t["moz_inputhistory"], t, "place_id")
    return events(rows, F.lit(0), "Firefox", "TypedInput", F.concat(F.lit("typed “"), c("input"), F.lit("” → "), c("address")), url=c("address"), typed_text=c("input"), use_count=c("use_count"))


@reader("firefox_permissions", moz_perms="origin string, type string, permission bigint, modificationTime bigint")
def firefox_permissions(t: Tables) -> DataFrame:
    setting = F.when(c("permission") == 1, "allow").when(c("permission") == 2, "deny").when(c("permission") == 3, "prompt").otherwise("unknown")
    ns = F.when(c("modificationTime") > 0, tm.unix_millis(c("modificationTime"))).otherwise(0)
    return events(t["moz_perms"], ns, "Firefox", "Permission", F.concat(c("origin"), F.lit(" "), c("type"), F.lit("="), setting), origin=c("origin"), permission=c("type"), setting=setting)


@reader("firefox_local_storage", webappsstore2="scope string, key string, value string")
def firefox_local_storage(t: Tables) -> DataFrame:
    host = F.regexp_replace(F.reverse(F.get(F.split("scope", ":"), F.lit(0))), r"^\.+", "")
    return events(t["webappsstore2"], F.lit(0), "Firefox", "LocalStorage", F.concat(host, F.lit(" "), c("key")), host=host, key=c("key"), value=c("value"))


@reader("safari_history", history_visits="id bigint, history_item bigint, visit_time double", history_items="id bigint, url string, visit_count bigint")
def safari_history(t: Tables) -> DataFrame:
    items = t["history_items"].select("source", c("id").alias("history_item"), "url", "visit_count")
    rows = t["history_visits"].where("visit_time > 0").join(items, ["source", "history_item"])
    return events(rows, tm.core_data_seconds(c("visit_time")), "Safari", "History", c("url"), url=c("url"), visit_count=c("visit_count"))


@reader("safari_cookies", cookies="name string, value string, domain string, path string, creation double, expiry double, is_secure bigint, is_httponly bigint")
def safari_cookies(t: Tables) -> DataFrame:
    rows = t["cookies"].where("creation > 0")
    return events(rows, tm.core_data_seconds(c("creation")), "Safari", "Cookies", F.concat(c("domain"), F.lit(" — "), c("name")), host=c("domain"), name=c("name"), path=c("path"), expiry=c("expiry"), is_secure=c("is_secure") != 0, is_httponly=c("is_httponly") != 0)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source, value``: the lines of text files below a path."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")


def lines_of(files: DataFrame) -> DataFrame:
    """The same of files whose content is a column."""
    return files.select(F.col("path").alias("source"), F.explode(F.split(F.make_valid_utf8("content"), "\r?\n")).alias("value"))


def preference_lines(lines: DataFrame) -> DataFrame:
    """``user_pref("name", value);`` lines."""
    shape = r'^\s*user_pref\("([^"]+)",\s*(.*)\);\s*$'
    rows = lines.select("source", F.regexp_extract("value", shape, 1).alias("name"), F.regexp_extract("value", shape, 2).alias("setting")).where("name <> ''")
    return events(rows, F.lit(0), "Firefox", "Preferences", F.concat(c("name"), F.lit(" = "), c("setting")), name=c("name"), value=F.regexp_replace("setting", '^"|"$', ""))


def site_security_lines(lines: DataFrame) -> DataFrame:
    """Tab-separated lines whose key ends in ``:HSTS``; last access in days, expiry in ms."""
    parts = F.split("value", "\t")
    rows = lines.select("source", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(2)).try_cast("long").alias("days"), F.get(F.split(F.get(parts, F.lit(3)), ","), F.lit(0)).try_cast("long").alias("expiry"))
    rows = rows.where(F.col("key").endswith(":HSTS")).withColumn("host", F.regexp_replace("key", "(\\^.*)?:HSTS$", ""))
    return events(rows, tm.unix_seconds(F.coalesce(c("days"), F.lit(0)) * 86400), "Firefox", "RecoveredDomain", F.concat(F.lit("HSTS "), c("host")), host=c("host"), expiry_ms=c("expiry"), source_artifact=F.lit("site_security"))


def firefox_preferences(spark: SparkSession, path: str) -> DataFrame:
    return preference_lines(text_lines(spark, path))


def firefox_site_security(spark: SparkSession, path: str) -> DataFrame:
    return site_security_lines(text_lines(spark, path))


def chromium_bookmarks(files: DataFrame) -> DataFrame:
    """URL nodes of Chromium's bookmark trees (``path, content``), walked in tasks file by file."""
    import json

    schema = StructType.fromDDL("source string, name string, url string, added bigint, folder string")
    arrow = to_arrow_schema(schema)

    def walked(path: str, content: bytes | None):
        try:
            todo = [(n, "") for n in json.loads(content)["roots"].values() if isinstance(n, dict)]
        except (ValueError, KeyError, TypeError, AttributeError):
            return
        while todo:
            node, folder = todo.pop()
            if node.get("type") == "url":
                added = str(node.get("date_added", "0"))
                yield path, node.get("name", ""), node.get("url", ""), int(added) if added.isdigit() else 0, folder
            todo += [(n, f"{folder}/{node.get('name', '')}") for n in reversed(node.get("children", [])) if isinstance(n, dict)]

    def run(batches):
        return gathered((row for path, content in contents(batches) for row in walked(path, content)), arrow)

    rows = files.select("path", "content").mapInArrow(run, schema)
    return events(rows, F.when(c("added") > 0, tm.webkit_micros(c("added"))).otherwise(0), "Chromium", "Bookmarks", or_else(c("name"), c("url")), url=c("url"), title=c("name"), folder=c("folder"))


def discover_profiles(files: DataFrame) -> DataFrame:
    """``browser, profile, path`` of folders that hold a browser's marker files, from a listing of ``path``."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    folder = F.regexp_replace("path", "/[^/]+$", "")
    family = F.when(name == "places.sqlite", "Firefox").when(name == "History.db", "Safari").when(name.isin("History", "Cookies", "Login Data"), "Chromium").when(name == "WebCacheV01.dat", "InternetExplorer")
    return files.select(family.alias("browser"), F.regexp_extract(folder, "([^/]+)$", 1).alias("profile"), folder.alias("path"), tx.user_of(folder).alias("user")).where("browser IS NOT NULL").distinct()


@reader("chromium_cards", credit_cards="name_on_card string, expiration_month bigint, expiration_year bigint, date_modified bigint, use_count bigint, use_date bigint")
def chromium_cards(t: Tables) -> DataFrame:
    """Stored cards, without their numbers."""
    label = F.format_string("stored card: %s (exp %02d/%d)", text("name_on_card"), number("expiration_month"), number("expiration_year"))
    return events(
        t["credit_cards"], tm.webkit_micros(c("date_modified")), "Chromium", "CreditCard", label, name_on_card=text("name_on_card"), expiration_month=number("expiration_month"), expiration_year=number("expiration_year"), use_count=c("use_count"), use_date=c("use_date"),
        card_type=F.lit("local"), card_number=F.lit("ENCRYPTED"),
    )


@reader("chromium_server_cards", masked_credit_cards="name_on_card string, network string, last_four string, exp_month bigint, exp_year bigint, bank_name string")
def chromium_server_cards(t: Tables) -> DataFrame:
    label = F.concat(F.lit("server card: "), text("network"), F.lit(" ****"), text("last_four"), F.lit(" ("), text("name_on_card"), F.lit(")"))
    return events(
        t["masked_credit_cards"], F.lit(0), "Chromium", "CreditCard", label, name_on_card=text("name_on_card"), network=text("network"), last_four=text("last_four"), expiration_month=number("exp_month"), expiration_year=number("exp_year"), bank_name=text("bank_name"), card_type=F.lit("masked_server"),
    )


@reader("chromium_tokens", token_service="service string")
def chromium_tokens(t: Tables) -> DataFrame:
    rows = t["token_service"].where("service IS NOT NULL")
    return events(rows, F.lit(0), "Chromium", "AuthToken", F.concat(F.lit("auth token for service: "), c("service")), service=c("service"), token=F.lit("ENCRYPTED"))


@reader(
    "chromium_profiles", autofill_profiles="guid string, date_modified bigint, use_count bigint, use_date bigint", autofill_profile_names="rowid bigint, guid string, first_name string, middle_name string, last_name string",
    autofill_profile_emails="rowid bigint, guid string, email string", autofill_profile_phones="rowid bigint, guid string, number string",
)
def chromium_profiles(t: Tables) -> DataFrame:
    """Address profiles with the first name, mail address and phone number of their guid."""
    def first(table: str, value: Column, name: str) -> DataFrame:
        return t[table].groupBy("source", "guid").agg(F.min_by(F.struct(value.alias("v")), F.coalesce("rowid", F.lit(0)))["v"].alias(name))

    full = F.array_join(F.filter(F.array("first_name", "middle_name", "last_name"), lambda x: x != ""), " ")
    rows = t["autofill_profiles"].where("guid IS NOT NULL AND date_modified IS NOT NULL AND use_count IS NOT NULL AND use_date IS NOT NULL")
    for table, value, name in (("autofill_profile_names", full, "full_name"), ("autofill_profile_emails", c("email"), "email"), ("autofill_profile_phones", c("number"), "phone")):
        rows = rows.join(first(table, value, name), ["source", "guid"], "left")
    label = F.concat(F.lit("autofill profile: "), text("full_name"), F.lit(" <"), text("email"), F.lit("> "), text("phone"))
    return events(rows, tm.webkit_micros(c("date_modified")), "Chromium", "Autofill", label, guid=c("guid"), full_name=text("full_name"), email=text("email"), phone=text("phone"), use_count=c("use_count"), use_date=c("use_date"))


def chromium_web_data(files: DataFrame) -> DataFrame:
    """All of a Web Data file: stored and server cards, tokens and address profiles of the tables it has."""
    names = ("chromium_cards", "chromium_server_cards", "chromium_tokens", "chromium_profiles")
    tables = sqlite_tables(files, {t: ddl for n in names for t, ddl in READERS[n][0].items()})
    out = None
    for n in names:
        found = READERS[n][1](tables)
        out = found if out is None else out.unionByName(found)
    return out


@reader("chromium_media", playbackSession="url string, duration_ms bigint, position_ms bigint, title string, source_title string, last_updated_time_s bigint", origin="origin string, aggregate_watchtime_audio_video_s bigint, last_updated_time_s bigint", playback="url string, watch_time_s bigint, has_audio bigint, has_video bigint, last_updated_time_s bigint")
def chromium_media(t: Tables) -> DataFrame:
    """Playback sessions, origins and playbacks; times are WebKit seconds."""
    ns = F.when(c("last_updated_time_s") > 0, tm.webkit_micros(tm.saturating_multiply(c("last_updated_time_s"), 1_000_000))).otherwise(0)
    shown = F.when(text("title") == "", c("url")).otherwise(F.concat(c("title"), F.lit(" — "), c("url")))
    session = events(
        t["playbackSession"].where("url <> ''"), ns, "Chromium", "MediaPlayback", F.concat(shown, F.lit(" (position "), number("position_ms").cast("string"), F.lit("ms / "), number("duration_ms").cast("string"), F.lit("ms)")), url=c("url"), media_kind=F.lit("session"),
        title=text("title"), source_title=text("source_title"), duration_ms=number("duration_ms"), position_ms=number("position_ms"), last_updated_time_s=number("last_updated_time_s"),
    )
    total = number("aggregate_watchtime_audio_video_s")
    origin = events(t["origin"].where("origin <> ''"), ns, "Chromium", "MediaPlayback", F.concat(c("origin"), F.lit(" — media origin ("), total.cast("string"), F.lit("s aggregate)")), origin=c("origin"), url=c("origin"), media_kind=F.lit("origin"), aggregate_watchtime_s=total, last_updated_time_s=number("last_updated_time_s"))
    playback = events(t["playback"].where("url <> ''"), ns, "Chromium", "MediaPlayback", F.concat(c("url"), F.lit(" — playback ("), number("watch_time_s").cast("string"), F.lit("s)")), url=c("url"), media_kind=F.lit("playback"), watch_time_s=number("watch_time_s"), last_updated_time_s=number("last_updated_time_s"))
    return session.unionByName(origin).unionByName(playback)


@reader("chromium_reporting", nel_policies="origin_host string, group_name string, last_access_us_since_epoch bigint", reporting_endpoints="origin_host string, group_name string, url string")
def chromium_reporting(t: Tables) -> DataFrame:
    """Network error logging policies and reporting endpoints: hosts that were contacted."""
    used = F.when(c("last_access_us_since_epoch") > 0, tm.webkit_micros(c("last_access_us_since_epoch"))).otherwise(0)
    policies = events(t["nel_policies"].where("origin_host <> ''"), used, "Chromium", "RecoveredDomain", F.concat(F.lit("NEL policy "), c("origin_host")), host=c("origin_host"), group_name=c("group_name"), source_artifact=F.lit("nel"))
    to = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    ends = events(t["reporting_endpoints"].where("origin_host <> ''"), F.lit(0), "Chromium", "RecoveredDomain", F.concat(F.lit("reporting endpoint "), c("origin_host")), host=c("origin_host"), group_name=c("group_name"), url=c("url"), report_to_host=F.when(to != "", F.lower(to)), source_artifact=F.lit("reporting"))
    return policies.unionByName(ends)


def reporting_json(files: DataFrame) -> DataFrame:
    """The older form of the same store, JSON: policies and endpoints of origins. Databases are left to ``chromium_reporting``."""
    texts = files.where(~F.startswith(F.hex(F.substring("content", 1, 15)), F.lit(b"SQLite format 3".hex().upper()))).select(F.col("path").alias("source"), F.make_valid_utf8("content").alias("json"))
    listed = lambda path, shape: texts.select("source", F.explode(F.from_json(F.get_json_object("json", path), f"array<struct<{shape}>>")).alias("x")).select("source", "x.*").withColumn("host", host_of(c("origin"))).where("host <> ''")
    policies = listed("$.net.nel.policies", "origin:string,report_to:string")
    policies = events(policies, F.lit(0), "Chromium", "RecoveredDomain", F.concat(F.lit("NEL policy "), c("host")), host=c("host"), group_name=text("report_to"), source_artifact=F.lit("nel"))
    ends = listed("$.net.reporting.endpoints", "origin:string,url:string,`group`:string")
    ends = events(ends, F.lit(0), "Chromium", "RecoveredDomain", F.concat(F.lit("reporting endpoint "), c("host")), host=c("host"), group_name=text("group"), url=c("url"), report_to_host=host_of(c("url")), source_artifact=F.lit("reporting"))
    return policies.unionByName(ends)


def firefox_backups(files: DataFrame) -> DataFrame:
    """``source, name, url, title, added, backup_date`` of the bookmarks in backups (``path, content``), packed or plain; the date is that
    of the file's name, null if it has none. Trees are walked in tasks file by file; files that don't parse are left out."""
    import json

    from waylens.sources.binary import plain

    schema = StructType.fromDDL("source string, name string, url string, title string, added bigint")
    arrow = to_arrow_schema(schema)

    def walked(path: str, content: bytes | None):
        try:
            todo = [json.loads(plain(content))]
        except (ValueError, TypeError):
            return
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                if isinstance(node.get("uri"), str):
                    added = node.get("dateAdded")
                    yield path, path.rpartition("/")[2], node["uri"], str(node.get("title") or ""), added if isinstance(added, int) else 0
                children = node.get("children")
                todo += children if isinstance(children, list) else []

    def run(batches):
        return gathered((row for path, content in contents(batches) for row in walked(path, content)), arrow)

    rows = files.select("path", "content").mapInArrow(run, schema)
    day = F.regexp_extract("name", "^bookmarks-([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return rows.withColumn("backup_date", F.when(day != "", day))


def recovered_bookmarks(backups: DataFrame, current: DataFrame) -> DataFrame:
    """Events of bookmarks that some backup has and ``current`` (``url``) hasn't: each URL once, from its newest backup by date, then name."""
    newest = backups.groupBy("url").agg(F.max_by(F.struct("source", "name", "title", "added", "backup_date"), F.struct("backup_date", "name", "added")).alias("b")).select("url", "b.*")
    rows = newest.join(current.select("url"), "url", "left_anti")
    label = F.concat(F.lit("bookmark of backup "), c("name"), F.lit(" that is none now: "), or_else(c("title"), c("url")))
    return events(rows, F.when(c("added") > 0, c("added") * 1000).otherwise(0), "Firefox", "RecoveredBookmark", label, url=c("url"), title=c("title"), source_backup=c("name"), backup_date=c("backup_date"))


def chromium_bounces(files: DataFrame) -> DataFrame:
    """Sites of the bounce-tracking table, whose columns vary: the latest activation or interaction, else the latest of any
    of its times."""
    rows = sqlite_rows(files, "bounces").withColumn("cells", F.from_json("row", "map<string,string>"))
    times = F.map_filter("cells", lambda k, v: k.endswith("_time"))
    latest = lambda m: F.coalesce(F.array_max(F.transform(F.map_values(m), lambda v: F.greatest(F.lit(0).cast("long"), F.coalesce(v.try_cast("long"), F.lit(0))))), F.lit(0))
    acts = latest(F.map_filter(times, lambda k, v: k.contains("activation") | k.contains("interaction")))
    rows = rows.select("source", F.element_at("cells", F.lit("site")).alias("site"), F.when(acts > 0, acts).otherwise(latest(times)).alias("when"), F.to_json(times).alias("times")).where("site <> ''")
    ns = F.when(c("when") > 0, tm.webkit_micros(c("when"))).otherwise(0)
    return events(rows, ns, "Chromium", "RecoveredDomain", F.concat(F.lit("site state "), c("site")), host=c("site"), source_artifact=F.lit("bounces"), times=c("times"))
