"""Chromium's JSON stores to events, by JSON functions over whole files (``path, content``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.functions import times as tm
from waylens.functions.urls import host_of
from waylens.sources.binary import unpacked
from waylens.sources.readers import c, events

#: Names of content settings from 0.
SETTINGS = ("default", "allow", "block", "ask", "session_only", "detect_important_content")


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("source"), F.col("content").cast("string").alias("json"))


def _map(json: Column, path: str) -> Column:
    """An object's members as a map of JSON texts; null if there is none at the path."""
    return F.from_json(F.get_json_object(json, path), "map<string,string>")


def permissions(files: DataFrame) -> DataFrame:
    """A site's content settings: one event for each kind and origin."""
    kinds = _texts(files).select("source", F.explode(_map(c("json"), "$.profile.content_settings.exceptions")).alias("kind", "entries"))
    rows = kinds.select("source", "kind", F.explode(F.from_json("entries", "map<string,string>")).alias("origin", "entry"))
    setting = F.get_json_object("entry", "$.setting").try_cast("int")
    modified = F.get_json_object("entry", "$.last_modified").try_cast("long")
    label = F.when(setting.isNull(), "unspecified").otherwise(F.coalesce(F.get(F.array(*[F.lit(x) for x in SETTINGS]), setting), F.lit("unknown")))
    ns = F.when(modified > 0, tm.webkit_micros(modified)).otherwise(0)
    return events(rows, ns, "Chromium", "Permission", F.concat("kind", F.lit(" "), label, F.lit(" for "), "origin"), origin=c("origin"), permission=c("kind"), setting=label)


def profiles(files: DataFrame) -> DataFrame:
    """The profile cache of Local State: an event for each profile."""
    rows = _texts(files).select("source", F.explode(_map(c("json"), "$.profile.info_cache")).alias("folder", "info"))
    part = lambda k: F.get_json_object("info", f"$.{k}")
    name, user = F.coalesce(part("name"), F.lit("Unknown")), F.coalesce(part("user_name"), F.lit(""))
    active = F.coalesce(part("active_time").try_cast("double"), F.lit(0.0))
    label = F.concat(F.lit("Profile "), c("folder"), F.lit(": "), name, F.when(user == "", "").otherwise(F.concat(F.lit(" ("), user, F.lit(")"))))
    return events(rows, tm.unix_seconds(active.cast("long")), "Chromium", "Session", label, profile_dir=c("folder"), profile_name=name, user_name=user, active_time=active)


def transport_security(files: DataFrame) -> DataFrame:
    """HSTS entries; their hosts are hashes and can't be turned back."""
    texts = _texts(files)
    listed = texts.select("source", F.explode(F.from_json(F.get_json_object("json", "$.sts"), "array<string>")).alias("entry")).select("source", F.get_json_object("entry", "$.host").alias("hash"), "entry")
    keyed = texts.where(F.get_json_object("json", "$.sts").isNull()).select("source", F.explode(F.from_json("json", "map<string,string>")).alias("hash", "entry")).where(F.col("entry").startswith("{"))
    rows = listed.where("hash IS NOT NULL").unionByName(keyed)
    seen = F.get_json_object("entry", "$.sts_observed").try_cast("double")
    ns = F.when(seen > 0, tm.unix_seconds(seen.cast("long"))).otherwise(0)
    return events(rows, ns, "Chromium", "RecoveredDomain", F.lit("HSTS entry (hashed host)"), host_hash=c("hash"), enumerable=F.lit(False), source_artifact=F.lit("transport_security"))


#: The settings that are read, by their path, those that hold a WebKit time, and the note of contacted hosts.
PREFERENCES = (
    "homepage", "homepage_is_newtabpage", "session.restore_on_startup", "download.default_directory", "savefile.default_directory", "profile.name", "profile.created_by_version", "profile.exit_type",
    "google.services.last_username", "google.services.last_account_id", "intl.accept_languages", "intl.selected_languages", "extensions.last_chrome_version", "credentials_enable_service", "autofill.enabled", "safebrowsing.enabled",
)
TIME_PREFERENCES = ("profile.creation_time", "browser.last_clear_browsing_data_time")
CONTACTED = "contacted host, recovered independently of history; may be a subresource/third-party (CDN, ad, tracker), not necessarily a user-navigated site"


def preferences(files: DataFrame) -> DataFrame:
    """Settings, accounts and start pages of a profile; settings that hold a time are timed events."""
    texts = _texts(files)
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object("json", f"$.{k}").alias("value"), F.lit(k in TIME_PREFERENCES).alias("timed")) for k in (*PREFERENCES, *TIME_PREFERENCES)])
    pages = F.transform(F.from_json(F.get_json_object("json", "$.session.startup_urls"), "array<string>"), lambda u: F.struct(F.lit("session.startup_urls").alias("key"), u.alias("value"), F.lit(False).alias("timed")))
    rows = texts.select("source", F.explode(F.concat(known, F.coalesce(pages, F.array().cast("array<struct<key:string,value:string,timed:boolean>>")))).alias("p")).select("source", "p.*").where("value IS NOT NULL")
    ns = F.when(c("timed") & c("value").try_cast("long").isNotNull(), tm.webkit_micros(c("value").try_cast("long"))).otherwise(0)
    settings = events(rows, ns, "Chromium", "Preferences", F.concat("key", F.lit(" = "), "value"), key=c("key"), value=c("value"))
    people = texts.select("source", F.explode(F.from_json(F.get_json_object("json", "$.account_info"), "array<struct<email:string,full_name:string,gaia:string>>")).alias("a")).select("source", *[F.coalesce(F.col(f"a.{k}"), F.lit("")).alias(k) for k in ("email", "full_name", "gaia")])
    label = F.concat(F.lit("account_info = "), "email", F.lit(" ("), "full_name", F.lit(") gaia="), "gaia")
    return settings.unionByName(events(people, F.lit(0), "Chromium", "Preferences", label, key=F.lit("account_info"), email=c("email"), full_name=c("full_name"), gaia=c("gaia")))


def _contacted(origin: Column) -> Column:
    bare = F.trim(origin)
    return F.when(origin.contains("://"), host_of(origin)).when((bare != "") & ~bare.rlike("[/ ]"), bare)


def network_state(files: DataFrame) -> DataFrame:
    """Hosts that the network stack remembers: servers, and alternative services that failed."""
    texts = _texts(files)
    part = lambda k, ddl: texts.select("source", F.explode(F.from_json(F.get_json_object("json", f"$.net.http_server_properties.{k}"), f"array<{ddl}>")).alias("e")).select("source", "e.*")
    servers = part("servers", "struct<server:string,supports_spdy:boolean,alternative_service:array<struct<protocol_str:string>>>").withColumn("domain", _contacted(c("server"))).where("domain IS NOT NULL")
    protocols = F.filter(F.coalesce("alternative_service.protocol_str", F.array().cast("array<string>")), lambda x: x.isNotNull())
    found = events(
        servers, F.lit(0), "Chromium", "RecoveredDomain", F.concat("domain", F.lit(" — contacted (HTTP server properties)")), domain=c("domain"), origin=c("server"), source_artifact=F.lit("Network Persistent State"), supports_spdy=F.coalesce("supports_spdy", F.lit(False)), alt_protocols=protocols,
        recovery_note=F.lit(CONTACTED),
    )
    broken = part("broken_alternative_services", "struct<host:string,protocol_str:string,broken_until:string,broken_count:bigint>").withColumn("domain", _contacted(c("host"))).where("domain IS NOT NULL")
    until, protocol = c("broken_until").try_cast("long"), F.coalesce("protocol_str", F.lit(""))
    failed = events(
        broken, F.coalesce(tm.unix_seconds(until), F.lit(0)), "Chromium", "RecoveredDomain", F.concat("domain", F.lit(" — contacted (broken alt-svc "), protocol, F.lit(")")), domain=c("domain"), source_artifact=F.lit("Network Persistent State"), alt_svc_broken=F.lit(True), protocol=protocol,
        recovery_note=F.lit(CONTACTED), broken_count=c("broken_count"),
    )
    return found.unionByName(failed)


def chromium_extensions(files: DataFrame) -> DataFrame:
    """Extensions below ``Extensions/<id>/<version>/``: the manifest of each id's highest version by its folder's name, whose
    parts are compared as numbers (``1000`` and ``1.10`` come after ``999`` and ``1.9``)."""
    parts = r"^(.*/Extensions)/([^/]+)/([^/]+)/(.+)$"
    at = lambda i: F.regexp_extract("path", parts, i)
    rows = files.where(F.col("path").rlike(parts)).select(at(1).alias("source"), at(2).alias("id"), at(3).alias("folder"), at(4).alias("name"), "content", F.unix_micros("modificationTime").alias("changed"))
    # parts that are no numbers come first, in the order of their texts; so do the shorter of two that begin alike
    parts_of = F.transform(F.split("folder", "[._-]"), lambda p: F.struct(p.try_cast("decimal(38,0)"), p))
    last = rows.groupBy("source", "id").agg(F.max(F.struct(parts_of, "folder"))["folder"].alias("folder"))
    own = rows.where("name = 'manifest.json'").join(last, ["source", "id", "folder"]).withColumn("json", F.col("content").cast("string")).where(F.try_parse_json("json").isNotNull())
    field = lambda k: F.coalesce(F.get_json_object("json", f"$.{k}"), F.lit(""))
    return events(own, tm.unix_micros(c("changed")), "Chromium", "Extensions", F.concat(field("name"), F.lit(" v"), field("version")), name=field("name"), version=field("version"), id=c("id"), description=field("description"))


def _listed(files: DataFrame, path: str, fields: str) -> DataFrame:
    return _texts(files).select("source", F.explode(F.from_json(F.get_json_object("json", path), f"array<struct<{fields}>>")).alias("e")).select("source", "e.*")


def firefox_logins(files: DataFrame) -> DataFrame:
    """Saved logins without their secrets."""
    rows = _listed(files, "$.logins", "hostname:string,formSubmitURL:string,usernameField:string,timeCreated:bigint,timesUsed:bigint,timeLastUsed:bigint,timePasswordChanged:bigint")
    text, number = lambda k: F.coalesce(k, F.lit("")), lambda k: F.coalesce(k, F.lit(0))
    return events(
        rows, tm.unix_millis(number("timeCreated")), "Firefox", "LoginData", text("hostname"), hostname=text("hostname"), form_submit_url=text("formSubmitURL"), username_field=text("usernameField"), times_used=number("timesUsed"), time_last_used=number("timeLastUsed"),
        time_password_changed=number("timePasswordChanged"), password=F.lit("ENCRYPTED"),
    )


def firefox_extensions(files: DataFrame) -> DataFrame:
    rows = _listed(files, "$.addons", "id:string,version:string,defaultLocale:struct<name:string>,installDate:bigint")
    name, version = F.coalesce("defaultLocale.name", F.lit("")), F.coalesce("version", F.lit(""))
    return events(rows, tm.unix_millis(F.coalesce("installDate", F.lit(0))), "Firefox", "Extensions", F.concat(name, F.lit(" v"), version), id=F.coalesce("id", F.lit("")), name=name, version=version)


def firefox_session(files: DataFrame) -> DataFrame:
    """The shown page of each open tab of session files: plain JSON, or compressed with the browser's LZ4 header."""
    rows = unpacked(files).select(F.col("path").alias("source"), F.col("content").cast("string").alias("json"))
    windows = "array<struct<tabs:array<struct<lastAccessed:bigint,entries:array<struct<url:string,title:string>>>>>>"
    tabs = rows.select("source", F.explode(F.from_json(F.get_json_object("json", "$.windows"), windows)).alias("w")).select("source", F.explode("w.tabs").alias("t"))
    tabs = tabs.where(F.size("t.entries") > 0).select("source", "t.lastAccessed", F.element_at("t.entries", -1).alias("e"))
    url, title = F.coalesce("e.url", F.lit("")), F.coalesce("e.title", F.lit(""))
    return events(tabs, tm.unix_millis(F.coalesce("lastAccessed", F.lit(0))), "Firefox", "Session", F.when(title == "", url).otherwise(title), url=url, title=title)
