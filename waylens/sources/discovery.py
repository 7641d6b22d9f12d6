"""Profiles in listings of files: below the browsers' usual folders of a home, and anywhere in an evidence tree.

A listing has ``path`` and, if the store tells, ``link``: whether the entry is a symbolic link. Neither links nor what lies below
them counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.functions import text as tx
from waylens.operators.ordering import with_largest_before
from waylens.plans.scratch import cut

#: The folders of browsers below a home, what they hold, and whose they are.
CHROMIUM_BASES = {
    "Library/Application Support/Google/Chrome": "Chrome", "Library/Application Support/Microsoft Edge": "Edge", "Library/Application Support/BraveSoftware/Brave-Browser": "Brave", "Library/Application Support/Vivaldi": "Vivaldi",
    "Library/Application Support/com.operasoftware.Opera": "Opera", "Library/Application Support/Arc/User Data": "Arc", "Library/Application Support/Chromium": "Chromium",
    ".config/google-chrome": "Chrome", ".config/microsoft-edge": "Edge", ".config/BraveSoftware/Brave-Browser": "Brave", ".config/vivaldi": "Vivaldi", ".config/opera": "Opera", ".config/chromium": "Chromium",
    "AppData/Local/Google/Chrome/User Data": "Chrome", "AppData/Local/Microsoft/Edge/User Data": "Edge", "AppData/Local/BraveSoftware/Brave-Browser/User Data": "Brave", "AppData/Local/Vivaldi/User Data": "Vivaldi",
    "AppData/Roaming/Opera Software/Opera Stable": "Opera", "AppData/Local/Chromium/User Data": "Chromium",
}
FIREFOX_BASES = ("Library/Application Support/Firefox/Profiles", ".mozilla/firefox", "AppData/Roaming/Mozilla/Firefox/Profiles")
#: Files that are a profile of their own at a fixed place: browser, brand, profile, folder, file.
SINGLE = (("Safari", "Safari", "Default", "Library/Safari", "History.db"), ("InternetExplorer", "IE", "WebCache", "AppData/Local/Microsoft/Windows/WebCache", "WebCacheV01.dat"))
#: Files and folders that mark a folder as a profile, and folders that embedded browsers keep.
CHROMIUM_MARKS = ("History", "Cookies", "Network/Cookies", "Login Data", "Web Data", "Local Storage/leveldb/")
FIREFOX_MARKS = ("places.sqlite", "cookies.sqlite", "formhistory.sqlite", "permissions.sqlite")
FIREFOX_SUFFIXES = (".jsonlz4", ".baklz4", ".mozlz4")
EMBEDDED = ("cache", "local storage", "indexeddb", "session storage", "extensions")
#: Programs that embed a browser: a folder's name in lower case, program, maker, kind. Callers may give their own.
APPS = (
    ("slack", "Slack", "Slack", "Electron"), ("discord", "Discord", "Discord", "Electron"), ("signal", "Signal", "Signal", "Electron"), ("spotify", "Spotify", "Spotify", "Cef"), ("ebwebview", "WebView2 host", "Microsoft", "WebView2"),
    ("code", "Visual Studio Code", "Microsoft", "Electron"), ("obsidian", "Obsidian", "Obsidian", "Electron"), ("steam", "Steam", "Valve", "Cef"),
)
DEPTH = 24
#: Tasks that what lies below one folder is dealt to: all paths have the topmost folders above them.
SPREAD = 64


def _without_links(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` of a listing (without them, its paths) whose ``path`` neither is a link nor lies below one.

    Links stand at a few depths, which one aggregation tells: of the folders above one of ``rows`` only those at these depths
    are looked up, and only paths that are as deep travel. All paths of a listing are put in order instead, no row a folder.
    """
    if "link" not in files.columns:
        return files.select("path") if rows is None else rows
    links = cut(files.where("link").select("path").distinct(), "links")
    if rows is None:
        listed = files.where(~F.coalesce("link", F.lit(False))).select("path", F.lit(None).cast("string").alias("__end"))
        return _outermost(listed.unionByName(links.select("path", _end(F.col("path")).alias("__end")))).where("__end IS NULL").drop("__end")
    depths = sorted(r[0] for r in links.select(F.size(F.split("path", "/"))).distinct().collect())  # a number a depth
    if not depths:
        return rows
    rows = cut(rows, "listed")  # read twice
    parts = F.split("path", "/")
    ups = F.filter(F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.when(d <= F.size(parts), F.array_join(F.slice(parts, F.lit(1), d), "/"))), lambda p: p.isNotNull())
    below = _below(rows.where(F.size(parts) >= depths[0]).select("path", F.explode(ups).alias("up")), links)
    return rows.join(below.select("path").distinct().hint("merge"), "path", "left_anti")  # texts that compress well: their size says little


def _below(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """``rows`` (``path, up``) whose ``up`` is a ``path`` of ``folders``. Only folders that are above one of ``rows`` are dealt out, and
    merged: a broadcast would hold SPREAD rows of each, whose file tells nothing of that."""
    above = folders.select(F.col("path").alias("up")).join(rows.select("up").distinct().hint("merge"), "up", "left_semi")
    dealt = above.select("up", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__part"))
    return rows.withColumn("__part", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int")).join(dealt.hint("merge"), ["up", "__part"], "left_semi")


def _end(path: Column) -> Column:
    """The first text behind all paths below ``path`` in the order of their bytes, each with a slash behind it."""
    return F.concat(path, F.lit("0"))  # the sign after the slash


def _outermost(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``path`` lies below no folder, nor is one of another row; those with ``__end`` are folders, once each.

    What lies below a folder follows it in order, up to its end, so the largest end of what stands before a path tells.
    """
    start = F.concat("path", F.lit("/"))
    placed = with_largest_before(rows.withColumns({"__start": start, "__plain": F.col("__end").isNull()}), ["__start", "__plain"], "__end", "__covered")
    return placed.where(F.coalesce("__covered", F.lit("")) <= F.col("__start")).drop("__start", "__plain", "__covered")


def ancestors(path: Column) -> Column:
    """The folders above a path, the topmost first; ``/`` and the empty path aren't among them."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/"))), lambda p: p != "")


def home_profiles(files: DataFrame) -> DataFrame:
    """``browser, brand, profile, path, home, user`` of profiles at the usual places below any home of a listing.

    A Chromium or Firefox profile is a folder right below its browser's base that holds the family's history; Safari and the
    WebCache have one place each. Repeated paths count once.
    """
    kinds = [("Chromium", brand, base, "base", "History", None) for base, brand in CHROMIUM_BASES.items()]
    kinds += [("Firefox", "Firefox", base, "base", "places.sqlite", None) for base in FIREFOX_BASES]
    kinds += [(browser, brand, place, "folder", mark, profile) for browser, brand, profile, place, mark in SINGLE]
    places = files.sparkSession.createDataFrame([(*k, k[2].rpartition("/")[2]) for k in kinds], "browser string, brand string, place string, at string, name string, fixed string, last string")
    listed = files.where(~F.coalesce("link", F.lit(False))) if "link" in files.columns else files
    own = listed.select("path").where(F.substring_index("path", "/", -1).isin(*{k[4] for k in kinds}))
    # split once: what is derived from a generated column isn't put into every filter that Spark infers
    own = own.select(F.inline(F.array(F.struct("path", F.split("path", "/").alias("parts"))))).select("path", F.element_at("parts", -1).alias("name"), F.try_element_at("parts", F.lit(-2)).alias("inside"), F.try_element_at("parts", F.lit(-3)).alias("above"))
    beside = F.col("name").isin(*{k[4] for k in kinds if k[3] == "folder"})
    own = own.select("path", "name", "inside", F.when(beside, F.col("inside")).otherwise(F.col("above")).alias("last"))
    # a place is looked up by its last folder, and all of it compared: no row for each folder above a file
    end = F.when(F.col("at") == "folder", F.concat(F.lit("/"), "place", F.lit("/"), "name")).otherwise(F.concat(F.lit("/"), "place", F.lit("/"), "inside", F.lit("/"), "name"))
    found = own.join(F.broadcast(places), ["name", "last"]).withColumn("end", end).where(F.endswith("path", "end"))
    folder, home = F.expr("left(path, length(path) - length(name) - 1)"), F.expr("left(path, length(path) - length(end))")
    found = found.select("browser", "brand", F.coalesce("fixed", "inside").alias("profile"), "path", folder.alias("folder"), home.alias("home"))
    # links are looked up for the files at such places only
    return _without_links(files, found).select("browser", "brand", "profile", F.col("folder").alias("path"), "home", tx.user_of(F.col("folder")).alias("user")).distinct()


def swept_containers(files: DataFrame, root: str, apps: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """``path, browser, name, app, vendor, kind`` of the topmost folders below ``root`` (and ``root`` itself) that are profiles or
    containers by what they hold, at most ``depth`` folders down.

    Marks of Chromium count before those of Firefox; a folder of neither is a container if it has a folder that embedded
    browsers keep and its path names one of ``apps`` (``token, app, vendor, kind``). What lies below a match is part of it: a
    match with another one among its ancestors goes, which the order of the paths tells.
    """
    spark = files.sparkSession
    apps = spark.createDataFrame(APPS, "token string, app string, vendor string, kind string") if apps is None else apps
    apps = apps.groupBy("token").agg(F.min(F.struct("app", "vendor", "kind")).alias("of"))
    root = root.rstrip("/")
    own = _without_links(files).where(F.startswith(F.col("path"), F.lit(root + "/"))).distinct()
    marks = []
    for rank, names in ((0, CHROMIUM_MARKS), (1, FIREFOX_MARKS)):
        for mark in names:
            ahead = F.regexp_extract("path", f"^(.*?)/{mark.replace('.', '[.]')}" + (".*$" if mark.endswith("/") else "$"), 1)
            marks.append(F.struct(ahead.alias("path"), F.lit(rank).alias("rank")))
    suffixed = F.lit(False)
    for s in FIREFOX_SUFFIXES:
        suffixed = suffixed | F.endswith(F.col("path"), F.lit(s))
    marks.append(F.struct(F.when(suffixed, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("").alias("path"), F.lit(1).alias("rank")))
    kept = F.filter(F.transform(ancestors(F.col("path")), lambda p: F.struct(F.when(F.lower(F.regexp_extract(p, "([^/]*)$", 1)).isin(*EMBEDDED), F.regexp_extract(p, "^(.*)/[^/]*$", 1)).otherwise("").alias("path"), F.lit(2).alias("rank"))), lambda m: m["path"] != "")
    found = own.select(F.explode(F.concat(F.array(*marks), kept)).alias("m")).select("m.*").where((F.col("path") == root) | F.startswith(F.col("path"), F.lit(root + "/")))
    found = cut(found.groupBy("path").agg(F.min("rank").alias("rank")).where(F.size(F.split("path", "/")) - len(root.split("/")) <= depth), "marked")  # read twice

    segments = found.select("path", F.posexplode(F.split(F.lower("path"), "/")).alias("at", "token"))
    named = segments.join(F.broadcast(apps) if apps.count() <= 100_000 else apps, "token").groupBy("path").agg(F.min_by("of", "at").alias("of"))
    matches = found.join(named.hint("merge"), "path", "left").where("rank < 2 OR of IS NOT NULL")
    browser = F.when(F.col("rank") == 1, "Firefox").otherwise("Chromium")
    kept = _outermost(matches.withColumn("__end", F.when(F.col("path") != "", _end(F.col("path")))))  # the empty path is above nothing
    return kept.select("path", browser.alias("browser"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "of.app", "of.vendor", "of.kind")
