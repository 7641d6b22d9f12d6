"""Profiles: which browser a path belongs to, labels, selectors, and the origin of events and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylens.plans.model import attribute

#: Short names of browser families, what users call them, and files that tell a family.
SHORT = {"Chromium": "Chrome", "Firefox": "Firefox", "Safari": "Safari", "InternetExplorer": "IE", "EdgeLegacy": "EdgeLegacy"}
DISPLAY = {"InternetExplorer": "Internet Explorer", "EdgeLegacy": "Edge (Legacy)"}
ALIASES = {
    "Chromium": ("chrome", "chromium", "edge", "brave", "opera", "vivaldi", "arc"), "Firefox": ("firefox", "mozilla"), "Safari": ("safari",),
    "InternetExplorer": ("ie", "internetexplorer", "internet-explorer"), "EdgeLegacy": ("edge-legacy", "edgelegacy"),
}
SAFARI_FILES = ("history.db", "cookies.db", "downloads.plist", "bookmarks.plist")
CHROMIUM_FILES = ("history", "cookies", "login data", "web data", "bookmarks")
FIREFOX_ALONE = ("places.sqlite", "formhistory.sqlite")
FIREFOX_FILES = ("cookies.sqlite", "logins.json", "extensions.json", "sessionstore.jsonlz4")


def _table(values: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), c)


def detect_browser(path: Column) -> Column:
    """The family of a path of a known file below a folder of its maker; null if there is none."""
    name, whole = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), F.lower(path)
    vendor = whole.rlike("|".join(ALIASES["Chromium"]))
    return (
        F.when(whole.contains("safari") & name.isin(*SAFARI_FILES), "Safari").when(name.isin(*CHROMIUM_FILES) & vendor, "Chromium").when(name.isin(*FIREFOX_ALONE), "Firefox")
        .when(name.isin(*FIREFOX_FILES) & (whole.contains("firefox") | whole.contains("mozilla")), "Firefox")
    )


def browser_of_name(path: Column) -> Column:
    """The family that a bare file name tells alone."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(name == "history.db", "Safari").when(name.isin(*FIREFOX_ALONE, *FIREFOX_FILES), "Firefox")


def profile_label(browser: Column, name: Column) -> Column:
    return F.concat(_table(SHORT, browser), F.lit("/"), name)


def select_profiles(profiles: DataFrame, browser: str | None = None, profile: str | None = None, user: str | None = None) -> DataFrame:
    """Profiles (``browser, profile, path, user``) of a browser by any of its names, a profile by label or name, and a user
    by name or folder; ValueError for a selector that nothing matches, so that a typing error isn't an empty result."""
    label, display = F.lower(profile_label(F.col("browser"), F.col("profile"))), F.lower(F.concat(_table(DISPLAY, F.col("browser")), F.lit("/"), F.col("profile")))
    kept = profiles
    if browser is not None:
        family = next((f for f, names in ALIASES.items() if browser.lower() in names), None)
        if family is None:
            raise ValueError(f"unknown browser {browser!r}; try chrome, firefox, safari, edge or brave")
        kept = _some(kept, F.col("browser") == family, "browser", browser, profiles, F.col("browser"))
    if profile is not None:
        wanted = profile.lower()
        kept = _some(kept, (label == wanted) | (display == wanted) | (F.lower("profile") == wanted), "profile", profile, profiles, profile_label(F.col("browser"), F.col("profile")))
    if user is not None:
        wanted = user.lower()
        folders = F.transform(F.split("path", r"[/\\]"), F.lower)
        kept = _some(kept, (F.coalesce(F.lower("user") == wanted, F.lit(False))) | F.array_contains(folders, wanted), "user", user, profiles, F.col("user"))
    return kept


def _some(kept: DataFrame, test: Column, what: str, value: str, every: DataFrame, name: Column) -> DataFrame:
    found = kept.where(test)
    if found.isEmpty():
        present = [r[0] for r in every.select(name.alias("n")).where("n IS NOT NULL").distinct().orderBy("n").limit(50).collect()]
        raise ValueError(f"no {what} {value!r}; there are: {', '.join(present) or 'none'}")
    return found


def stamp_origin(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with ``source`` below a profile's ``path`` get ``origin_profile``, ``origin_browser`` and ``origin_user``; of nested
    profiles the deepest. The path's folders are the key, so this is an equi-join."""
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = profiles.select(F.col("path").alias("__at"), profile_label(F.col("browser"), F.col("profile")).alias("origin_profile"), _table(SHORT, F.col("browser")).alias("origin_browser"), F.col("user").alias("origin_user"))
    sources = rows.select("source").distinct()
    held = sources.select("source", F.explode(above).alias("__at")).join(known, "__at").groupBy("source").agg(F.max_by(F.struct("origin_profile", "origin_browser", "origin_user"), F.length("__at")).alias("o")).select("source", "o.*")
    return rows.join(held, "source", "left")


def prefer_visits(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Events with the flat history rows of each browser that has visits replaced by those visits."""
    families = visits.select("browser").distinct()  # five at most
    flat = (F.col("artifact") == "History")
    kept = events.where(~flat).unionByName(events.where(flat).join(F.broadcast(families), "browser", "left_anti"))
    return kept.unionByName(visits, allowMissingColumns=True)


def records(events: DataFrame, tabs: DataFrame | None = None) -> DataFrame:
    """What an assistant may see of Chromium events: ``url, title, kind, timestamp_ns, browser, source, is_redirect,
    chain_end``; kinds are visit, search (typed into the address bar) and open_tab."""
    def shaped(rows: DataFrame, kind: Column) -> DataFrame:
        flag = lambda k: F.coalesce(attribute(rows, k).cast("boolean"), F.lit(False))
        return rows.select(attribute(rows, "url").alias("url"), F.coalesce(attribute(rows, "title"), F.lit("")).alias("title"), kind.alias("kind"), "timestamp_ns", "browser", "source", flag("is_redirect").alias("is_redirect"), flag("chain_end").alias("chain_end"))

    kinds = F.when(F.col("artifact") == "History", "visit").when(F.col("artifact") == "Shortcut", "search").when(F.col("artifact") == "Session", "open_tab")
    seen = shaped(events.where("browser = 'Chromium' AND artifact IN ('History', 'Shortcut', 'Session')"), kinds)
    if tabs is not None:
        seen = seen.unionByName(shaped(tabs, F.lit("open_tab")))
    return seen.where("url <> ''")
