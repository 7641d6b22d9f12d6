"""Binary browser files, decoded in tasks file by file: compressed JSON, session logs, property lists."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions import times as tm
from waylens.sources.batches import contents, gathered
from waylens.sources.readers import events

#: The header of compressed JSON, and the most bytes that a file may say it unpacks to.
LZ4_MAGIC, MOST = b"mozLz40\0", 256 << 20


def lz4_block(data: bytes, size: int) -> bytes:
    """An LZ4 block that unpacks to ``size`` bytes; ValueError if it doesn't."""
    out, at, n = bytearray(), 0, len(data)
    try:
        while at < n:
            token = data[at]
            at += 1
            literals = token >> 4
            if literals == 15:
                while True:
                    literals += (more := data[at])
                    at += 1
                    if more < 255:
                        break
            if at + literals > n or len(out) + literals > size:
                raise ValueError("literals beyond the end")
            out += data[at : at + literals]
            at += literals
            if at >= n:
                break
            back = data[at] | data[at + 1] << 8
            at += 2
            length = (token & 15) + 4
            if token & 15 == 15:
                while True:
                    length += (more := data[at])
                    at += 1
                    if more < 255:
                        break
            if not 0 < back <= len(out) or len(out) + length > size:
                raise ValueError("a copy from before the beginning, or beyond the end")
            start = len(out) - back
            piece = bytes(out[start : start + length])
            out += piece if len(piece) == length else (piece * (length // len(piece) + 1))[:length]
    except IndexError:
        raise ValueError("the block ends early") from None
    if len(out) != size:
        raise ValueError("another size than declared")
    return bytes(out)


def plain(content: bytes | None) -> bytes | None:
    """A content, unpacked if it begins with the LZ4 header; None if it's broken or over MOST."""
    if not content or content[:8] != LZ4_MAGIC:
        return content
    try:
        (size,) = struct.unpack("<I", content[8:12])
        return lz4_block(content[12:], size) if size <= MOST else None
    except (ValueError, struct.error):
        return None


def unpacked(files: DataFrame) -> DataFrame:
    """``path, content`` with files that begin with the LZ4 header unpacked; broken ones, and those over MOST, are left out."""
    schema = StructType.fromDDL("path string, content binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        return gathered(((path, own) for path, content in contents(batches) if (own := plain(content)) is not None), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


#: Commands of the session log that open tabs depend on, and of the log of recently closed tabs.
TAB_WINDOW, TAB_INDEX, PRUNED_BACK, NAVIGATION, SELECTED, PINNED, TAB_CLOSED, WINDOW_CLOSED, ACTIVE_TIME, PRUNED_FRONT, PRUNED = 0, 2, 5, 6, 7, 12, 16, 17, 21, 11, 24
TABS_NAVIGATION, TABS_SELECTED = 1, 4


def _pickled(body: bytes) -> tuple[int, int, str, str]:
    """Tab, index, url and title of a pickled navigation."""
    tab, index, n = struct.unpack_from("<iii", body, 4)
    at = 16
    url = body[at : at + n].decode("utf-8", "replace")
    at += -(-n // 4) * 4
    (m,) = struct.unpack_from("<i", body, at)
    return tab, index, url, body[at + 4 : at + 4 + 2 * m].decode("utf-16-le", "replace")


def replayed(data: bytes, closed_tabs: bool = False) -> list[tuple[int, int, int, str, str, bool, int]]:
    """Window, tab, index, url, title, pinned and time (WebKit microseconds) of each open tab's current navigation.

    Commands are replayed in order; a record that doesn't parse is passed over, a cut one ends the log.
    """
    if data[:4] != b"SNSS":
        return []
    pages: dict[int, dict[int, tuple[str, str]]] = {}
    window, current, pinned, active = {}, {}, set(), {}
    at = 8
    while at + 3 <= len(data):
        size, kind = struct.unpack_from("<HB", data, at)
        body = data[at + 3 : at + 2 + size]
        at += 2 + size
        if not size or at > len(data):
            break
        try:
            if kind == (TABS_NAVIGATION if closed_tabs else NAVIGATION):
                tab, index, url, title = _pickled(body)
                pages.setdefault(tab, {})[index] = (url, title)
            elif closed_tabs and kind == TABS_SELECTED:
                tab, index, _, when = struct.unpack_from("<iiiq", body.ljust(20, b"\0"))
                current[tab], active[tab] = index, when
            elif closed_tabs:
                continue
            elif kind == TAB_WINDOW:
                win, tab = struct.unpack_from("<ii", body)
                window[tab] = win
            elif kind == SELECTED:
                tab, index = struct.unpack_from("<ii", body)
                current[tab] = index
            elif kind == PINNED:
                tab, on = struct.unpack_from("<i?", body)
                (pinned.add if on else pinned.discard)(tab)
            elif kind == TAB_CLOSED:
                (tab,) = struct.unpack_from("<i", body)
                pages.pop(tab, None)
            elif kind == WINDOW_CLOSED:
                (win,) = struct.unpack_from("<i", body)
                for tab in [t for t, w in window.items() if w == win]:
                    pages.pop(tab, None)
            elif kind == ACTIVE_TIME:
                tab, _, when = struct.unpack_from("<iiq", body.ljust(16, b"\0"))
                active[tab] = when
            elif kind == PRUNED_BACK:
                tab, index = struct.unpack_from("<ii", body)
                pages[tab] = {i: p for i, p in pages.get(tab, {}).items() if i < index}
            elif kind == PRUNED_FRONT:
                tab, n = struct.unpack_from("<ii", body)
                pages[tab] = {i - n: p for i, p in pages.get(tab, {}).items() if i >= n}
                current[tab] = current.get(tab, 0) - n
            elif kind == PRUNED:
                tab, index, n = struct.unpack_from("<iii", body)
                pages[tab] = {i if i < index else i - n: p for i, p in pages.get(tab, {}).items() if not index <= i < index + n}
        except struct.error:
            continue
    out = []
    for tab, own in pages.items():
        if own:
            index = current.get(tab, max(own))
            if index not in own:
                continue
            out.append((window.get(tab, 0), tab, index, *own[index], tab in pinned, active.get(tab, 0)))
    return out


def chromium_session(files: DataFrame) -> DataFrame:
    """An event for each open tab of session logs; files named ``Tabs...`` are logs of recently closed tabs."""
    schema = StructType.fromDDL("source string, window_id int, tab_id int, idx int, url string, title string, pinned boolean, active bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        return gathered(((path, *tab) for path, content in contents(batches) for tab in replayed(content or b"", path.rpartition("/")[2].startswith("Tabs"))), arrow)

    rows = files.select("path", "content").mapInArrow(run, schema)
    latest = rows.groupBy("source", "window_id").agg(F.max("active").alias("last"))
    rows = rows.join(latest, ["source", "window_id"])
    ns = F.when(F.col("last") > 0, tm.webkit_micros(F.col("last"))).otherwise(0)
    return events(rows, ns, "Chromium", "Session", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")), url=F.col("url"), title=F.col("title"), tab_id=F.col("tab_id"), window_id=F.col("window_id"), pinned=F.col("pinned"), index=F.col("idx"))


def property_lists(files: DataFrame) -> DataFrame:
    """``path, json`` of property lists, XML or binary; others are left out. Dates and data become text."""
    schema = StructType.fromDDL("path string, json string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import json
        import plistlib

        def parsed():
            for path, content in contents(batches):
                try:
                    yield path, json.dumps(plistlib.loads(content), default=lambda x: x.hex() if isinstance(x, bytes) else str(x))
                except Exception:  # noqa: BLE001 - the parser raises errors of several modules for broken files
                    continue

        return gathered(parsed(), arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def safari_bookmarks(files: DataFrame) -> DataFrame:
    """Leaves of bookmark trees of any depth, walked in tasks file by file: a file is parsed once."""
    schema = StructType.fromDDL("source string, url string, title string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import json
        import plistlib

        shown = lambda x: x.hex() if isinstance(x, bytes) else str(x)

        def text(value) -> str:
            return value if isinstance(value, str) else "" if value is None else json.dumps(value, default=shown)

        def leaves():
            for path, content in contents(batches):
                try:
                    todo = [plistlib.loads(content)]
                except Exception:  # noqa: BLE001 - the parser raises errors of several modules for broken files
                    continue
                while todo:
                    node = todo.pop()
                    kind = node.get("WebBookmarkType") if isinstance(node, dict) else None
                    if kind == "WebBookmarkTypeLeaf":
                        named = node.get("URIDictionary")
                        yield path, text(node.get("URLString")), text(named.get("title") if isinstance(named, dict) else None)
                    elif kind == "WebBookmarkTypeList" and isinstance(node.get("Children"), list):
                        todo += reversed(node["Children"])

        return gathered(leaves(), arrow)

    found = files.select("path", "content").mapInArrow(run, schema)
    return events(found, F.lit(0), "Safari", "Bookmarks", F.col("title"), url=F.col("url"), title=F.col("title"))


def _entries(files: DataFrame, path: str, fields: str) -> DataFrame:
    rows = property_lists(files).select(F.col("path").alias("source"), F.explode(F.from_json(F.get_json_object("json", path), f"array<struct<{fields}>>")).alias("e"))
    return rows.select("source", "e.*")


def safari_downloads(files: DataFrame) -> DataFrame:
    rows = _entries(files, "$.DownloadHistory", "DownloadEntryURL:string,DownloadEntryPath:string,DownloadEntryDateAddedKey:double,DownloadEntryProgressTotalToLoad:bigint")
    url, path = F.coalesce("DownloadEntryURL", F.lit("")), F.coalesce("DownloadEntryPath", F.lit(""))
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    ns = tm.core_data_seconds(F.coalesce("DownloadEntryDateAddedKey", F.lit(0.0)))
    return events(rows, ns, "Safari", "Downloads", F.concat(F.when(name == "", path).otherwise(name), F.lit(" from "), url), url=url, path=path, total_bytes=F.coalesce("DownloadEntryProgressTotalToLoad", F.lit(0)))


def safari_extensions(files: DataFrame) -> DataFrame:
    rows = _entries(files, "$['Installed Extensions']", "`Bundle Directory Name`:string,Enabled:boolean")
    name = F.coalesce("`Bundle Directory Name`", F.lit(""))
    return events(rows, F.lit(0), "Safari", "Extensions", name, bundle_name=name, enabled=F.coalesce("Enabled", F.lit(False)))


def safari_top_sites(files: DataFrame) -> DataFrame:
    rows = _entries(files, "$.TopSites", "TopSiteURLString:string,TopSiteTitle:string").where("TopSiteURLString <> ''")
    url, title = F.col("TopSiteURLString"), F.coalesce("TopSiteTitle", F.lit(""))
    return events(rows, F.lit(0), "Safari", "History", F.when(title == "", url).otherwise(F.concat(title, F.lit(" -- "), url)), url=url, title=title, source_type=F.lit("topsites"))
