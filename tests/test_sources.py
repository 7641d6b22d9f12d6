"""Readers over SQLite files made here."""

import json
import sqlite3

import pytest

from waylens.sources import readers, sqlite, writers

T = 11_644_473_600_000_000 + 1_300_000_000_000_000
NS = 1_300_000_000 * 10**9


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("home") / "Users" / "Ann" / "Default"
    folder.mkdir(parents=True)
    with sqlite3.connect(folder / "History") as db:
        db.executescript(f"""
        CREATE TABLE urls(id, url, title, visit_count, last_visit_time); CREATE TABLE visits(id, url, visit_time, from_visit, transition, visit_duration);
        CREATE TABLE downloads(id, target_path, start_time, total_bytes, state, danger_type); CREATE TABLE downloads_url_chains(id, chain_index, url);
        INSERT INTO urls VALUES (1, 'https://a.example/', 'A', 3, {T}), (2, 'https://b.example/', NULL, 1, 0);
        INSERT INTO visits VALUES (5, 1, {T}, NULL, {0x80000001 - 2**32}, NULL), (6, 2, {T}, 5, 0, 7), (7, 9, {T}, 0, 0, 0);
        INSERT INTO downloads VALUES (1, '/tmp/x.exe', {T}, 10, 1, 0), (2, '/tmp/y', {T}, 2, 1, 0); INSERT INTO downloads_url_chains VALUES (1, 0, 'https://d.example/'), (1, 1, 'https://e.example/');""")
        db.execute("PRAGMA journal_mode=WAL")
    with sqlite3.connect(folder / "places.sqlite") as db:
        db.executescript("""
        CREATE TABLE moz_places(id, url, title, visit_count, last_visit_date); CREATE TABLE moz_historyvisits(id, from_visit, place_id, visit_date, visit_type, session);
        INSERT INTO moz_places VALUES (1, 'https://f.example/', 'F', 2, 1300000000000000), (2, 'https://g.example/', '', 1, NULL);
        INSERT INTO moz_historyvisits VALUES (1, 0, 1, 1300000000000000, 5, 4);""")
    (folder / "broken").write_bytes(b"SQLite format 3\0junk")
    (folder / "prefs.js").write_text('# x\nuser_pref("a.b", "c");\nuser_pref("n", 5);\n')
    (folder / "Bookmarks").write_text(json.dumps({"roots": {"bar": {"type": "folder", "name": "Bar", "children": [{"type": "url", "name": "N", "url": "https://n.example/", "date_added": str(T)}]}}}))
    return str(folder)


def test_chromium(spark, files):
    history = readers.read(spark, "chromium_history", files).collect()
    assert [(r.timestamp_ns, r.description, r.attrs["url"]) for r in history] == [(NS, "[3 visits] A — https://a.example/", "https://a.example/")]
    visits = {json.loads(r.attrs_json)["visit_id"]: json.loads(r.attrs_json) for r in readers.read(spark, "chromium_visits", files).collect()}
    assert set(visits) == {5, 6}
    assert visits[5]["transition"] == "typed" and visits[5]["redirect_kind"] == "server" and visits[5]["from_visit"] == 0
    assert "redirect_kind" not in visits[6] and visits[6]["from_visit"] == 5
    downloads = sorted((r.description, r.attrs["url"]) for r in readers.read(spark, "chromium_downloads", files).collect())
    assert downloads == [("x.exe (10 bytes)", "https://d.example/"), ("y (2 bytes)", "")]
    assert readers.read(spark, "chromium_cookies", files).count() == 0


def test_firefox_and_texts(spark, files):
    assert [r.timestamp_ns for r in readers.read(spark, "firefox_history", files).collect()] == [NS]
    visit = json.loads(readers.read(spark, "firefox_visits", files).first()["attrs_json"])
    assert visit["transition"] == "redirect_permanent" and visit["is_redirect"] and visit["session"] == 4
    prefs = sorted((r.attrs["name"], r.attrs["value"]) for r in readers.firefox_preferences(spark, files + "/prefs.js").collect())
    assert prefs == [("a.b", "c"), ("n", "5")]
    marks = readers.chromium_bookmarks(sqlite.evidence_files(spark, files + "/Bookmarks")).collect()
    assert [(r.timestamp_ns, r.description, r.attrs["folder"]) for r in marks] == [(NS, "N", "/Bar")]


def test_discovery_integrity_and_export(spark, files, tmp_path):
    found = {(r.browser, r.profile, r.user) for r in readers.discover_profiles(sqlite.evidence_files(spark, files)).collect()}
    assert found == {("Chromium", "Default", "Ann"), ("Firefox", "Default", "Ann")}
    broken = sqlite.integrity_failures(sqlite.evidence_files(spark, files)).collect()
    assert [r.source.rpartition("/")[2] for r in broken] == ["broken"]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    written = writers.write_sqlite(rows.repartition(2, "a"), str(tmp_path / "out")).collect()
    assert sum(r.rows for r in written) == 2
    assert sorted(x for r in written for x in sqlite3.connect(r.path).execute("select a, b from timeline")) == [("1", "x"), ("2", None)]


def test_json_stores(spark):
    from waylens.sources import json_readers

    def files(value):
        return spark.createDataFrame([("p", bytearray(json.dumps(value).encode())), ("q", bytearray(b"{}"))], "path string, content binary")

    found = json_readers.permissions(files({"profile": {"content_settings": {"exceptions": {"geolocation": {"https://a.example:443,*": {"setting": 1, "last_modified": str(T)}}, "x": {"b": {}}}}}})).collect()
    assert sorted((r.timestamp_ns, json.loads(r.attrs_json)["setting"]) for r in found) == [(0, "unspecified"), (NS, "allow")]
    people = json_readers.profiles(files({"profile": {"info_cache": {"Default": {"name": "Ann", "user_name": "a@x.org", "active_time": 1300000000.5}}}})).collect()
    assert [(r.timestamp_ns, r.description) for r in people] == [(NS, "Profile Default: Ann (a@x.org)")]
    assert [r.attrs["host_hash"] for r in json_readers.transport_security(files({"sts": [{"host": "h1", "sts_observed": 1300000000.0}], "version": 2})).collect()] == ["h1"]
    assert [r.attrs["host_hash"] for r in json_readers.transport_security(files({"h2": {"expiry": 1}, "version": 1})).collect()] == ["h2"]


def test_more_chromium_tables(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db") as db:
        db.executescript(f"""
        CREATE TABLE credit_cards(name_on_card, expiration_month, expiration_year, date_modified, use_count, use_date, card_number_encrypted); INSERT INTO credit_cards VALUES ('A', 3, 2030, {T}, 1, 2, x'00');
        CREATE TABLE origin(origin, aggregate_watchtime_audio_video_s, last_updated_time_s); INSERT INTO origin VALUES ('https://m.example', 9, {T // 1_000_000});
        CREATE TABLE nel_policies(origin_host, group_name, last_access_us_since_epoch); INSERT INTO nel_policies VALUES ('n.example', 'g', {T});
        CREATE TABLE reporting_endpoints(origin_host, group_name, url); INSERT INTO reporting_endpoints VALUES ('n.example', 'g', 'https://R.example/x');
        CREATE TABLE bounces(site, last_site_storage_time, last_user_interaction_time); INSERT INTO bounces VALUES ('b.example', {T + 5}, {T}), ('c.example', {T}, NULL);""")
    path = str(tmp_path / "db")
    assert readers.read(spark, "chromium_cards", path).first()["description"] == "stored card: A (exp 03/2030)"
    assert [(r.timestamp_ns, r.description) for r in readers.read(spark, "chromium_media", path).collect()] == [(NS, "https://m.example — media origin (9s aggregate)")]
    assert sorted((r.timestamp_ns, r.attrs.get("report_to_host")) for r in readers.read(spark, "chromium_reporting", path).collect()) == [(0, "r.example"), (NS, None)]
    assert sorted((r.attrs["host"], r.timestamp_ns) for r in readers.chromium_bounces(sqlite.evidence_files(spark, path)).collect()) == [("b.example", NS), ("c.example", NS)]


def test_rows_in_the_log(spark, tmp_path):
    """Committed rows that only the write-ahead log has are read; rows of a transaction that never ended aren't."""
    import shutil

    folder = tmp_path / "copy"
    folder.mkdir()
    db = sqlite3.connect(tmp_path / "History", isolation_level=None)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE urls(id, url, title, visit_count, last_visit_time)")
    db.execute(f"INSERT INTO urls VALUES (1, 'https://a.example/', 'A', 1, {T})")
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    for i in range(2, 400):
        db.execute(f"INSERT INTO urls VALUES ({i}, 'https://b.example/{'x' * 300}', 'B', 1, {T})")
    db.execute("PRAGMA cache_spill=ON")
    db.execute("PRAGMA cache_size=1")
    db.execute("BEGIN")
    for i in range(400, 900):
        db.execute(f"INSERT INTO urls VALUES ({i}, 'https://c.example/{'x' * 300}', 'C', 1, {T})")
    for name in ("History", "History-wal"):
        shutil.copy(tmp_path / name, folder / name)
    db.close()
    found = readers.read(spark, "chromium_history", str(folder)).collect()
    assert sorted({r.attrs["title"] for r in found}) == ["A", "B"] and len(found) == 399


def test_lz4_blocks():
    from waylens.sources.binary import lz4_block

    assert lz4_block(b"\x50hello", 5) == b"hello"
    assert lz4_block(b"\x1fa\x01\x00\x05\x50hello", 1 + 4 + 15 + 5 + 5) == b"a" * 25 + b"hello"
    assert lz4_block(b"\x24ab\x02\x00\x10c", 11) == b"ab" + b"abababab" + b"c"
    for bad, size in ((b"\x50hel", 5), (b"\x10a\x09\x00", 5), (b"\x50hello", 4), (b"\xf0", 3)):
        with pytest.raises(ValueError):
            lz4_block(bad, size)


def test_session_logs(spark, tmp_path):
    import struct

    from waylens.sources.binary import chromium_session

    def record(kind, body):
        return struct.pack("<HB", len(body) + 1, kind) + body

    def navigation(tab, index, url, title):
        u, t = url.encode(), title.encode("utf-16-le")
        body = struct.pack("<iii", tab, index, len(u)) + u.ljust(-(-len(u) // 4) * 4, b"\0") + struct.pack("<i", len(title)) + t
        return record(6, struct.pack("<I", len(body)) + body)

    log = b"SNSS" + struct.pack("<i", 3)
    log += record(0, struct.pack("<ii", 7, 1)) + navigation(1, 0, "https://a.example/", "A") + navigation(1, 1, "https://bb.example/", "") + record(7, struct.pack("<ii", 1, 1)) + record(12, struct.pack("<i?", 1, True))
    log += record(0, struct.pack("<ii", 7, 2)) + navigation(2, 0, "https://gone.example/", "G") + record(16, struct.pack("<iiq", 2, 0, 0)) + record(21, struct.pack("<iiq", 1, 0, T))
    log += record(0, struct.pack("<ii", 8, 3)) + navigation(3, 0, "https://c.example/", "Ç") + record(99, b"?") + b"\xff\xff\x06cut"
    files = spark.createDataFrame([("d/Session_1", bytearray(log)), ("d/other", bytearray(b"no"))], "path string, content binary")
    got = sorted((r.timestamp_ns, r.description, r.attrs["tab_id"], r.attrs["window_id"], r.attrs["pinned"], r.attrs["index"]) for r in chromium_session(files).collect())
    assert got == [(0, "Ç", "3", "8", "false", "0"), (NS, "https://bb.example/", "1", "7", "true", "1")]


def test_property_lists_and_compressed_sessions(spark):
    import plistlib
    import struct

    from waylens.sources import binary, json_readers

    tree = {"WebBookmarkType": "WebBookmarkTypeList", "Children": [{"WebBookmarkType": "WebBookmarkTypeLeaf", "URLString": "https://s.example/", "URIDictionary": {"title": "S"}}]}
    files = spark.createDataFrame([("a", bytearray(plistlib.dumps(tree, fmt=plistlib.FMT_BINARY))), ("b", bytearray(b"broken"))], "path string, content binary")
    assert [(r.description, r.attrs["url"]) for r in binary.safari_bookmarks(files).collect()] == [("S", "https://s.example/")]
    body = json.dumps({"windows": [{"tabs": [{"lastAccessed": 1300000000000, "entries": [{"url": "https://x.example/", "title": ""}]}, {"entries": []}]}]}).encode()
    block = bytes([0xF0, *([255] * ((len(body) - 15) // 255)), (len(body) - 15) % 255]) + body
    files = spark.createDataFrame([("s", bytearray(b"mozLz40\0" + struct.pack("<I", len(body)) + block)), ("t", bytearray(b"mozLz40\0\x01"))], "path string, content binary")
    assert [(r.timestamp_ns, r.description) for r in json_readers.firefox_session(files).collect()] == [(NS, "https://x.example/")]


def test_leveldb_tables_and_broken_logs(spark):
    """A sorted table with shared key prefixes and a compressed block, and logs that end early."""
    import struct

    import pyarrow as pa

    from waylens.sources import leveldb

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def block(entries):
        out, before = b"", b""
        for key, value in entries:
            same = 0
            while same < min(len(before), len(key)) and before[same] == key[same]:
                same += 1
            out += number(same) + number(len(key) - same) + number(len(value)) + key[same:] + value
            before = key
        return out + struct.pack("<II", 0, 1)

    inner = lambda key, seq, put: key + struct.pack("<Q", seq << 8 | put)
    body = block([(inner(b"map-1-a", 9, 1), "vé".encode("utf-16-le")), (inner(b"map-1-b", 7, 0), b""), (inner(b"namespace-x-h.example", 3, 1), b"1")])
    packed = pa.Codec("snappy").compress(body).to_pybytes()
    data = packed + b"\1" + bytes(4)
    index = block([(inner(b"z", 1, 1), number(0) + number(len(packed)))])
    at = len(data)
    data += index + b"\0" + bytes(4)
    table = data + (number(0) + number(0) + number(at) + number(len(index))).ljust(40, b"\0") + struct.pack("<Q", leveldb.TABLE_END)
    files = spark.createDataFrame([("d/1.ldb", bytearray(table)), ("d/2.ldb", bytearray(b"short")), ("d/3.log", bytearray(b"\0\0\0\0\xff\x7f\1abc")), ("d/CURRENT", bytearray(b"x"))], "path string, content binary")
    got = sorted((bytes(r.key), None if r.value is None else bytes(r.value), r.seq, r.deleted) for r in leveldb.records(files).collect())
    assert got == [(b"map-1-a", "vé".encode("utf-16-le"), 9, False), (b"map-1-b", None, 7, True), (b"namespace-x-h.example", b"1", 3, False)]
    assert sorted((r.description, r.attrs["deleted"]) for r in leveldb.session_storage(files).collect()) == [("h.example — a = vé", "false"), ("h.example — b = ", "true")]


def test_cached_bodies():
    import gzip
    import zlib

    import zstandard

    from waylens.sources.cache import decode_body, simple_entry

    body = b"page " * 200
    raw = zlib.compressobj(wbits=-15)
    for encoding, data in (("", body), ("identity", body), ("GZip", gzip.compress(body)), ("deflate", zlib.compress(body)), ("deflate", raw.compress(body) + raw.flush()), ("zstd", zstandard.compress(body)), ("gzip, zstd", zstandard.compress(gzip.compress(body)))):
        assert decode_body(data, encoding) == (body, None), encoding
    assert decode_body(body, "br")[0] == body and "br" in decode_body(body, "br")[1]
    assert decode_body(b"broken", "gzip")[0] == b"broken" and decode_body(b"broken", "gzip")[1]
    bomb = gzip.compress(bytes(10_000_000))
    assert decode_body(bomb, "gzip")[0] == bomb and "beyond" in decode_body(bomb, "gzip")[1]
    assert simple_entry(b"x" * 100) is None and simple_entry(b"") is None
