"""Term index, density-adaptive joins, byte windows, sweeps, style sheets, manifests and ordered sinks on small cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from waylens.operators import catalog, correlate, indicators, search
from waylens.sources import cache, discovery, manifest, ordered, safari_cache, stylesheets, windows


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# terms


def test_terms_of_any_length(spark):
    texts = ["https://a.example/x?q=1", "Grüße aus Köln", "aaaaaa", "ab", "", None, "needle in haystack", "\U0001f600 wide \U0001f600\U0001f601", "line\nbreak", "aaaaaa"]
    terms = ["a", "ab", "aaa", "aaaa", "needle", "üße ", "zzzz", "Köln", "example/x?q=1", "\U0001f600\U0001f601", "e\nbr", "", None, "needle", "NEEDLE", "b", "\U0001f600 wide"]
    rows = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "seq bigint, field string, text string")
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, x in enumerate(texts) if x for t in {t for t in terms if t} if t in x)
    for most in (search.BROADCAST_ROWS, 0):
        assert rows_of(search.term_matches(rows, listed, most), "seq", "term") == want
    assert search.term_matches(rows.limit(0), listed).count() == search.term_matches(rows, listed.limit(0)).count() == 0


def test_terms_from_a_file(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("# head\n\n  padded \n nbsp \npadded\n#x\nlast")
    assert rows_of(search.read_terms(spark, str(tmp_path / "terms.txt")), "term") == [("last",), ("nbsp",), ("padded",)]
    events = spark.createDataFrame([(1, 5, "Chromium", "History", "s", "a padded one", "u"), (2, 6, "Firefox", "Cookies", "s", "x", "the last")], "seq bigint, timestamp_ns bigint, browser string, artifact string, source string, description string, url string")
    many, few = (rows_of(h, "seq", "term", "match", "rule_id") for h in (search.find_many(events, search.read_terms(spark, str(tmp_path / "terms.txt"))), search.find_hits(events, ["padded", "last", "nbsp"])))
    assert many == few and len(many) == 2


# co-occurrence


@pytest.mark.parametrize("neighbours", [2, 5, 512])
def test_a_dense_moment_between_sparse_days(spark, neighbours):
    rng = random.Random(neighbours)
    window = 60
    times = [rng.randrange(0, 5000) for _ in range(60)] + [2000 + rng.randrange(0, 90) for _ in range(80)] + [3000] * 30 + [0, 0]
    rows = [(t, i, rng.choice("abcd") if rng.random() > 0.1 else None) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "timestamp_ns bigint, seq bigint, h string")
    timed = sorted((t, i, h) for t, i, h in rows if t and h)
    want: dict = {}
    for a, (t, _, h) in enumerate(timed):
        for u, _, g in timed[a + 1 : a + 1 + neighbours]:
            if u - t <= window and g != h:
                want[min(g, h), max(g, h)] = want.get((min(g, h), max(g, h)), 0) + 1
    got = correlate.cooccurrence(events, F.col("h"), window, neighbours)
    assert rows_of(got, "src", "dst", "weight") == sorted((*k, n) for k, n in want.items())
    assert correlate.cooccurrence(events.limit(0), F.col("h"), window).count() == 0


# raw bytes


def test_matches_across_the_ends_of_windows(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "in").mkdir()
    want_urls, want_cookies = [], []
    for name in ("a", "b"):
        data = b""
        for i in range(300):
            data += bytes(rng.choice(b"\0 \n") for _ in range(rng.randrange(1, 9)))
            if i % 7 == 0:
                want_cookies.append((name, len(data), f"k={i}"))
                data += f"Cookie: k={i} \r\n".encode()
            url = f"http://{name}{i}.example/" + "p" * rng.randrange(0, 30)
            want_urls.append((name, len(data), url))
            data += url.encode()
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "empty").write_bytes(b"")
    for window, task in ((64, 64), (64, 1000), (97, 97), (1 << 20, 1 << 20)):
        found = windows.read_windows(spark, "file://" + str(tmp_path / "in"), window=window, overlap=64, task_bytes=task)
        urls = indicators.url_matches(found).withColumn("source", F.substring("source", -1, 1))
        assert rows_of(urls, "source", "offset", "url") == sorted(want_urls)
        cookies = indicators.cookie_matches(found).withColumn("source", F.substring("source", -1, 1))
        assert rows_of(cookies, "source", "offset", "cookie") == sorted(want_cookies)
    whole = spark.createDataFrame([("m", b"http://x.example/\xff\0http://y.example/"), ("n", None)], "path string, content binary")
    assert rows_of(indicators.scanned_urls(whole), "source", "url") == [("m", "http://x.example/�"), ("m", "http://y.example/")]


# indicators


def test_mails_from_their_signs():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab.@-+ é") for _ in range(rng.randrange(0, 24)))
        assert list(indicators._mails(text)) == [(m.start(), m[0]) for m in re.finditer(indicators.EMAIL, text)]


def test_indicators_and_their_places(spark):
    text = "é 10.1.2.3 \U0001f600 a@b.example 4111111111111111 https://www.bing.com/search?q=x+y"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 100_000 + " 10.0.0.1")], "id bigint, text string")
    got = rows_of(indicators.all_indicators(rows).fillna(""), "id", "kind", "value", "offset", "note")
    at = lambda part: len(text[: text.index(part)].encode())
    assert got == [(1, "card", "4111111111111111", at("4111"), "Luhn-valid"), (1, "email", "a@b.example", at("a@b"), ""), (1, "ipv4", "10.1.2.3", 3, ""), (1, "search_term", "x y", at("https"), "Bing"), (4, "ipv4", "10.0.0.1", 100_001, "")]
    events = spark.createDataFrame([(7, 1, "Chromium", "History", "p", "saw 10.0.0.1", "https://a.example/?q=z")], "seq bigint, timestamp_ns bigint, browser string, artifact string, source string, description string, url string")
    found = indicators.in_order(indicators.event_indicators(events), "seq", "field")
    assert [(r.field, r.kind, r.value, r.offset) for r in found.collect()] == [("description", "ipv4", "10.0.0.1", 4), ("url", "search_term", "z", 0)]


# discovery


def test_sweep_stops_at_matches_links_and_depth(spark):
    deep = "/ev" + "/d" * 25
    paths = [
        ("/ev/a/History", False), ("/ev/a/b/places.sqlite", False), ("/ev/c/Network/Cookies", False), ("/ev/e/x.jsonlz4", False), (deep + "/History", False), (deep[:-2] + "/History", False),
        ("/ev/f/Slack/IndexedDB/1", False), ("/ev/g/Other/IndexedDB/1", False), ("/ev/h/History", True), ("/ev/i", True), ("/ev/i/History", False), ("/else/History", False), ("/ev/a/History", False),
    ]
    files = spark.createDataFrame(paths, "path string, link boolean")
    got = rows_of(discovery.swept_containers(files, "/ev/").fillna(""), "path", "browser", "name", "app")
    assert got == [("/ev/a", "Chromium", "a", ""), ("/ev/c", "Chromium", "c", ""), (deep[:-2], "Chromium", "d", ""), ("/ev/e", "Firefox", "e", ""), ("/ev/f/Slack", "Chromium", "Slack", "Slack")]
    assert rows_of(discovery.swept_containers(files.drop("link"), "/ev", depth=1), "path") == [("/ev/a",), ("/ev/c",), ("/ev/e",), ("/ev/h",), ("/ev/i",)]
    root = spark.createDataFrame([("/ev/places.sqlite",), ("/ev/x/History",)], "path string")
    assert rows_of(discovery.swept_containers(root, "/ev"), "path", "browser") == [("/ev", "Firefox")]
    assert discovery.swept_containers(root.limit(0), "/ev").count() == 0


def test_profiles_of_homes(spark):
    paths = ["/h/u/.config/chromium/Default/History", "/h/u/.config/chromium/History", "/h/u/Library/Safari/History.db", "/h/u/Library/Other/History.db", "/h/u/.mozilla/firefox/a.b/places.sqlite", ".config/chromium/D/History"]
    got = rows_of(discovery.home_profiles(spark.createDataFrame([(p,) for p in paths], "path string")), "browser", "profile", "home")
    assert got == [("Chromium", "Default", "/h/u"), ("Firefox", "a.b", "/h/u"), ("Safari", "Default", "/h/u")]


# style sheets


def test_cycles_of_random_graphs(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(14)}
        reach = {a: {a} for e in edges for a in e}
        for _ in reach:
            for a, b in edges:
                for r in reach.values():
                    if a in r:
                        r |= {b}
        direct = {(a, b) for a, b in edges if a in reach[b]}
        df = spark.createDataFrame(sorted(edges), "a string, b string")
        assert rows_of(stylesheets.cyclic_edges(df), "a", "b") == sorted(direct)
        nodes, left = stylesheets.layers(df)
        bad = {a for a, _ in edges if any(x in {p for p, _ in direct} for x in reach[a])}
        assert {a for a, _ in rows_of(left, "a", "b")} == bad

        def height(a, edges=edges):
            return 1 + max((height(b) for x, b in edges if x == a), default=-1)

        assert rows_of(nodes, "node", "layer") == sorted((a, height(a)) for a in {a for a, _ in edges} - bad)


def test_sheets_within_a_budget(spark):
    body = lambda s: s.encode()
    rows = [
        ("https://s/a.css", "text/css; charset=utf-8", body('@import "b.css"; x{y:url(i.png)} z{y:url(gone.png)}')), ("https://s/b.css", "text/css", body("b{c:url('i.png')}")), ("https://s/i.png", "image/png", b"PNG"),
        ("https://s/self.css", "text/css", body('@import "self.css";')), ("https://s/none.css", "text/css", None),
    ]
    index = spark.createDataFrame([(u, u, t, b) for u, t, b in rows], "key string, url string, content_type string, body binary")
    png = "data:image/png;base64,UE5H"
    b_css = f"b{{c:url('{png}')}}"
    import base64

    a_css = f'@import "data:text/css;base64,{base64.b64encode(b_css.encode()).decode()}"; x{{y:url({png})}} z{{y:url(gone.png)}}'
    done, gaps = stylesheets.inlined_sheets(index)
    assert dict(rows_of(done, "key", "text")) == {"https://s/a.css": a_css, "https://s/b.css": b_css, "https://s/self.css": '@import "self.css";', "https://s/none.css": ""}
    assert rows_of(gaps, "sheet", "ref", "reason") == [("https://s/a.css", "gone.png", "missing"), ("https://s/self.css", "self.css", "cycle")]
    done, gaps = stylesheets.inlined_sheets(index, budget=8)
    assert dict(rows_of(done, "key", "text"))["https://s/a.css"].startswith('@import "b.css"') and ("https://s/a.css", "b.css", "budget") in rows_of(gaps, "sheet", "ref", "reason")
    page = spark.createDataFrame([(1, "https://s/", '<link rel="stylesheet" href="b.css"><img src="i.png">'), (2, "https://s/", None)], "page_id bigint, url string, html string")
    html = dict(rows_of(cache.with_local_copies(page, index).fillna(""), "page_id", "html"))
    assert html[1] == f'<link rel="stylesheet" href="data:text/css;base64,{base64.b64encode(b_css.encode()).decode()}"><img src="{png}">' and html[2] == ""
    assert stylesheets.inlined_sheets(index.limit(0))[0].count() == 0


# manifests and ordered sinks


def test_manifest_of_a_large_file(spark, tmp_path):
    import hashlib

    big, size = tmp_path / "in" / "big", 3 << 30
    big.parent.mkdir()
    with big.open("wb") as f:
        f.truncate(size)
    (tmp_path / "in" / "small").write_bytes(b"abc")
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    listing = manifest.listed(spark, str(tmp_path / "in"))
    found = {r.path.rpartition("/")[2]: r for r in manifest.manifest(listing.unionByName(spark.createDataFrame([("/nowhere/gone", 1, None), (None, 1, None)], listing.schema))).collect()}
    assert found["big"].sha256 == digest.hexdigest() and found["big"].size_bytes == size
    assert found["small"].md5 == hashlib.md5(b"abc").hexdigest() and found["small"].error is None
    assert found["gone"].sha256 is None and found["gone"].size_bytes == 0 and "FileNotFound" in found["gone"].error and len(found) == 3


def test_manifests_compared(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    before, after = frame([("a", "1"), ("b", "1"), ("c", "1"), ("e", None), ("a", "1")]), frame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")])
    assert rows_of(manifest.compared(before, after), "path", "status") == [("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added"), ("e", "unreadable")]


def test_bundle(spark, tmp_path):
    folder = f"file://{tmp_path}/bundle-1"
    lines = spark.range(1000).select("id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    written = manifest.write_bundle(folder, {"timeline": (lines, ["id"]), "other": (lines.where("id < 3"), [F.desc("id")])})
    sums = [r.line for r in ordered.read_ordered(spark, folder + "/SHA256SUMS").orderBy("file", "at").collect()]
    assert sums == sorted((f"{r.sha256}  {r.path}" for r in written.collect()), key=lambda x: x.split("  ")[1]) and len(sums) >= 2
    assert [r.line for r in ordered.read_ordered(spark, folder + "/timeline").orderBy("file", "at").collect()] == [f"l{i}" for i in range(1000)]
    assert [r.line for r in ordered.read_ordered(spark, folder + "/other").orderBy("file", "at").collect()] == ["l2", "l1", "l0"]


def test_ordered_lines(spark, tmp_path):
    rows = spark.range(5000, numPartitions=7).select(F.pmod(F.hash("id"), F.lit(100)).alias("k"), "id").withColumn("line", F.when(F.col("id") != 77, F.concat_ws("-", "k", "id")))
    folder = f"file://{tmp_path}/out"
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        ordered.write_ordered(rows, folder, ["k", F.desc("id")], header="head", suffix="csv")
    finally:
        spark.conf.unset(merging)
    got = [r.line for r in ordered.read_ordered(spark, folder).orderBy("file", "at").collect()]
    want = [r.line or "" for r in rows.orderBy("k", F.desc("id")).collect()]
    assert got == ["head", *want]
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert all(re.fullmatch(r"part-\d{6}\.csv", n) for n in names) and len(names) > 1
    ordered.write_ordered(rows.limit(0), f"file://{tmp_path}/none", ["k"])
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception):  # noqa: B017
        ordered.write_ordered(bad, f"file://{tmp_path}/out", ["id"])
    assert not list(tmp_path.rglob("part-*"))


# Safari's cache, the catalog


def test_responses_that_do_not_parse(spark):
    import plistlib

    good = plistlib.dumps({"Array": ["a", "b", 1.5, 404, {"Content-Encoding": "gzip", "Content-Type": "x/y"}]}, fmt=plistlib.FMT_BINARY)
    rows = spark.createDataFrame([(1, good), (2, b"junk"), (3, None), (4, plistlib.dumps({"Array": []}))], "id int, o binary")
    got = {r.id: r.f for r in rows.select("id", safari_cache.response_facts("o").alias("f")).collect()}
    assert tuple(got[1]) == (404, "x/y", "gzip") and all(tuple(got[i]) == (None, None, None) for i in (2, 3, 4))


def test_keys_of_mixed_types(spark):
    rows = [("History", '{"a": 1, "b": "x"}'), ("History", '{"a": 1.5, "c": [1]}'), ("History", "{}"), ("Cookies", None), ("Cookies", '{"q\\"t": true, "n": null}')]
    events = spark.createDataFrame(rows, "artifact string, attrs_json string")
    got = rows_of(catalog.artifact_keys(events), "artifact", "key", "type", "n", "required")
    assert got == [("Cookies", 'q"t', "BOOLEAN", 1, False), ("History", "a", "DECIMAL(21,1)", 2, False), ("History", "b", "STRING", 1, False), ("History", "c", "ARRAY<BIGINT>", 1, False)]
    import json

    schemas = {r.artifact: json.loads(r.line) for r in catalog.json_schemas(events).collect()}
    assert schemas["History"]["properties"]["attrs"]["properties"]["a"] == {"type": "number"} and 'q"t' in schemas["Cookies"]["properties"]["attrs"]["properties"]
    known = {r.artifact: r for r in catalog.catalog(events).collect()}
    assert known["History"]["events"] == 3 and known["Bookmarks"]["events"] == 0 and known["Bookmarks"]["keys"] == []
