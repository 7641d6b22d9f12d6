"""What only larger or odd tables show: each query against its SQL over tables made for it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import ORACLE_SQL, QUERIES


@pytest.fixture
def with_events(sf, tmp_path):
    """Makes a folder of the smallest tables whose events have the given numbers."""
    def make(numbers):
        events = pq.read_table(f"{sf}/events.parquet")
        rows = events.take(pa.array([i % len(events) for i in range(len(numbers))]))
        pq.write_table(rows.set_column(0, "event_id", pa.array(numbers, pa.int64())), tmp_path / "events.parquet")
        (tmp_path / "pages.parquet").symlink_to(f"{sf}/pages.parquet")
        return str(tmp_path)

    return make


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    found = con.sql(ORACLE_SQL[name])
    at = [found.columns.index(c) for c in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    return got


def test_extension_versions_are_numbers(spark, with_events):
    assert len(same(spark, with_events(list(range(629_300, 630_700))), "read_chromium_extensions")) == 700


def test_extension_version_order(spark):
    from waylens.sources.json_readers import chromium_extensions

    folders = {"a": ("1.9.0_0", "1.10.0_0", "1.2"), "b": ("999", "1000"), "c": ("2.0", "2.0.1"), "d": ("Temp", "3_0")}
    files = [(f"u/Extensions/{k}/{v}/manifest.json", bytearray(f'{{"name": "{k}", "version": "{v}"}}'.encode())) for k, own in folders.items() for v in own]
    rows = spark.createDataFrame(files, "path string, content binary").selectExpr("*", "timestamp '2024-01-01' AS modificationTime")
    assert {(r["attrs"]["id"], r["attrs"]["version"]) for r in chromium_extensions(rows).collect()} == {("a", "1.10.0_0"), ("b", "1000"), ("c", "2.0.1"), ("d", "3_0")}


def test_local_storage_times_of_large_numbers(spark, with_events):
    assert len(same(spark, with_events(list(range(2_097_100, 2_097_200))), "read_chromium_local_storage")) == 101


def test_routed_reads_only_what_is_there(spark, with_events):
    """A profile's tables are read from folders of their own, and absent files cost no scan."""
    import re

    from waylens import reader_queries as rq
    from waylens.sources.dispatch import read_all

    events = read_all(rq.profile_files(spark, with_events(list(range(20_000))), ("chromium_visits",)))
    plan = events._jdf.queryExecution().optimizedPlan()
    assert len(re.findall("Relation ", plan.toString())) == 2
    assert events.count() > 15_000


def test_readers_of_files_pass_on_as_they_go():
    """A task holds one content and a bounded batch of results, however many files Spark hands it at once."""
    from waylens.sources.batches import BYTES, contents, gathered

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    batch = pa.record_batch([pa.array([f"p{i}" for i in range(40)]), pa.array([bytes([i]) * 300_000 for i in range(40)])], schema=schema)
    out = []
    for made in gathered(contents([batch]), schema):
        assert made.nbytes < 2 * BYTES
        out += made.to_pylist()
    assert out == batch.to_pylist()
    many = list(gathered(((str(i), None) for i in range(10_000)), schema))
    assert [b.num_rows for b in many] == [4096, 4096, 1808]


def test_sqlite_files_of_bounded_size(spark, tmp_path):
    """A large partition is several files, and equal rows in several files are all kept."""
    import sqlite3

    from waylens.sources.writers import write_sqlite

    rows = spark.range(0, 80_000, 1, 2).selectExpr("repeat('x', 50) AS a")
    found = write_sqlite(rows, str(tmp_path / "out"), most=1 << 19).collect()
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == len(found) > 4 and max(f.stat().st_size for f in files) < 1 << 20
    assert sum(sqlite3.connect(f).execute("SELECT count(*) FROM timeline").fetchone()[0] for f in files) == 80_000


def test_deep_safari_bookmarks(spark):
    """A tree of 100 folders: before, levels beyond the 64th were left out, and each level parsed all files again."""
    from waylens.sources.binary import safari_bookmarks

    leaf = "<dict><key>WebBookmarkType</key><string>WebBookmarkTypeLeaf</string><key>URLString</key><string>https://a/</string><key>URIDictionary</key><dict><key>title</key><string>t</string></dict></dict>"
    tree = leaf
    for _ in range(100):
        tree = f"<dict><key>WebBookmarkType</key><string>WebBookmarkTypeList</string><key>Children</key><array>{tree}{leaf}</array></dict>"
    files = spark.createDataFrame([("p", bytearray(f"<plist>{tree}</plist>".encode())), ("q", bytearray(b"<plist><dict>"))], "path string, content binary")
    events = safari_bookmarks(files)
    assert events.count() == 101
    assert events._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_terms_are_looked_for_once_in_a_text(spark):
    """Many events of few texts: the index sees each text once, and one searched column needs no table of hits."""
    from waylens.operators import search

    events = spark.range(0, 2000, 1, 4).selectExpr("id AS seq", "id AS timestamp_ns", "'Firefox' AS browser", "'History' AS artifact", "concat('https://h', id % 10, '.example/') AS url", "concat('h', id % 10, '.example page') AS description", "'p' AS source")
    terms = spark.createDataFrame([("h1.exam",), ("example",), ("/",), ("nowhere",)], "term string")
    seen = []
    own, search.term_matches = search.term_matches, lambda texts, *a: seen.append(texts.count()) or own(texts, *a)
    try:
        one = search.find_many(events, terms, ["url"])
        two = search.find_many(events, terms, ["url", "description"])
        none = search.find_many(events, terms, ["browser"])
    finally:
        search.term_matches = own
    assert (one.count(), two.count(), none.count()) == (4200, 4200, 0) and one.select("seq", "term").distinct().count() == 4200
    assert seen == [10, 20, 0]


def test_top_folder_is_dealt_out(spark):
    """All paths have the topmost folder above them: what lies below it isn't one task's rows."""
    from waylens.sources import discovery

    rows = spark.range(0, 6400, 1, 4).selectExpr("concat('/ev/', id) AS path", "IF(id % 2 = 0, '/ev', '/other') AS up")
    kept = discovery._below(rows, spark.createDataFrame([("/ev",)], "path string"))
    assert kept.count() == 3200 and kept.groupBy("up", "__part").count().selectExpr("max(count)").first()[0] < 100

    files = spark.createDataFrame([("/ev/a/places.sqlite", False), ("/ev/l", True), ("/ev/l/places.sqlite", False), ("/ev/a/b/Cookies", False)], "path string, link boolean")
    assert [(r["path"], r["browser"]) for r in discovery.swept_containers(files, "/ev").collect()] == [("/ev/a", "Firefox")]


def test_options_of_a_search_are_taken_from_one_list_of_pairs():
    """A URL is taken apart once, not for each option that may stand in it."""
    from pyspark.sql import functions as F

    from waylens.functions import urls as ur

    assert str(ur.google_search(F.col("url"))).count("split(") <= 2
    assert str(ur.search_query(F.col("url"))).count("split(") <= 2


def test_a_text_is_searched_from_signs():
    """Each way to find candidates gives what the plain patterns give, and tests of sums what their definitions give."""
    import random
    import re

    from waylens.operators import indicators as ind

    plain = {
        "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "card": r"\b[0-9]{13,19}\b", "eth": r"\b0x[0-9a-fA-F]{40}\b", "btc_base58": r"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b", "btc_bech32": r"\b(?i:bc1)[0-9A-Za-z]{11,87}\b",
        "ipv6": r"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![0-9A-Fa-f:])",
    }
    draw = random.Random(3)
    parts = ["1", "3", "10.0.7", ".", "255", ":", "::", "fe80", "a", "0x", "bc1", "BC1", "é", "_", " ", "-", "١", "4" * 13, "q" * 25, "ab" * 20, "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", ":" * 39, "0"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 9)))
        for kind, pattern in plain.items():
            assert list(ind.KINDS[kind][1](text)) == [(m.start(), m[0]) for m in re.finditer(pattern, text)], (kind, text)
    for n in range(3000):
        digits = str(n * 7919).zfill(13)
        assert ind._luhn(digits) == ((sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0)


def test_urls_of_indicators_are_interpreted_once(spark):
    from waylens.operators import indicators

    found = indicators.all_indicators(spark.createDataFrame([(1, "https://www.bing.com/?q=a 10.0.0.1")], "seq bigint, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("duckduckgo") == 1
    assert sorted((r["kind"], r["value"], r["offset"], r["note"]) for r in found.collect()) == [("ipv4", "10.0.0.1", 26, None), ("search_term", "a", 0, "Bing")]


def test_ordered_lines_are_made_and_sorted_once(spark, tmp_path):
    """What makes the lines runs once, not for the sample of the ranges too, and their places need no second sort."""
    from waylens.sources import ordered

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 40_000, 1, 4).selectExpr("id * 7919 % 40000 AS k", "concat('l', id * 7919 % 40000) AS line").mapInArrow(run, "k bigint, line string")
    ordered.write_ordered(rows, f"file://{tmp_path}/out", ["k"])
    assert made.value == 40_000
    placed = ordered.read_placed(spark, f"file://{tmp_path}/out")
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.selectExpr("count(*)", "count_if(line = concat('l', rank))", "max(rank)").first() == (40_000, 40_000, 39_999)


def test_pairs_of_hosts_are_counted_in_blocks(spark, monkeypatch):
    """No row a pair: blocks of events give counts, whether hosts are few or many, times dense, sparse or equal."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from waylens.operators import correlate

    monkeypatch.setattr(correlate, "BLOCK", 50)
    monkeypatch.setattr(correlate, "CELLS", 400)
    draw = random.Random(5)
    for hosts, span in ((4, 300), (90, 300), (90, 100_000), (1, 300)):
        rows = [(draw.randint(1, span), i, f"h{draw.randrange(hosts)}") for i in range(700)]
        got = correlate.cooccurrence(spark.createDataFrame(rows, "timestamp_ns bigint, seq bigint, host string"), F.col("host"), 20, 30)
        rows.sort()
        expected = Counter()
        for i, (t, _, h) in enumerate(rows):
            for t2, _, h2 in rows[i + 1 : i + 31]:
                if t2 - t <= 20 and h != h2:
                    expected[min(h, h2), max(h, h2)] += 1
        assert {(r["src"], r["dst"]): r["weight"] for r in got.collect()} == expected
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the ranges' places


def test_graph_follows_no_chains(spark):
    """The graph needs each visit's referrer, not its depth: no round of doubling is written."""
    from pyspark.sql import functions as F

    from waylens.operators import correlate, visits
    from waylens.plans import scratch

    rows = [(i, i * 10, "Firefox", "p", i, (i - 1) if i % 40 else 39 + i, f"https://h{i % 7}.example/", i % 3 == 0) for i in range(1, 200)] + [(900, 5, "Firefox", "q", None, 7, None, False), (901, 6, "Firefox", "p", 12, 0, "https://again.example/", False)]
    events = spark.createDataFrame(rows, "seq bigint, timestamp_ns bigint, browser string, profile string, visit_id bigint, from_visit bigint, url string, is_redirect boolean")
    plain = visits.referrers(events)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, visits.referrer_chains(events).drop("nav_depth").collect()), key=repr)

    from waylens import queries

    before = len(scratch._written)
    queries.QUERIES["entity_graph_edges"](spark, "/root/testdata/sf0.001")
    names = {p.rpartition("/")[2].rpartition("-")[0] for p in scratch._written[before:]}
    assert "graph-events" in names and not names & {"links", "hops"}


def test_links_are_looked_up_at_their_depths(spark):
    """Of the folders above a path only those as deep as a link travel, and only of files that may be a profile."""
    from pyspark.sql import functions as F

    from waylens.sources import discovery

    paths = [("/h/a/.config/opera/Default/History", False), ("/h/b/.config/opera/Default/History", False), ("/h/b/.config", True), ("/h/c/.config/opera/Default/History", True), ("/h/c/.config/opera/Default/History", False), ("/h/d/.config/opera/Default/History", None)]
    files = spark.createDataFrame(paths + [(f"/h/a/x/y/z/w/v/{i}", False) for i in range(50)], "path string, link boolean")
    looked = []
    own, discovery._below = discovery._below, lambda rows, folders: looked.append(rows.count()) or own(rows, folders)
    try:
        assert sorted(r["home"] for r in discovery.home_profiles(files).collect()) == ["/h/a", "/h/d"]
        assert discovery.home_profiles(files.withColumn("link", F.lit(False))).count() == 4
        assert {r["path"].split("/")[2] for r in discovery._without_links(files).where("path LIKE '%opera%'").collect()} == {"a", "d"}
    finally:
        discovery._below = own
    assert looked[0] == 8  # the folder and the file itself of the four that aren't links


def test_plain_files_pass_by_python(spark, monkeypatch):
    """Of a profile's files only databases, and files with a log, are a task's Python objects."""
    from waylens.sources import dispatch

    files = spark.createDataFrame([("u/Network/Network Persistent State", bytearray(b'{"net":{"http_server_properties":{"servers":[{"server":"https://a.example"}]}}}')), ("u/SiteSecurityServiceState.txt", bytearray(b"b.example:HSTS\t0\t19000\t1,1,0")), ("u/SiteSecurityServiceState.txt-shm", bytearray(b"x")), ("u/DIPS", bytearray(b"SQLite format 3 broken"))], "path string, content binary")
    seen = []
    own = type(files).mapInArrow

    def watched(self, function, schema, **options):
        if "route" in self.columns:
            seen.append([r["path"] for r in self.select("path").collect()])
        return own(self, function, schema, **options)

    monkeypatch.setattr(type(files), "mapInArrow", watched)
    assert sorted((r["domain"], r["source"]) for r in dispatch.recovered_domains(files).collect()) == [("a.example", "u/Network/Network Persistent State"), ("b.example", "u/SiteSecurityServiceState.txt")]
    assert seen == [[]]


def test_profiles_are_looked_up_without_a_row_a_folder(spark):
    """A file is compared with the places of its last folder only, and odd signs in the folders above don't matter."""
    from waylens.functions.text import user_of
    from waylens.sources import discovery

    paths = ["/h/a\nb/.config/opera/Default/History", ".config/opera/Default/History", "/.config/opera/Default/History", "/h/x.config/opera/Default/History", "/h/.config/opera//History", "/h/.config/opera/History", "opera/Default/History", "History", "", "/Users/ü/Library/Safari/History.db", "/q/Library/Safari/p/History.db", "/Users/n/home/m/AppData/Local/Chromium/User Data/P 1/History", "/z/.mozilla/firefox/History"]
    files = spark.createDataFrame([(p,) for p in paths] * 2, "path string")
    found = discovery.home_profiles(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode") == 0
    assert sorted(map(tuple, found.collect())) == [
        ("Chromium", "Chromium", "P 1", "/Users/n/home/m/AppData/Local/Chromium/User Data/P 1", "/Users/n/home/m", "m"), ("Chromium", "Opera", "", "/h/.config/opera/", "/h", None), ("Chromium", "Opera", "Default", "/.config/opera/Default", "", None),
        ("Chromium", "Opera", "Default", "/h/a\nb/.config/opera/Default", "/h/a\nb", None), ("Safari", "Safari", "Default", "/Users/ü/Library/Safari", "/Users/ü", "ü"),
    ]
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([("C:\\Users\\a\\x",), ("home/b",), ("/xhome/b",), ("/HOME//b/users/c",), ("/users/",), ("/home/a\n/users/d",), ("",), (None,)], "p string")
    plain = F.regexp_extract("p", r"(?i)^.*(?:^|[/\\])(?:users|home)[/\\]([^/\\]+)", 1)
    assert texts.select(user_of(F.col("p")).eqNullSafe(F.when(plain != "", plain)).alias("x")).where("NOT x").count() == 0


def test_tamper_rules_share_their_passes(spark, monkeypatch):
    """One order of the visits, one join with the URLs, and headers of 100 bytes instead of the files."""
    from waylens import case_queries
    from waylens.operators import integrity

    ordered, contents = [], []
    previous, pages = integrity.with_previous, integrity.page_anomalies
    monkeypatch.setattr(integrity, "with_previous", lambda *a, **k: ordered.append(a) or previous(*a, **k))
    monkeypatch.setattr(integrity, "page_anomalies", lambda files: contents.extend(r[0] for r in files.selectExpr("max(length(content))").collect()) or pages(files))
    found = case_queries.QUERIES["tamper_indicators"](spark, "/root/testdata/sf0.001")
    assert len(ordered) == 1 and contents == [100]
    urls, visits = spark.createDataFrame([("a", 1, 2, 5), ("a", 2, 0, 7), ("a", 3, 1, 0), ("b", 1, 1, 9)], "db string, id bigint, visit_count bigint, last_visit bigint"), spark.createDataFrame([("a", 1, 1, 5), ("a", 4, 2, 8), ("a", 5, 2, 3), ("b", 9, None, 1)], "db string, id bigint, url_id bigint, ts bigint")
    for got, plain in zip((*integrity.visit_mismatches(urls, visits), *integrity.gaps_and_reversals(visits)), (integrity.visit_count_mismatches(urls, visits), integrity.last_visit_mismatches(urls, visits), integrity.id_gaps(visits), integrity.time_reversals(visits)), strict=True):
        assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) != []
    assert found.count() > 0


def test_stores_hold_values_of_all_types(spark):
    """Whole numbers, beyond 2^53 too, and texts aren't made JSON; other types are what their JSON says."""
    import sqlite3

    from fixtures import stores

    rows = spark.sql("SELECT 1 AS store, * FROM VALUES (9007199254740993L, 'é', true, 1.50BD, 2.5D, 3Y), (NULL, NULL, NULL, NULL, NULL, NULL) AS t(a, b, c, d, e, f)")
    files = stores.sqlite_stores([("t", rows), ("u", spark.range(3).selectExpr("1 AS store", "CAST(id AS STRING) AS only")), ("t", rows), ("v", rows.where("store = 2"))])
    [(path, content)] = [tuple(r) for r in files.collect()]
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(content))
    assert path == "profile/1" and [r[0] for r in db.execute("SELECT name FROM sqlite_master ORDER BY 1")] == ["t", "u"]
    assert sorted(db.execute("SELECT * FROM t"), key=repr) == [(9007199254740993, "é", 1, 1.5, 2.5, 3)] * 2 + [(None,) * 6] * 2
    assert sorted(db.execute("SELECT * FROM u")) == [("0",), ("1",), ("2",)]


def test_no_folder_is_broadcast(spark, tmp_path):
    """Folders that are dealt to 64 tasks are merged, though the file that names them is small, and only those above a path are."""
    from waylens.sources import discovery

    spark.range(2000).selectExpr("concat('/l/', id) AS path").write.parquet(f"{tmp_path}/links")
    rows = spark.range(0, 40, 1, 4).selectExpr("concat('/l/', id % 2, '/', id) AS path", "concat('/l/', id % 2) AS up")
    kept = discovery._below(rows, spark.read.parquet(f"{tmp_path}/links"))
    assert kept.count() == 40 and "Broadcast" not in kept._jdf.queryExecution().sparkPlan().toString()
    files = spark.sql("SELECT concat('/h/u', id, '/.config/opera/Default/History') AS path, id % 2 = 0 AS link FROM range(20) UNION ALL SELECT '/h/u1/.config', true")
    assert sorted(r["home"] for r in discovery.home_profiles(files).collect()) == sorted(f"/h/u{i}" for i in range(3, 20, 2))


def test_folders_are_told_by_order(spark, monkeypatch):
    """What lies below a link or another match is told by the order of the paths, whatever signs stand around the slash: no row for each
    folder above a path."""
    import itertools
    import random

    from waylens.sources import discovery

    monkeypatch.setattr(discovery, "_below", None)
    draw = random.Random(3)
    names = ("a", "a-", "a0", "a/b", "b", "é", "a.b", "\t", "aa")
    folders = sorted({"/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)})
    paths = [(f"/ev/{d}/places.sqlite", False) for d in draw.sample(folders, 250)] + [(f"/ev/{d}", True) for d in draw.sample(folders, 25)] + [("/ev/a/places.sqlite", True), ("/ev/aa/places.sqlite", None)]
    links = [p for p, link in paths if link]
    seen = {p.rpartition("/")[0] for p, link in paths if not link and not any(p == k or p.startswith(k + "/") for k in links)}
    want = sorted(p for p in seen if not any(p.startswith(o + "/") for o in seen))
    files = spark.createDataFrame(paths * 2, "path string, link boolean").repartition(7)
    assert sorted(r["path"] for r in discovery.swept_containers(files, "/ev").collect()) == want and 20 < len(want) < len(seen)


def test_lines_make_more_files(spark, with_events):
    """A profile's text files hold 2,500 lines at most, however many there are, and its files are made once."""
    from waylens import reader_queries as rq

    files = rq.profile_files(spark, with_events(range(9000)), ("firefox_site_security",))
    sizes = [r[0] for r in files.selectExpr("size(split(CAST(content AS STRING), '\n'))").collect()]
    assert max(sizes) <= 2500 and sum(sizes) == 9000
    assert "Aggregate" not in files._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_files_are_small(spark):
    """A task that reads files back holds a row group of them: contents that compress well don't make it large."""
    import glob

    from waylens.plans import scratch
    from waylens.sources import sqlite

    files = spark.range(0, 3000, 1, 1).selectExpr("concat('u/', id) AS path", "CAST(concat(repeat(sha2(CAST(id AS STRING), 512), 500), id) AS BINARY) AS content", "CAST(NULL AS TIMESTAMP) AS modificationTime", "0 AS route")
    sqlite.routed(files, {"t": (1, "t", "a bigint")}, {0})
    folder = next(p for p in reversed(scratch._written) if "/routed-" in p).removeprefix("file://")
    groups = [m.row_group(i).total_byte_size for f in glob.glob(f"{folder}/kind=file0/*.parquet") for m in (pq.read_metadata(f),) for i in range(m.num_row_groups)]
    assert sum(groups) > 150_000_000 and max(groups) < 100_000_000


def test_whole_graph_has_no_neighbour_cap(spark, monkeypatch):
    """All pairs of a window count, in blocks far smaller than a window, for few and many hosts, dense, sparse and equal times."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from waylens.operators import correlate

    monkeypatch.setattr(correlate, "WHOLE_BLOCK", 16)
    draw = random.Random(8)
    for hosts, span, window in ((3, 2000, 300), (60, 900, 100), (5, 1, 10), (9, 10**6, 20), (4, 500, 10**6)):
        times = [draw.randint(1, span) for _ in range(500)] + [span + 50] * 130 + [0]
        rows = [(t, i, f"h{draw.randrange(hosts)}" if draw.random() > 0.05 else None) for i, t in enumerate(times)]
        timed = sorted((t, h) for t, _, h in rows if t and h)
        expected = Counter()
        for i, (t, h) in enumerate(timed):
            for u, g in timed[i + 1 :]:
                if u - t > window:
                    break
                if g != h:
                    expected[min(g, h), max(g, h)] += 1
        events = spark.createDataFrame(rows, "timestamp_ns bigint, seq bigint, host string")
        assert {(r["src"], r["dst"]): r["weight"] for r in correlate.cooccurrence_whole(events, F.col("host"), window).collect()} == expected
    assert correlate.cooccurrence_whole(events.limit(0), F.col("host"), window).count() == 0
    chained = spark.range(700).selectExpr("id AS seq", "5L AS timestamp_ns", "false AS is_redirect", "IF(id = 0, 'a', 'b') AS h", "CAST(NULL AS STRING) AS r")
    assert [tuple(r) for r in correlate.whole_edges(chained, F.col("h"), F.col("r")).collect()] == [("a", "b", "co-occurrence", 699)]


def test_hits_become_rows_last(spark):
    """What a hit says besides its term is computed once an event: the list of an event's terms becomes rows above all joins."""
    from waylens.operators import search

    events = spark.range(30).selectExpr("id AS seq", "1L AS timestamp_ns", "'Chromium' AS browser", "'History' AS artifact", "'s' AS source", "concat('abcdef', id % 3) AS description", "concat('abcdef', id % 3) AS url")
    terms = spark.createDataFrame([("abcd",), ("bcdef",), ("ef1",), ("f",), ("zzzzz",)], "term string")
    for fields, n in ((["url"], 100), (None, 100)):
        found = search.find_many(events, terms, fields)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Join")
        assert found.count() == found.select("seq", "term").distinct().count() == n
