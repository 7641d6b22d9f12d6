"""Small cases of the operators that driver tables don't reach."""

from pyspark.sql import functions as F

from waylens.operators import correlate, indicators, integrity, search, timeline, visits


def visit_rows(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, profile bigint, visit_id bigint, from_visit bigint, url string, is_redirect boolean, redirect_kind string")


def test_referrers_with_loops_and_gaps(spark):
    rows = [(i, 1, i + 1, f, f"u{i}", False, None) for i, f in enumerate((0, 1, 2, 99, 6, 7, 5, 7))]
    got = {r.visit_id: (r.nav_depth, r.referrer_url) for r in visits.referrer_chains(visit_rows(spark, rows)).collect()}
    assert got == {1: (0, None), 2: (1, "u0"), 3: (2, "u1"), 4: (0, None), 5: (3, "u5"), 6: (3, "u6"), 7: (3, "u4"), 8: (3, "u6")}


def test_redirect_runs(spark):
    rows = [(0, 1, 1, 0, "a", False, None), (1, 1, 2, 1, "b", True, "server"), (2, 1, 3, 2, "c", True, "client"), (3, 1, 4, 2, "d", True, "client"), (4, 2, 9, 0, "e", True, "server")]
    got = sorted((r.chain_id, r.position, r.visit_id, r.role) for r in visits.redirect_chains(visit_rows(spark, rows)).collect())
    assert got == [(0, 0, 1, "start"), (0, 1, 2, "hop"), (0, 2, 3, "landing"), (1, 0, 9, "landing")]


def test_sessions_split_on_recorded_ids(spark):
    e = spark.createDataFrame([(0, 1, 10, 1), (1, 1, 20, 1), (2, 1, 30, 2), (3, 1, 40, None), (4, 1, 141, None)], "seq bigint, profile bigint, timestamp_ns bigint, session bigint")
    got = [r.session_id for r in timeline.sessionize(e, 100, recorded=F.col("session")).orderBy("seq").collect()]
    assert got == [0, 0, 1, 1, 2]


def test_sessions_split_only_above_the_gap(spark):
    e = spark.createDataFrame([(0, 1, 0), (1, 1, 100), (2, 1, 201)], "seq bigint, profile bigint, timestamp_ns bigint")
    assert [r.session_id for r in timeline.sessionize(e, 100).orderBy("seq").collect()] == [0, 0, 1]


def test_neighbour_cap(spark):
    e = spark.createDataFrame([(i, 1000 + i, "a" if i == 0 else "b") for i in range(600)], "seq bigint, timestamp_ns bigint, host string")
    assert correlate.cooccurrence(e, F.col("host"), 1000).first()["weight"] == 512


def test_bitcoin_and_ipv6(spark):
    d = spark.createDataFrame([(1, "pay 1BoatSLRHtKNngkdXEeobR76b53LETtpyT or 1BoatSLRHtKNngkdXEeobR76b53LETtpyU"), (2, "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5"), (3, "é fe80::1 and 1:2:3 10:20")], "doc_id int, text string")
    assert sorted((r.doc_id, r.kind, r.offset) for r in indicators.bitcoin(d).collect()) == [(1, "btc_base58", 4), (2, "btc_bech32", 0)]
    assert [(r.value, r.offset) for r in indicators.ipv6(d).collect()] == [("fe80::1", 3)]
    eth = spark.createDataFrame([(1, "x 0x52908400098527886E0F7030069857D2E4169EE7")], "doc_id int, text string")
    assert indicators.ethereum(eth).first()["offset"] == 2


def test_header_anomalies(spark):
    def head(changes, valid, write=1):
        return bytearray(b"SQLite format 3\0\x10\0" + bytes([write, 1]) + b"\0" * 4 + changes.to_bytes(4, "big") + b"\0" * 64 + valid.to_bytes(4, "big"))

    rows = spark.createDataFrame([("ok", head(3, 3)), ("edited", head(4, 3)), ("odd", head(3, 0, 7)), ("no", bytearray(b"x"))], "path string, content binary")
    assert sorted((r.path, r.tag) for r in integrity.header_anomalies(rows).collect()) == [("edited", "ChangeCounterMismatch"), ("odd", "HeaderVersionAnomaly")]


def test_search_reads_whole_fields(spark):
    rows = spark.range(2).select(F.concat(F.repeat(F.lit("x"), search.FIELD_LIMIT), F.when(F.col("id") == 0, "needle").otherwise("")).alias("description"), F.lit("").alias("source"), F.lit("").alias("url"))
    for regex in (False, True):
        assert search.filter_events(rows, "needle", regex=regex).count() == 1
        assert search.filter_events(rows, "needle", regex=regex, limit=search.FIELD_LIMIT).count() == 0


def depths(rows):
    """nav_depth of visits ``(seq, profile, visit_id, from_visit, ...)`` as a walk finds it."""
    link = {(p, v): f for _, p, v, f, *_ in sorted(rows)}
    out = {}
    for s, p, _, f, *_ in rows:
        seen, at = set(), f
        while at and (p, at) in link and at not in seen and len(seen) < 4096:
            seen.add(at)
            at = link[p, at]
        out[s] = len(seen)
    return out


def test_long_cycles_and_ways_into_them(spark):
    import random

    rng = random.Random(5)
    ring, tail = list(range(1, 3001)), list(range(5000, 5040))
    links = [(v, ring[(i + 1) % len(ring)]) for i, v in enumerate(ring)] + list(zip(tail, [17, *tail], strict=False))  # noqa: B905
    links += [(9001, 9002), (9002, 9001), (9003, 9003), (9004, 9003), (9005, 0), (9006, 9005)] + [(9100 + i, rng.randrange(9095, 9160)) for i in range(60)]
    rows = [(i, 1, v, f, f"u{v}", False, None) for i, (v, f) in enumerate(links)]
    got = {r.seq: r.nav_depth for r in visits.referrer_chains(visit_rows(spark, rows)).collect()}
    assert got == depths(rows)


def chains(rows):
    """Redirect chains as walks over events find them: chain, position, visit id, role."""
    rows = sorted(rows)
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2]), r)
    out, n = [], 0
    for r in rows:
        parent = first.get((r[1], r[3]))
        if not r[5] or parent and parent[5]:
            continue
        run = [r]
        while True:
            child = next((c for c in rows if c[5] and c[1] == r[1] and c[3] == run[-1][2] and c not in run), None)
            if child is None:
                break
            run.append(child)
        ids = ([parent[2]] if parent else []) + [x[2] for x in run]
        out += [(n, i, v, "landing" if i == len(ids) - 1 else "start" if i == 0 else "hop") for i, v in enumerate(ids)]
        n += 1
    return out


def test_redirects_with_repeated_visit_ids(spark):
    rows = [(0, 1, 1, 0, "a", False, None), (1, 1, 2, 1, "b", True, "server"), (2, 1, 2, 1, "b", True, "server"), (3, 1, 3, 2, "c", True, "client"), (4, 1, 4, 3, "d", True, "client"), (5, 1, 4, 3, "d", True, "client"), (6, 2, 2, 1, "z", True, None)]
    got = sorted((r.chain_id, r.position, r.visit_id, r.role) for r in visits.redirect_chains(visit_rows(spark, rows)).collect())
    assert got == sorted(chains(rows)) and len(got) == 9


def test_many_events_in_one_moment(spark):
    """20,000 events at one time: each sees the next 512, so pairs grow with events, not with their square."""
    n = 20_000
    e = spark.range(n).select(F.col("id").alias("seq"), F.lit(5).cast("long").alias("timestamp_ns"), F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("host"))
    got = correlate.cooccurrence(e, F.col("host"), 10).collect()
    want = sum(1 for i in range(n - 600, n) for j in range(i + 1, min(n, i + 513)) if (j - i) % 2) + (n - 600) * 256
    assert [(r.src, r.dst, r.weight) for r in got] == [("h0", "h1", want)]


def test_sessions_over_ranges(spark):
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice((1, 1, 1, 1, 2, 3)), rng.randrange(0, 200_000)) for i in range(3000)]
    e = spark.createDataFrame(rows, "seq bigint, profile bigint, timestamp_ns bigint")
    got = {r.seq: r.session_id for r in timeline.sessionize(e, 100, most=500).collect()}
    assert got == {r.seq: r.session_id for r in timeline.sessionize(e, 100).collect()}
    want = {}
    for p in (1, 2, 3):
        own, n = sorted((t, i) for i, q, t in rows if q == p), 0
        for k, (t, i) in enumerate(own):
            n += k > 0 and t - own[k - 1][0] > 100
            want[i] = n
    assert got == want


def test_fields_of_events(spark):
    """Only text counts as text; bounds are UTF-8 bytes on a character's edge."""
    rows = [(1, "seen é", "src", '{"url": "https://A.example/x", "n": 5, "flag": true, "host": "B.example", "deep": {"a": "zzz"}}'), (2, None, "s2 http://c.example:80/?q=1 end", "{}"), (3, "d", "s", None)]
    e = spark.createDataFrame(rows, "seq bigint, description string, source string, attrs_json string").withColumn("timestamp_ns", F.lit(0))
    got = {r.seq: {(x.field, x.text) for x in r.t} for r in e.select("seq", search.text_fields(e).alias("t")).collect()}
    assert got[1] == {("description", "seen é"), ("source", "src"), ("url", "https://A.example/x"), ("host", "B.example")} and got[2] == {("source", rows[1][2])}
    found = lambda p, *f: [r.seq for r in search.filter_events(e, p, list(f) or None).collect()]
    assert found("5") == [] and found("zzz") == [] and found("example") == [1, 2] and found("example", "host") == [1] and found("true") == []
    assert {(r.seq, r.field, r.host) for r in search.event_hosts(e).collect()} == {(1, "url", "a.example"), (1, "host", "b.example"), (2, "source", "c.example")}
    cut = e.where("seq = 1").select(*[search.bounded(F.col("description"), n).alias(str(n)) for n in (4, 5, 6, 7, 8)]).first()
    assert list(cut) == ["seen", "seen ", "seen ", "seen é", "seen é"]


def test_hits_of_recovered_rows(spark):
    rows = spark.createDataFrame([(1, {"title": "evil", "URL": "https://evil.example/"}), (2, {"b": "an evil b", "c": "evil c", "url": "none"}), (3, {"x": "evi", "y": "l"}), (4, {"evil_key": "v"})], "row bigint, fields map<string,string>")
    got = {(r.row, r.term): r.match for r in search.carved_hits(rows, ["evil", "zz"]).collect()}
    assert got == {(1, "evil"): "https://evil.example/", (2, "evil"): "evil c", (4, "evil"): '{"evil_key":"v"}'}


def test_needle_and_unknown_kinds(spark):
    from waylens.sources import writers

    rows = [(1, 0, "Chromium", "Strange", "s", "d", {"url": "https://X.example/ABC", "title": None}), (2, 1_500_000_000_123_456_789, "Safari", "History", "s", 'q"', {"title": "abc"}), (3, 1, "Safari", "History", "s", "abc", {})]
    e = spark.createDataFrame(rows, "seq bigint, timestamp_ns bigint, browser string, artifact string, source string, description string, attrs map<string,string>")
    assert sorted(r.seq for r in search.needle(e, "aBc").collect()) == [1, 2]
    assert writers.bodyfile(e).count() == writers.l2t_csv(e).count() == 3 and search.find_hits(e, ["d", "abc"], ["description"]).count() == 2
    shown = [r.timestamp for r in writers.export_rows(e.where("seq = 2"), "Asia/Kolkata").collect()]
    assert shown == ["2017-07-14T08:10:00.123456789+05:30"]
