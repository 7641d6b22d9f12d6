"""Golden values of the scalar functions."""

from pyspark.sql import functions as F

from waylens.functions import text as tx
from waylens.functions import times as tm
from waylens.functions import urls as ur


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def long(v):
    return F.lit(v).cast("long")


def test_epochs(spark):
    assert one(spark, tm.webkit_micros(long(11_644_473_600_000_000))) == 0
    assert one(spark, tm.core_data_seconds(F.lit(0.9))) == 978_307_200 * 10**9
    assert one(spark, tm.unix_seconds(long(tm.LONG_MAX))) == tm.LONG_MAX
    assert one(spark, tm.unix_millis(long(5))) == 5_000_000
    assert one(spark, tm.filetime(F.lit("116444736000000000"))) == 0
    assert one(spark, tm.filetime(F.lit("18446744073709551615"))) == tm.LONG_MAX


def test_friendly_dates(spark):
    for raw in (1_300_000_000, 1_300_000_000_000, 1_300_000_000_000_000, 12_944_473_600_000_000, 12_944_473_600_000, 12_944_473_600):
        assert one(spark, tm.friendly_date(long(raw))) == "2011-03-13 07:06:40.000"
    assert one(spark, tm.friendly_date(long(0))) is None
    assert one(spark, tm.friendly_date(long(253_402_300_800_000_000))) is None


def test_hosts(spark):
    cases = {
        "https://User@WWW.Example.COM:8080/p?q#f": "www.example.com", "example.com/path": "example.com", "me@host.org:80": "host.org", "  ": None,
        "http://[::1]:80/": "[::1]", ".a.b.": "a.b", "file:///x": None,
    }
    for value, host in cases.items():
        assert one(spark, ur.host_of(F.lit(value))) == host, value
    domains = {"a.b.example.com": "example.com", "news.bbc.co.uk": "bbc.co.uk", "co.uk": "co.uk", "a.co.io": "a.co.io", "x.y.io": "y.io", "10.0.0.1": "10.0.0.1", "[::1]": "[::1]", "localhost": "localhost"}
    for host, domain in domains.items():
        assert one(spark, ur.registrable_domain(F.lit(host))) == domain, host


def test_search_queries(spark):
    cases = {
        "https://www.google.de/search?q=a+b": ("Google", "a b"), "https://www.bing.com/search?q=x": ("Bing", "x"), "https://duckduckgo.com/?q=y": ("DuckDuckGo", "y"),
        "https://www.youtube.com/results?search_query=z": ("YouTube", "z"), "https://www.amazon.de/s?k=w": ("Amazon", "w"), "https://x.example/?query=v": ("Generic", "v"), "https://x.example/?z=1": None,
    }
    for url, want in cases.items():
        got = one(spark, ur.search_query(F.lit(url)))
        assert (None if got is None else tuple(got)) == want, url


def test_text(spark):
    assert one(spark, tx.mask_secrets(F.lit(" a  me@x.org 0123456789abcdef01234567 b@c "))) == "a [redacted-email] [redacted] b@c"
    assert one(spark, tx.transition_core(long(-2147483647))) == "typed"
    assert one(spark, tx.redirect_kind(long(-1))) == "server"
    assert one(spark, tx.transition_label(F.lit("keyword_generated"))) == "keyword search"
    assert one(spark, tx.is_executable(F.lit("C:\\x\\Setup.EXE"))) is True
    assert one(spark, tx.user_of(F.lit("/img/home/a/Users/Bob/x"))) == "Bob"
    assert one(spark, tx.csv_field(F.lit('=a"b'))) == '"\'=a""b"'
    assert one(spark, tx.firefox_type(long(5))) == "redirect_permanent"


def test_rendered_and_parsed_times(spark):
    import pytest

    from waylens.functions.times import duration_ns, rfc3339, timestamp_ns

    cases = [(0, "1970-01-01T00:00:00+00:00"), (1_500_000_000_120_000_000, "2017-07-14T02:40:00.120+00:00"), (-1, "1969-12-31T23:59:59.999999999+00:00"), (1_000_000, "1970-01-01T00:00:00.001+00:00"), (-(2**63), "1677-09-21T00:12:43.145224192+00:00"), (None, None)]
    rows = spark.createDataFrame([(n,) for n, _ in cases], "n bigint")
    assert [r.t for r in rows.select(rfc3339(F.col("n")).alias("t")).collect()] == [t for _, t in cases]
    zones = rows.limit(1).select(*[rfc3339(F.lit(1_700_000_000_000_000_000), z).alias(z) for z in ("America/New_York", "Asia/Kathmandu")]).first()
    assert list(zones) == ["2023-11-14T17:13:20-05:00", "2023-11-15T03:58:20+05:45"]
    assert [duration_ns(x) for x in ("90", "2m", "-1h", "1d")] == [90 * 10**9, 120 * 10**9, -3600 * 10**9, 86400 * 10**9]
    assert [timestamp_ns(x) for x in ("1970-01-02", "1970-01-01T00:00:01.5Z", "1970-01-01T01:00:00+01:00", "-7")] == [86400 * 10**9, 1_500_000_000, 0, -7]
    for bad in ("5w", "x", "2020-13-01", "1.5"):
        with pytest.raises(ValueError):
            (duration_ns if bad == "5w" else timestamp_ns)(bad)
