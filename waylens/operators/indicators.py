"""Indicators in text: rows of kind, value and UTF-8 byte offset."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import xor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from waylens.functions import urls as ur
from waylens.operators.search import URL, text_fields
from waylens.plans.scratch import spread
from waylens.sources.windows import scan, whole_files

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Each begins with a letter or digit and asks for the boundary before it afterwards, so that a search runs to the next such
#: character instead of trying each place.
IPV4 = r"[0-9](?<=\b[0-9])[0-9]{0,2}\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}\b"
CARD = r"[0-9](?<=\b[0-9])[0-9]{12,18}\b"
ETHEREUM = r"0x(?<=\b0x)[0-9a-fA-F]{40}\b"
BASE58 = r"[13](?<=\b[13])[1-9A-HJ-NP-Za-km-z]{25,34}\b"
BECH32 = r"[bB](?<=\b[bB])[cC]1[0-9A-Za-z]{11,87}\b"
OCTETS = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
#: Hits that a task holds before it passes them on.
HELD = 1 << 16


def _found(rows: DataFrame, text: str, *kinds: str) -> DataFrame:
    """``kind, value, offset`` beside the other columns: what holds of each kind in a text, in tasks over Arrow batches.

    A text is asked for a sign that the kind can't do without before its pattern is tried, and candidates are tested right
    away. A null text has no hits.
    """
    rest = [c for c in rows.columns if c != text]
    result = StructType([*[rows.schema[c] for c in rest], StructField("kind", StringType()), StructField("value", StringType()), StructField("offset", LongType())])

    def run(batches):
        tried = [(k, *KINDS[k]) for k in kinds]
        for batch in batches:
            at, hits = [], []

            def out():
                columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in rest]
                own = zip(*hits, strict=True) if hits else ((), (), ())
                made = [pa.array(list(x), t) for x, t in zip(own, (pa.string(), pa.string(), pa.int64()), strict=True)]
                return pa.RecordBatch.from_arrays([*columns, *made], names=result.names)

            for i, value in enumerate(batch.column(text)):
                content = value.as_py()
                if not content:
                    continue
                size = _sizes(content)
                for kind, sign, find, holds in tried:
                    if sign in content or (sign != sign.upper() and sign.upper() in content):
                        for start, candidate in find(content):
                            if holds is None or holds(candidate):
                                at.append(i)
                                hits.append((kind, candidate, size(start)))
                if len(hits) > HELD:
                    yield out()
                    at, hits = [], []
            yield out()

    return spread(rows.select(*rest, text)).mapInArrow(run, result)


def _sizes(text: str):
    """A function from a place in the text to the UTF-8 bytes before it; fast for places that rise."""
    if text.isascii():
        return lambda at: at
    last = [0, 0]

    def size(at: int) -> int:
        if at < last[0]:
            last[:] = [0, 0]
        last[1] += len(text[last[0] : at].encode("utf-8", "surrogatepass"))
        last[0] = at
        return last[1]

    return size


def _pattern(pattern: str):
    found = re.compile(pattern).finditer
    return lambda text: ((m.start(), m[0]) for m in found(text))


LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def _mails(text: str):
    """What EMAIL matches, found from each ``@`` backwards, so that long runs without one cost nothing."""
    done = 0
    while (at := text.find("@", done)) >= 0:
        start = done + len(text[done:at].rstrip(LOCAL_PART))
        domain = _DOMAIN.match(text, at) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, text[start:done]


IPV6_LETTERS = "0123456789ABCDEFabcdef"
_IPV6_REST = re.compile(r"[0-9A-Fa-f:]+")


def _colons(text: str):
    """Runs of 2 to 39 hexadecimal digits and colons, at least two of them colons, found from each run's first colon."""
    done = 0
    while (at := text.find(":", done)) >= 0:
        start = done + len(text[done:at].rstrip(IPV6_LETTERS))
        done = _IPV6_REST.match(text, at).end()
        if done - start <= 39 and text.find(":", at + 1, done) >= 0:
            yield start, text[start:done]


#: Tests of repeated candidates that a task remembers.
REMEMBERED = 1 << 14
#: What each digit adds when it is doubled and the digits of that are added up.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def _luhn(digits: str) -> bool:
    added = (digits[-1::-2] + digits[-2::-2].translate(_DOUBLED)).encode()
    return (sum(added) - 48 * len(added)) % 10 == 0


def emails(rows: DataFrame, text: str = "text") -> DataFrame:
    return _found(rows, text, "email").drop("kind")


def ipv4(rows: DataFrame, text: str = "text") -> DataFrame:
    """Four octets up to 255 without leading zeros."""
    return _found(rows, text, "ipv4").drop("kind")


def cards(rows: DataFrame, text: str = "text") -> DataFrame:
    return _found(rows, text, "card").drop("kind")


def _ethereum_note(value: Column) -> Column:
    body = F.substring(value, 3, 40)
    return F.when(body.rlike("[a-f]") & body.rlike("[A-F]"), "mixed case, checksum not verified").otherwise("no checksum")


def ethereum(rows: DataFrame, text: str = "text") -> DataFrame:
    return _found(rows, text, "eth").drop("kind").withColumn("note", _ethereum_note(F.col("value")))


@lru_cache(REMEMBERED)
def _is_ipv6(value: str) -> bool:
    import ipaddress

    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


#: The alphabets of both kinds of Bitcoin address, and the checksum's generator and constants.
BASE58_LETTERS = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32_LETTERS = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR, BECH32_SUM, BECH32M_SUM = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3), 1, 0x2BC830A3
_BASE58, _BECH32 = ({c: i for i, c in enumerate(letters)} for letters in (BASE58_LETTERS, BECH32_LETTERS))
#: What each five topmost bits add to the sum.
_TOP = [reduce(xor, (g for i, g in enumerate(GENERATOR) if top >> i & 1), 0) for top in range(32)]


@lru_cache(REMEMBERED)
def _is_base58(value: str) -> bool:
    """Whether 25 bytes come out whose last four are the double SHA-256 of the others."""
    import hashlib

    n = 0
    for c in value:
        n = n * 58 + _BASE58[c]
    raw = n.to_bytes(25, "big") if n < 1 << 200 else b""
    return len(raw) == 25 and len(value) - len(value.lstrip("1")) == len(raw) - len(raw.lstrip(b"\0")) and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


@lru_cache(REMEMBERED)
def _is_bech32(value: str) -> bool:
    if value not in (value.lower(), value.upper()):
        return False
    head, data = value.lower()[:2], value.lower()[3:]
    if any(c not in _BECH32 for c in data) or len(data) < 8:
        return False
    check = 1
    for x in [*(ord(c) >> 5 for c in head), 0, *(ord(c) & 31 for c in head), *(_BECH32[c] for c in data)]:
        check = (check & 0x1FFFFFF) << 5 ^ x ^ _TOP[check >> 25]
    return check == (BECH32_SUM if data[0] == "q" else BECH32M_SUM)


def ipv6(rows: DataFrame, text: str = "text") -> DataFrame:
    """IPv6 addresses that the standard parser accepts."""
    return _found(rows, text, "ipv6").drop("kind")


def bitcoin(rows: DataFrame, text: str = "text") -> DataFrame:
    """Base58 addresses with a right double-SHA-256 checksum, and Bech32 or Bech32m ones with a right polynomial."""
    return _found(rows, text, "btc_base58", "btc_bech32")


#: Of each kind: what a text must contain to have one (in any case of the letters), how candidates are found, and their test.
KINDS = {
    "email": ("@", _mails, None), "ipv4": (".", _pattern(IPV4), re.compile(OCTETS).fullmatch), "ipv6": (":", _colons, _is_ipv6), "card": ("", _pattern(CARD), _luhn),
    "btc_base58": ("", _pattern(BASE58), _is_base58), "btc_bech32": ("1", _pattern(BECH32), _is_bech32), "eth": ("0x", _pattern(ETHEREUM), None), "search_term": ("://", _pattern(URL.replace(r"\s", r" \t-\r")), None),
}


def all_indicators(rows: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Indicators of ``kinds``, search terms of URLs among them: the other columns, ``kind, value, offset, note``.

    A text is read once for all kinds. URLs are interpreted, and notes made, as columns afterwards. Null and empty texts have
    no indicators, repeated rows have theirs each.
    """
    found = _found(rows, text, *kinds)
    kind, value = F.col("kind"), F.col("value")
    note = F.when(kind == "card", "Luhn-valid").when(kind == "eth", _ethereum_note(value)).when(kind.isin("btc_base58", "btc_bech32"), "checksum-valid")
    if "search_term" not in kinds:
        return found.withColumn("note", note)
    # exploded, so that a URL is interpreted once, not for each column and condition on it
    own = F.when(kind == "search_term", ur.search_query(value)).otherwise(F.struct(note.alias("engine"), value.alias("term")))
    said = found.withColumn("__said", F.explode(F.array_compact(F.array(own))))
    return said.select(*[F.col("__said.term").alias("value") if c == "value" else F.col(f"`{c}`") for c in found.columns], F.col("__said.engine").alias("note"))


def in_order(found: DataFrame, *keys: str) -> DataFrame:
    """Indicators sorted by ``keys`` and their place; of those at one place, by kind and value."""
    return found.orderBy(*keys, "offset", "kind", "value")


def event_indicators(events: DataFrame, limit: int | None = None) -> DataFrame:
    """``seq, field, kind, value, offset, note`` of every text of an event."""
    texts = events.select("seq", F.explode(text_fields(events, None, limit)).alias("x")).select("seq", "x.field", "x.text")
    return all_indicators(texts)


def url_matches(files: DataFrame) -> DataFrame:
    """``source, offset, url`` of every URL in raw bytes: windows of ``sources.windows``, or whole files ``path, content``. A URL inside
    another one is found too; a zero byte ends one."""
    windows = files if "owned" in files.columns else whole_files(files)
    return scan(windows, rb"(?=(https?://[^\s\"'<>\x00]+))", "url").where(ur.host_of(F.col("url")).isNotNull())


def scanned_urls(files: DataFrame) -> DataFrame:
    """``source, url`` of what ``url_matches`` finds, once each."""
    return url_matches(files).select("source", "url").distinct()


def cookie_matches(files: DataFrame) -> DataFrame:
    """``source, offset, cookie`` of what follows each ``Cookie: `` in raw bytes, to the line's end, without blanks around it."""
    windows = files if "owned" in files.columns else whole_files(files)
    return scan(windows, rb"(?=Cookie: ([^\r\n]*))", "cookie").withColumn("cookie", F.trim("cookie")).where("cookie <> ''")


def scanned_cookies(files: DataFrame) -> DataFrame:
    """``source, cookie`` of what ``cookie_matches`` finds, once each."""
    return cookie_matches(files).select("source", "cookie").distinct()


def processes(memory_events: DataFrame) -> DataFrame:
    """Distinct processes that events of a memory image come from."""
    return memory_events.where("pid IS NOT NULL").select("pid", "process").distinct()
