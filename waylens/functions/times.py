"""Timestamps: epochs of browser stores to Unix nanoseconds, unit inference and rendering."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601-01-01 and to 2001-01-01, seen from 1970-01-01.
WEBKIT_OFFSET, CORE_DATA_OFFSET = 11_644_473_600, 978_307_200
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def saturating_multiply(c: Column, k: int) -> Column:
    """``c * k`` for k > 0 that stops at the ends of the 64-bit range instead of raising."""
    return F.when(c > LONG_MAX // k, F.lit(LONG_MAX)).when(c < -(LONG_MAX // k), F.lit(LONG_MIN)).otherwise(c * k)


def saturating_subtract(c: Column, k: int) -> Column:
    return F.when(c < LONG_MIN + k, F.lit(LONG_MIN)).otherwise(c - k)


def webkit_micros(c: Column) -> Column:
    """Microseconds since 1601."""
    return saturating_multiply(saturating_subtract(c, WEBKIT_OFFSET * 1_000_000), 1000)


def core_data_seconds(c: Column) -> Column:
    """Seconds since 2001 as a double; the fraction is dropped."""
    whole = F.when(c.isNull(), F.lit(None)).when(F.isnan(c), F.lit(0)).when(c >= 9.2e18, F.lit(LONG_MAX)).when(c <= -9.2e18, F.lit(LONG_MIN)).otherwise(c.try_cast("long"))
    moved = F.when(whole > LONG_MAX - CORE_DATA_OFFSET, F.lit(LONG_MAX)).otherwise(whole + CORE_DATA_OFFSET)
    return saturating_multiply(moved, 1_000_000_000)


def unix_micros(c: Column) -> Column:
    return saturating_multiply(c, 1000)


def unix_millis(c: Column) -> Column:
    return saturating_multiply(c, 1_000_000)


def unix_seconds(c: Column) -> Column:
    return saturating_multiply(c, 1_000_000_000)


def filetime(c: Column) -> Column:
    """100 ns units since 1601, up to the unsigned 64-bit range (a decimal), clamped."""
    wide = (c.cast("decimal(20,0)").cast("decimal(38,0)") - F.lit(WEBKIT_OFFSET * 10_000_000).cast("decimal(38,0)")) * F.lit(100).cast("decimal(38,0)")
    ends = F.greatest(F.lit(str(LONG_MIN)).cast("decimal(38,0)"), F.least(F.lit(str(LONG_MAX)).cast("decimal(38,0)"), wide.cast("decimal(38,0)")))
    return ends.cast("long")


def infer_millis(c: Column) -> Column:
    """Unix milliseconds of a raw integer whose unit follows from its size; null out of range."""
    return (
        F.when(c >= 253_402_300_800_000_000, F.lit(None).cast("long"))
        .when(c > 12_000_000_000_000_000, _thousandth(c) - WEBKIT_OFFSET * 1000)
        .when((c > 1_280_000_000_000_000) & (c < 2_500_000_000_000_000), _thousandth(c))
        .when((c > 1_280_000_000_000) & (c < 2_500_000_000_000), c)
        .when((c > 12_906_777_600_000) & (c < 15_000_000_000_000), c - WEBKIT_OFFSET * 1000)
        .when((c >= 12_900_000_000) & (c < 15_000_000_000), (c - WEBKIT_OFFSET) * 1000)
        .when(c > 0, F.when(c <= LONG_MAX // 1000, c * 1000))
    )


def _thousandth(c: Column) -> Column:
    """Whole thousandths of a positive long, without going through a double."""
    return F.floor((c - F.pmod(c, F.lit(1000))).cast("decimal(20,0)") / F.lit(1000).cast("decimal(20,0)")).cast("long")


def friendly_date(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` in UTC of a raw timestamp in any of the known units; null past the year 9999."""
    ms = infer_millis(c)
    return F.when(ms < 253_402_300_800_000, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS"))


def rfc3339(ns: Column, zone: str = "UTC") -> Column:
    """RFC 3339 in an IANA zone, with the fraction's thousands as far as they aren't zero."""
    whole = F.floor(ns.cast("decimal(20,0)") / F.lit(1_000_000_000)).cast("long")
    part = F.pmod(ns, F.lit(1_000_000_000).cast("long"))
    utc = F.timestamp_add("SECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    ahead = F.timestamp_diff("MINUTE", utc, local)
    digits = F.lpad(part.cast("string"), 9, "0")
    fraction = F.when(part == 0, "").when(part % 1_000_000 == 0, F.concat(F.lit("."), F.left(digits, F.lit(3)))).when(part % 1_000 == 0, F.concat(F.lit("."), F.left(digits, F.lit(6)))).otherwise(F.concat(F.lit("."), digits))
    sign = F.when(ahead < 0, "-").otherwise("+")
    return F.concat(F.replace(local.cast("string"), F.lit(" "), F.lit("T")), fraction, sign, F.format_string("%02d:%02d", F.floor(F.abs(ahead) / 60), F.abs(ahead) % 60))


def duration_ns(text: str) -> int:
    """Nanoseconds of ``90``, ``90s``, ``5m``, ``2h`` or ``1d``; ValueError for others."""
    found = re.fullmatch(r"\s*(-?[0-9]+)\s*([smhd]?)\s*", text)
    if not found:
        raise ValueError(f"not a duration in s, m, h or d: {text!r}")
    value = int(found[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]] * 1_000_000_000
    return max(LONG_MIN, min(LONG_MAX, value))


def timestamp_ns(text: str) -> int:
    """Unix nanoseconds of an RFC 3339 time, a date (its midnight in UTC) or a plain number of them; ValueError for others."""
    found = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2}))?", text)
    if found:
        zone = "+00:00" if found[4] in (None, "Z", "z") else found[4]
        moment = datetime.datetime.fromisoformat(f"{found[1]}T{found[2] or '00:00:00'}{zone}")
        seconds = (moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(seconds=1)
        return seconds * 1_000_000_000 + int((found[3] or ".0")[1:10].ljust(9, "0"))
    if re.fullmatch(r"[+-]?[0-9]+", text) and LONG_MIN <= int(text) <= LONG_MAX:
        return int(text)
    raise ValueError(f"not RFC 3339, a date or nanoseconds: {text!r}")
