"""Cookie values with a known layout, as readable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waylens.functions.times import friendly_date

GA_TAG = "[Google Analytics Cookie]"


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _seconds(c: Column) -> Column:
    """Date of exactly ten digits."""
    return F.when(c.rlike("^[0-9]{10}$"), friendly_date(_long(c)))


def _line(*parts: object) -> Column:
    """Parts joined as they are; null if one is."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def google_analytics(name: Column, value: Column) -> Column:
    p = F.split(value, r"\.")
    part = lambda i: F.get(p, F.lit(i))
    size = F.size(p)
    first, previous, last = _seconds(part(2)), _seconds(part(3)), _seconds(part(4))
    utma = _line("Domain Hash: ", part(0), " | Unique Visitor ID: ", part(1), " | First Visit: ", first, " | Previous Visit: ", previous, " | Last Visit: ", last, " | Number of Sessions: ", part(5), f" | {GA_TAG}")
    utmb = _line("Domain Hash: ", part(0), " | Pages Viewed: ", part(1), " | Last Visit: ", _seconds(part(3)), f" | {GA_TAG}")
    custom = F.regexp_replace(F.regexp_replace(value, r"(?s)^[^.]*\.", ""), r"^\|", "")
    return (
        F.when((name == "__utma") & (size >= 6), utma)
        .when((name == "__utmb") & (size >= 4), utmb)
        .when((name == "__utmc") & value.rlike("^[0-9]+$"), _line("Domain Hash: ", value, f" | {GA_TAG}"))
        .when((name == "__utmv") & value.contains("."), _line("Domain Hash: ", part(0), " | Custom Values: ", custom, f" | {GA_TAG}"))
        .when((name == "__utmz") & (size >= 4), campaign(value))
        .when((name == "_ga") & (size >= 4) & (part(0) == "GA1"), _line("Client ID: ", part(2), ".", part(3), " | First Visit: ", _seconds(part(3)), f" | {GA_TAG}"))
    )


def campaign(value: Column) -> Column:
    """The ``__utmz`` cookie: hash.time.sessions.sources.campaign fields."""
    p = F.split(value, r"\.", 5)
    part = lambda i: F.get(p, F.lit(i))
    blob = F.regexp_replace(part(4), "^utm", "")
    fields = F.filter(F.split(F.coalesce(blob, F.lit("")), r"\|utm"), lambda x: x.contains("="))

    def field(key: str) -> Column:
        own = F.filter(fields, lambda x: F.substring_index(x, "=", 1) == key)
        return F.coalesce(F.regexp_replace(F.try_element_at(own, F.lit(-1)), "(?s)^[^=]*=", ""), F.lit(""))

    csr, cmd, ccn, ctr, cct = (field(k) for k in ("csr", "cmd", "ccn", "ctr", "cct"))
    given = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    referral = F.concat(F.lit("Referrer: "), csr, cct, F.when((ccn != "(referral)") & (ccn != ""), F.concat(F.lit(" | Ad Campaign Info: "), ccn)).otherwise(""))
    keywords = F.coalesce(given(" | Search keywords: ", ctr), F.lit(""))
    plain = F.concat_ws(" | ", given("Last Source Site: ", csr), given("Ad Campaign Info: ", ccn), given("Keyword(s) from Search that Found Site: ", ctr), given("Path to the page on the site of the referring link: ", cct))
    detail = (
        F.when(part(4).isNull(), "").when(cmd == "referral", referral).when(cmd == "organic", F.concat(F.lit("Last Type of Access: organic"), keywords))
        .when(cmd == "", plain).otherwise(F.concat(F.lit("Last Type of Access: "), ccn, keywords))
    )
    return _line("Domain Hash: ", part(0), " | Last Visit: ", _seconds(part(1)), " | Sessions: ", part(2), " | Sources: ", part(3), " | ", detail, f" {GA_TAG}")


def quantcast(name: Column, value: Column) -> Column:
    ok = (name == "__qca") & value.rlike("^P0-[0-9]+-[0-9]{10,13}$")
    return F.when(ok, F.concat(friendly_date(_long(F.substring_index(value, "-", -1))), F.lit(" [Quantcast Cookie Timestamp]")))


def load_balancer(value: Column) -> Column:
    """``host.port.0000`` with a little-endian address and a byte-swapped port."""
    p = F.split(value, r"\.")
    host, port = _long(F.get(p, F.lit(0))), _long(F.get(p, F.lit(1)))
    octet = lambda n: F.shiftright(host, n).bitwiseAND(255).cast("string")
    ok = value.rlike(r"^[0-9]{8,10}\.[0-9]{1,5}\.[0-9]{4}$") & (host <= 4294967295) & (port <= 65535)
    swapped = (port.bitwiseAND(255) * 256 + F.shiftright(port, 8)).cast("string")
    return F.when(ok, F.concat(F.lit("Server IP: "), F.concat_ws(".", *[octet(n) for n in (0, 8, 16, 24)]), F.lit(" | Server Port: "), swapped, F.lit(" [BIG-IP Cookie]")))


def generic_timestamp(value: Column) -> Column:
    whole = F.when(value.rlike("^1([0-9]{9}|[0-9]{12}|[0-9]{16})$"), friendly_date(_long(value)))
    runs = F.filter(F.regexp_extract_all(F.regexp_extract(value, "(?s)timestamp(.*)$", 1), F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x).between(10, 17))
    return F.concat(F.coalesce(whole, friendly_date(_long(F.get(runs, F.lit(0))))), F.lit(" [potential timestamp]"))


#: Layouts in the order in which they're tried.
LAYOUTS = (google_analytics, quantcast, lambda _, value: load_balancer(value), lambda _, value: generic_timestamp(value))


def interpret_cookie(name: Column, value: Column) -> Column:
    """What the first layout that fits says of a cookie; null if none does."""
    return F.coalesce(*[layout(name, value) for layout in LAYOUTS])
