"""Search: filters over event fields, terms, blocklists and find hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waylens.functions.urls import domain_suffixes, host_of
from waylens.plans.model import ENVELOPE, attribute, with_kinds
from waylens.plans.scratch import cut

#: A URL in running text.
URL = r"https?://[^\s\"'<>]+"

#: A bound that callers may give for a field, in UTF-8 bytes.
FIELD_LIMIT = 1 << 20
#: Characters of the grams that terms are indexed by, and rows of terms or grams that are broadcast at most (some 50 bytes each).
GRAM, BROADCAST_ROWS = 4, 400_000
#: Attributes that name what an event is about, the most telling first, and those that hold bare hosts.
LOCATORS = ("url", "domain", "origin", "target_path")
BARE_HOSTS = ("host", "domain", "report_to_host")


def bounded(c: Column, limit: int | None) -> Column:
    """The characters that lie whole in the first ``limit`` UTF-8 bytes; all of them without a limit."""
    if limit is None:
        return c
    raw = c.cast("binary")
    # a byte 10xxxxxx behind the cut says that it falls into a character, which then goes
    inside = F.hex(F.substring(raw, limit + 1, 1)).rlike("^[89AB]")
    head = F.substring(raw, 1, limit)
    return F.when(F.octet_length(c) <= limit, c).when(inside, F.regexp_replace(F.make_valid_utf8(head), "\uFFFD+$", "")).otherwise(head.cast("string"))


def matches(pattern: str, fields: list[str], regex: bool = False, limit: int | None = None) -> Column:
    """Whether one of the columns has the pattern, case-sensitively, in its first ``limit`` bytes or anywhere."""
    out = F.lit(False)
    for f in fields:
        c = bounded(F.col(f), limit)
        out = out | F.coalesce(c.rlike(pattern) if regex else c.contains(pattern), F.lit(False))
    return out


def text_fields(events: DataFrame, fields: list[str] | None = None, limit: int | None = None) -> Column:
    """The searchable fields of an event as structs ``field, text``: description, source and each attribute that is text.
    Numbers, booleans and nested values of ``attrs_json`` aren't text; columns beside the envelope count if they are
    strings."""
    named = [F.struct(F.lit(c).alias("field"), bounded(F.col(c), limit).alias("text")) for c in ("description", "source") if c in events.columns]
    known = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    if "attrs_json" in known:
        typed = F.map_entries(F.from_json("attrs_json", "map<string,variant>"))
        strings = F.filter(typed, lambda e: F.schema_of_variant(e["value"]) == "STRING")
        own = F.transform(strings, lambda e: F.struct(e["key"].alias("field"), bounded(e["value"].cast("string"), limit).alias("text")))
        every = F.concat(F.array(*named), F.coalesce(own, F.array().cast("array<struct<field:string,text:string>>")))
    else:
        named += [F.struct(F.lit(c).alias("field"), bounded(F.col(f"`{c}`"), limit).alias("text")) for c, t in known.items() if c not in ENVELOPE and t == "string"]
        every = F.array(*named)
    every = F.filter(every, lambda x: x["text"].isNotNull())
    return F.filter(every, lambda x: x["field"].isin(*fields)) if fields else every


def filter_events(events: DataFrame, pattern: str | None = None, fields: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None, regex: bool = False, limit: int | None = None) -> DataFrame:
    """Events in an inclusive time range with the pattern in one of ``fields``, or in any of their text without them.

    The time range is pushed to the scan; where all ``fields`` are columns, so is the pattern.
    """
    if start_ns is not None:
        events = events.where(F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        events = events.where(F.col("timestamp_ns") <= end_ns)
    if pattern is None:
        return events
    if fields and all(f in events.columns for f in fields):
        return events.where(matches(pattern, fields, regex, limit))
    return events.where(F.exists(text_fields(events, fields, limit), lambda x: x["text"].rlike(pattern) if regex else x["text"].contains(pattern)))


def needle(events: DataFrame, text: str) -> DataFrame:
    """Events whose url or title has ``text`` in any case; those with neither go."""
    held = [F.lower(attribute(events, k)).contains(text.lower()) for k in ("url", "title")]
    return events.where(F.coalesce(held[0], F.lit(False)) | F.coalesce(held[1], F.lit(False)))


def best_match(events: DataFrame) -> Column:
    """What an event is about: its url, domain, origin or target, the first that isn't empty, else its description."""
    held = [attribute(events, k) for k in LOCATORS]
    return F.coalesce(*[F.when(c != "", c) for c in held], F.col("description"))


def read_terms(spark: SparkSession, *paths: str) -> DataFrame:
    """``term``: the lines of text files without the blanks around them, once each; empty lines and comments go."""
    line = F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return spark.read.text(list(paths)).select(line.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of a text, found in one pass over it; a shorter text has none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def few_rows(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, which were written before, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def term_matches(texts: DataFrame, terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``seq, field, term`` of every text ``seq, field, text`` and ``term`` that it contains, case-sensitively.

    An inverted index over the terms: each is known by its rarest gram of GRAM characters (counted over all texts; a term
    with a gram that no text has matches nothing), texts are joined by their grams, and what meets is verified. So the plan
    doesn't grow with the terms, and a text meets few of them in vain. Terms of fewer than GRAM characters are
    grams themselves. Terms and grams are broadcast if there are at most ``most``; with more, rows of text numbers
    and grams are shuffled, never the texts. Null texts and terms match nothing, an empty term neither; a repeated
    term counts once, repeated texts each time.
    """
    listed = cut(terms.where("term <> ''").select("term").distinct(), "terms")
    sizes = {r["size"] for r in listed.select(F.least(F.length("term"), F.lit(GRAM)).alias("size")).distinct().collect()}  # GRAM values
    rows = texts.where("text IS NOT NULL").select("seq", "field", "text")
    out = rows.limit(0).select("seq", "field", F.col("text").alias("term"))
    for size in sorted(sizes - {GRAM}):
        short = listed.where(F.length("term") == size)
        out = out.unionByName(rows.select("seq", "field", F.explode(grams(F.col("text"), size)).alias("term")).join(few_rows(short, most), "term"))
    if GRAM not in sizes:
        return out
    owned = cut(listed.where(F.length("term") >= GRAM).select("term", F.explode(grams(F.col("term"))).alias("gram")), "term-grams")
    asked = few_rows(cut(owned.select("gram").distinct(), "asked-grams"), most)
    seen = rows.select(F.explode(grams(F.col("text"))).alias("gram")).join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counted = owned.join(seen, "gram", "left").select("term", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    rarest = cut(counted.groupBy("term").agg(F.min("g").alias("g")).where("g.n > 0").select("term", "g.gram"), "rarest-grams")
    if rarest.count() <= most:
        met = rows.select("seq", "field", "text", F.explode(grams(F.col("text"))).alias("gram")).join(F.broadcast(rarest), "gram")
    else:
        placed = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered-texts")
        pairs = placed.select("__row", F.explode(grams(F.col("text"))).alias("gram")).join(rarest, "gram").select("__row", "term")
        met = pairs.join(placed, "__row")
    return out.unionByName(met.where(F.contains(F.col("text"), F.col("term"))).select("seq", "field", "term"))


def find_many(events: DataFrame, terms: DataFrame, fields: list[str] | None = None, limit: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """What ``find_hits`` gives, for a table of terms of any size: a row for each event and ``term`` that it contains. Terms are looked
    for in each different text once; events get them by their texts, as one list that becomes rows at the very end: what else a
    hit says is computed once an event."""
    plain = "attrs_json" not in events.columns and {c for c, t in events.dtypes if t == "string" and (c in ("description", "source") or c not in ENVELOPE)}
    if plain and fields and len(fields) == 1 and fields[0] in plain:  # an event has one text: no list, no repeated hits
        texts = events.withColumn("__text", bounded(F.col(fields[0]), limit))
        return _hits(texts.join(_of_texts(texts.select("__text"), terms, most), "__text").drop("__text"), F.explode("__terms"), best_match(events), None)
    texts = events.select("seq", F.explode(text_fields(events, fields, limit)).alias("x")).select("seq", F.col("x.text").alias("__text"))
    found = texts.join(_of_texts(texts.select("__text"), terms, most), "__text").groupBy("seq").agg(F.array_distinct(F.flatten(F.collect_list("__terms"))).alias("__terms"))
    return _hits(events.join(found, "seq"), F.explode("__terms"), best_match(events), None)


def _of_texts(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """``__text, __terms`` of each different text that has terms."""
    different = cut(texts.distinct().select(F.monotonically_increasing_id().alias("seq"), F.lit("").alias("field"), F.col("__text").alias("text")), "different-texts")
    found = term_matches(different, terms, most).groupBy("seq").agg(F.collect_list("term").alias("__terms"))
    return different.join(found, "seq").select(F.col("text").alias("__text"), "__terms")


def find_hits(events: DataFrame, terms: list[str], fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A row for each event and term that it contains, with the provenance of its artifact. One pass for a few terms, each a
    condition of the plan; ``find_many`` takes any number."""
    if fields and all(f in events.columns for f in fields):
        held = [F.when(matches(t, fields, limit=limit), F.lit(t)) for t in terms]
        rows = events.withColumn("term", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())))
    else:
        texts = events.withColumn("__texts", text_fields(events, fields, limit))
        has = lambda t: F.exists("__texts", lambda x: x["text"].contains(t))
        held = [F.when(has(t), F.lit(t)) for t in terms]
        rows = texts.withColumn("term", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull()))).drop("__texts")
    return _hits(rows, "term", best_match(events), None)


def _hits(rows: DataFrame, term: str | Column, match: Column, action: str | None) -> DataFrame:
    known = with_kinds(rows.withColumn("match", match), "src", "state", "basis", "action", "confidence", "rule_id")
    return known.select("seq", (F.col(term) if isinstance(term, str) else term).alias("term"), "timestamp_ns", "browser", "match", F.col("src").alias("evidence_source"), "state", "basis", (F.lit(action) if action else F.col("action")).alias("action"), "confidence", "rule_id")


def indicator_hits(events: DataFrame, found: DataFrame) -> DataFrame:
    """Hits of indicators ``seq, kind, value``: the kind is the term, and whatever the artifact claims, a string that is
    there was only observed."""
    return _hits(events.join(found.select("seq", "kind", "value"), "seq"), "kind", F.col("value"), "observed_string")


def carved_hits(carved: DataFrame, terms: list[str]) -> DataFrame:
    """``row, term, match`` of recovered rows ``row, fields`` (a map of texts): the url that has the term, else the last
    other field by name that has it, else the whole row as JSON."""
    whole = F.to_json("fields")
    urls = lambda t: F.filter(F.map_entries("fields"), lambda e: (F.lower(e["key"]) == "url") & e["value"].contains(t))
    others = lambda t: F.sort_array(F.filter(F.map_entries("fields"), lambda e: (F.lower(e["key"]) != "url") & e["value"].contains(t)))
    held = [
        F.struct(F.lit(t).alias("term"), F.coalesce(F.get(urls(t), F.lit(0))["value"], F.try_element_at(others(t), F.lit(-1))["value"], F.when(whole.contains(t), whole)).alias("match"))
        for t in terms
    ]
    return carved.select("row", F.explode(F.array(*held)).alias("h")).select("row", "h.*").where("match IS NOT NULL")


def event_hosts(events: DataFrame, limit: int | None = None) -> DataFrame:
    """``seq, field, host``: the host of every URL in any text of an event, and bare hosts of the attributes that hold one."""
    rows = events.select("seq", F.explode(text_fields(events, None, limit)).alias("x")).select("seq", "x.*")
    bare = F.col("field").isin(*BARE_HOSTS) & ~F.col("text").contains("://")
    urls = F.transform(F.regexp_extract_all("text", F.lit(URL), F.lit(0)), lambda u: F.lower(host_of(u)))
    hosts = F.when(bare, F.array(F.lower(F.trim("text")))).otherwise(urls)
    return rows.select("seq", "field", F.explode(hosts).alias("host")).where("host <> ''")


def normalized_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct lower-case domains of a list with blanks and comments."""
    d = F.lower(F.trim(F.col("value")))
    return lines.select(F.regexp_replace(d, r"^\.+|\.+$", "").alias("domain")).where((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def blocklist_hits(rows: DataFrame, host: Column, blocklist: DataFrame) -> DataFrame:
    """Rows whose host is a listed domain or below one: an equi-join on the host's suffixes, not a scan of the list."""
    return rows.withColumn("host", host).withColumn("domain", F.explode(domain_suffixes(F.col("host")))).join(blocklist, "domain")
