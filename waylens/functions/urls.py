"""URLs and hosts: host, registrable domain, query pairs, search terms, interpretations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels of country registries, and the attributes that hold URLs or bare hosts.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "mil", "gob", "go", "ne", "or", "in", "govt", "school")
URL_FIELDS = ("url", "page_url", "referrer_url", "origin", "final_url", "target_url", "opener_url")
HOST_FIELDS = ("host", "domain", "report_to_host", "hostname")
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
_BARE = r"^(?:[^/?#]*@)?(\[[^/?#]*|[^/?#:@]*)"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def host_of(value: Column) -> Column:
    """Lower-case host of a URL or a bare host; null if there is none."""
    v = F.trim(value)
    bare = F.regexp_replace(F.trim(F.regexp_extract(v, _BARE, 1)), r"^\.+|\.+$", "")
    return _none_if_empty(F.lower(F.when(v.contains("://"), F.regexp_extract(v, _AUTHORITY, 1)).otherwise(bare)))


def is_ip_literal(host: Column) -> Column:
    return host.contains(":") | host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three below a country code's registry label; IP literals stay."""
    h = _none_if_empty(F.lower(F.regexp_replace(F.trim(host), r"^\.+|\.+$", "")))
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    last, second, third = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-3))
    country = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    return F.when(h.isNull(), h).when(is_ip_literal(h), h).when(F.size(labels) <= 2, h).when(country, F.concat_ws(".", third, second, last)).otherwise(F.concat_ws(".", second, last))


def domain_of(value: Column) -> Column:
    return registrable_domain(host_of(value))


def attribute_domains(attrs: Column) -> Column:
    """Distinct registrable domains of an event's attributes, in the fields' order."""
    found = F.array(*[domain_of(F.try_element_at(attrs, F.lit(k))) for k in (*URL_FIELDS, *HOST_FIELDS)])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def primary_domain(attrs: Column) -> Column:
    """Registrable domain of the first field that yields one."""
    return F.coalesce(*[domain_of(F.try_element_at(attrs, F.lit(k))) for k in (*URL_FIELDS, *HOST_FIELDS)])


def query_of(url: Column) -> Column:
    return _none_if_empty(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def fragment_of(url: Column) -> Column:
    return _none_if_empty(F.regexp_extract(url, r"#(.*)$", 1))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _pairs(text: Column, separator: str) -> Column:
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")))


def url_pairs(url: Column) -> Column:
    """Decoded pairs of the query, then of the fragment."""
    return F.concat(_pairs(query_of(url), "&"), _pairs(fragment_of(url), "&"))


def bound(values: list[Column], use: Callable[[list[Column]], Column]) -> Column:
    """``use`` of the values, each computed once however often it is used: as fields of a lambda's variable."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(held, lambda x: use([x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def first_value(pairs: Column, key: str) -> Column:
    """The first value of a key; null if the key is absent."""
    return F.get(F.filter(pairs, lambda x: x["k"] == key), F.lit(0))["v"]


#: Search engines by their hosts, and the keys of their terms. The last one stands for all other hosts.
ENGINES = (
    ("Google", r"^www\.google(\.|$)|(^|\.)google\.com$", ("q",)),
    ("Bing", r"(^|\.)bing\.com$", ("q",)),
    ("DuckDuckGo", r"(^|\.)duckduckgo\.com$", ("q",)),
    ("YouTube", r"(^|\.)youtube(-nocookie)?\.com$", ("search_query",)),
    ("Amazon", r"amazon\.", ("k", "field-keywords")),
    ("Generic", "", ("q", "p", "query", "search")),
)


def search_query(url: Column) -> Column:
    """Struct ``engine, term`` of a search URL; null for others."""
    return bound([host_of(F.when(url.contains("://"), url)), url_pairs(url)], lambda v: _search(*v))


def _search(host: Column, pairs: Column) -> Column:
    terms = []
    for engine, hosts, keys in ENGINES:
        term = F.coalesce(*[_none_if_empty(first_value(pairs, k)) for k in keys])
        terms.append((host.rlike(hosts), F.when(term.isNotNull(), F.struct(F.lit(engine).alias("engine"), term.alias("term")))))
    own = F.when(*terms[0])
    for test, found in terms[1:-1]:
        own = own.when(test, found)
    return F.when(host.isNotNull(), F.coalesce(own, terms[-1][1]))


def query_string(url: Column) -> Column:
    """``key: value`` pairs of the query, first value of each key, empty ones left out."""
    pairs = F.filter(_pairs(query_of(url), "[&;]"), lambda x: (x["k"] != "") & (x["v"] != ""))
    start = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(pairs, start, lambda a, x: F.when(F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.concat(a, F.array(x))))
    text = F.array_join(F.transform(first, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), " | ")
    return F.when(url.contains("://") & (text != ""), F.concat(text, F.lit(" [Query String Parser]")))


#: Units of a span of time, kinds of results, places in a list of suggestions, and what each option of a
#: search says, in their order: its keys, a text with a place for each, and what a value is called (any other, last).
UNITS = {"s": "second", "n": "minute", "h": "hour", "d": "day", "w": "week", "m": "month", "y": "year"}
RESULTS = {"dfn": "Dictionary definition", "clir": "Translated sites", "li": "Verbatim results", "vid": "Video results", "nws": "News results", "sbd": "Sorted by date"}
ORDINALS = ("zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
OPTIONS = (
    (("pws",), "Google personalization turned {}", ("1", "on", "off")),
    (("num",), "Showing {} results per page", None),
    (("filter",), "{} results filter on", ("1", "Omitted", "Similar")),
    (("btnl",), '"I\'m Feeling Lucky" search {}', ("1", "on", "off")),
    (("safe",), "SafeSearch: {}", None),
    (("as_qdr",), "past", None),
    (("tbs",), "results", None),
    (("biw", "bih"), "Browser screen {}x{}", None),
    (("pq",), "previous", None),
    (("oq", "aq"), "typed", None),
    (("as_sitesearch",), "Search only {}", None),
    (("as_filetype",), "Show only {} files", None),
    (("sourceid",), "Using {}", None),
)


def _filled(template: str, values: list[Column]) -> Column:
    """A text with values in its places; null if one is null."""
    pieces = [F.lit(p) for p in template.split("{}")]
    return F.concat(pieces[0], *[x for pair in zip(values, pieces[1:], strict=True) for x in pair])


def _past(c: Column) -> Column:
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.substring(c, 1, 1))
    n = F.regexp_extract(c, r"^.([0-9]*)", 1)
    return F.when(n == "", _filled("Results in the past {}", [unit])).otherwise(_filled("Results in the past {} {}s", [n, unit]))


def _results(c: Column) -> Column:
    kinds = {"img": "Sites with images"} | {k + end: label for k, label in RESULTS.items() for end in ("", ":1")}
    ends = [F.regexp_extract(F.regexp_replace(c, "^cdr:1,", ""), f"{k}:([^,]*)", 1) for k in ("cd_min", "cd_max")]
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), c)
    return F.when(c.startswith("qdr:"), _past(F.regexp_replace(c, "^qdr:", ""))).when(c.startswith("cdr:1,"), _filled("Results in custom range {} - {}", ends)).otherwise(named)


def google_search(url: Column) -> Column:
    """Terms and options of a Google search URL."""
    host, fragment = host_of(F.when(url.contains("://"), url)), F.coalesce(fragment_of(url), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    is_search = host.rlike(r"^www\.google(\.|$)") & (path.isin("/search", "/webhp") | fragment.rlike("^q(=|$)"))
    return F.when(is_search, bound([url_pairs(url)], lambda v: bound([v[0], first_value(v[0], "q")], lambda w: _google(*w))))


def _google(pairs: Column, q: Column) -> Column:
    def said(keys: tuple[str, ...], text: str, called: tuple[str, str, str] | None) -> Column:
        return bound([first_value(pairs, k) for k in keys], lambda values: filled(values, text, called))

    def filled(values: list[Column], text: str, called: tuple[str, str, str] | None) -> Column:
        if text == "past":
            return _past(values[0])
        if text == "results":
            return _results(values[0])
        if text == "previous":
            return F.when(values[0] != q, _filled('Previous query: "{}"', values))
        if text == "typed":
            place = F.get(F.array(*[F.lit(x) for x in ORDINALS]), values[1].try_cast("int"))
            return F.when(values[0] != q, _filled('Typed "{}" before clicking on {}', [values[0], F.coalesce(_filled("the {} suggestion", [place]), F.lit("a suggestion"))]))
        if called:
            values = [F.when(values[0] == called[0], called[1]).when(values[0].isNotNull(), called[2])]
        return _filled(text, values)

    base = _filled('Searched for "{}"', [q])
    shown = bound([F.concat_ws(" | ", *[said(*option) for option in OPTIONS])], lambda v: F.when(v[0] == "", base).otherwise(F.concat(base, F.lit(" [ "), v[0], F.lit("]"))))
    return F.when(q.isNotNull(), shown)


def interpret_url(url: Column) -> Column:
    return F.coalesce(google_search(url), query_string(url))


def redact_url(url: Column) -> Column:
    """The URL up to its query or fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def normalize_url(url: Column) -> Column:
    """The URL without its fragment, the key of cached resources."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def domain_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots: what a blocklist entry may equal."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def classify_term(term: Column) -> Column:
    """Kind of a search term: url, ipv4, ipv6, md5, sha1, sha256, domain or literal."""
    t = F.trim(term)
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    group = r"[0-9A-Fa-f]{1,4}"
    ipv6 = rf"^(({group}:){{7}}{group}|({group}:){{1,7}}:|({group}:){{1,6}}:{group}|({group}:){{1,5}}(:{group}){{1,2}}|({group}:){{1,4}}(:{group}){{1,3}}|({group}:){{1,3}}(:{group}){{1,4}}|({group}:){{1,2}}(:{group}){{1,5}}|{group}:(:{group}){{1,6}}|:(:{group}){{1,7}}|::)$"
    domain = r"^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
    hexadecimal = t.rlike(r"^[0-9A-Fa-f]+$")
    return (
        F.when(t.contains("://"), "url").when(t.rlike(rf"^{octet}(\.{octet}){{3}}$"), "ipv4").when(t.rlike(ipv6), "ipv6")
        .when(hexadecimal & (F.length(t) == 32), "md5").when(hexadecimal & (F.length(t) == 40), "sha1").when(hexadecimal & (F.length(t) == 64), "sha256")
        .when(t.rlike(domain) & (F.length(t) <= 253), "domain").otherwise("literal")
    )


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def resolve_ref(base: Column, reference: Column) -> Column:
    """The absolute URL of a reference in a page at ``base``, without its fragment; null for an empty one, and for a relative
    one where the base is no URL. Dot segments are resolved."""
    ref = F.trim(reference)
    part = lambda c, i: F.regexp_extract(c, _PARTS, i)
    scheme, host, path, query = (part(ref, i) for i in (1, 2, 3, 4))
    own_scheme, own_host, own_path, own_query = (part(F.trim(base), i) for i in (1, 2, 3, 4))
    folder = F.regexp_replace(own_path, "[^/]*$", "")
    merged = F.when(path == "", own_path).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    asked = F.when((path == "") & (query == ""), own_query).otherwise(query)
    absolute = (
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"), F.lower(host), F.when(host != "", _rooted(path)).otherwise(path), query))
        .when((own_scheme != "") & (own_host != ""), F.when(host != "", F.concat(F.lower(own_scheme), F.lit(":"), F.lower(host), _rooted(path), query)).otherwise(F.concat(F.lower(own_scheme), F.lit(":"), F.lower(own_host), _rooted(merged), asked)))
    )
    return F.when(ref != "", absolute)


def _rooted(path: Column) -> Column:
    """An absolute path without dot segments."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def authority_host(url: Column) -> Column:
    """The host as it stands in a URL, in its own case; null without an authority. Integrity rules compare it so."""
    return _none_if_empty(F.regexp_extract(url, r"^[^:]*://(?:[^/?#]*@)?([^/?#:@]*)", 1))
