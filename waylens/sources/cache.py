"""Cached responses: entries of the simple cache, bodies decoded within bounds, and the index that pages are rebuilt from."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions.urls import normalize_url, resolve_ref
from waylens.plans.scratch import cut
from waylens.sources.batches import contents, gathered
from waylens.sources.stylesheets import BUDGET, base64, inlined_sheets, replaced, within_budget

#: The numbers that an entry file begins with and that end each of its streams, and flags of an end.
HEADER, END = 0xFCFB6D1BA7725C30, 0xF4FA6F45970D41D8
HAS_CHECKSUM, HAS_KEY_DIGEST = 1, 2
#: The most bytes a body may unpack to, and the most times its own size.
MOST, RATIO = 128 << 20, 1000


def decode_body(body: bytes, encoding: str) -> tuple[bytes, str | None]:
    """The body without its content encodings, and a note where that isn't the whole truth: an encoding that isn't known here
    keeps the bytes as they are, and so do broken bytes and bodies beyond the bounds."""
    limit = min(MOST, RATIO * max(1, len(body)))
    for name in [e.strip().lower() for e in reversed(encoding.split(",")) if e.strip()]:
        if name == "identity":
            continue
        try:
            if name in ("gzip", "x-gzip"):
                made = zlib.decompressobj(31)
                out = made.decompress(body, limit + 1)
            elif name == "deflate":
                try:
                    out = zlib.decompressobj().decompress(body, limit + 1)
                except zlib.error:
                    out = zlib.decompressobj(-15).decompress(body, limit + 1)
            elif name == "zstd":
                import zstandard

                out = zstandard.ZstdDecompressor().decompressobj().decompress(body) if len(body) < 64 else _zstd(body, limit)
            else:
                return body, f"encoding {name} isn't known here"
        except Exception as e:  # noqa: BLE001 - whatever a decoder says of broken bytes becomes the note
            return body, f"broken {name}: {e}"
        if len(out) > limit:
            return body, f"beyond {limit} bytes"
        body = out
    return body, None


def _zstd(body: bytes, limit: int) -> bytes:
    import io

    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True) as r:
        return r.read(limit + 1)


def response_head(data: bytes) -> tuple[int | None, list[tuple[str, str]]]:
    """Status and headers of a pickled response: the zero-separated lines that begin with ``HTTP/``."""
    at = data.find(b"HTTP/")
    if at < 0:
        return None, []
    lines = data[at:].partition(b"\0\0")[0].split(b"\0")
    first = lines[0].decode("latin-1").split()
    headers = [(k.decode("latin-1").strip(), v.decode("latin-1").strip()) for k, colon, v in (x.partition(b":") for x in lines[1:]) if colon]
    return int(first[1]) if len(first) > 1 and first[1].isdigit() else None, headers


def simple_entry(data: bytes) -> tuple[str, bytes, bytes] | None:
    """Key, response head and body of an entry file of streams 0 and 1; None for anything else.

    The streams are found from the end: head, its end record with its size, and the body's end record before it.
    """
    if len(data) < 72 or struct.unpack_from("<Q", data)[0] != HEADER:
        return None
    (key_size,) = struct.unpack_from("<I", data, 12)
    begin = 24 + key_size
    magic, flags, _, size = struct.unpack_from("<QIII", data, len(data) - 24)
    head_at = len(data) - 24 - (32 if flags & HAS_KEY_DIGEST else 0) - size
    body_end = head_at - 24
    if magic != END or body_end < begin or struct.unpack_from("<Q", data, body_end)[0] != END:
        return None
    return data[24:begin].decode("utf-8", "replace"), data[head_at : head_at + size], data[begin:body_end]


def simple_cache(files: DataFrame) -> DataFrame:
    """``source, url, status, headers, content_type, content_encoding, raw_bytes, body, note`` of entry files ``..._0``; files
    that aren't entries are left out. A key's URL is what follows its last space."""
    schema = StructType.fromDDL("source string, url string, status int, headers array<struct<name:string,value:string>>, content_type string, content_encoding string, raw_bytes bigint, body binary, note string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        def parsed():
            for path, content in contents(batches):
                entry = simple_entry(content or b"")
                if entry is None:
                    continue
                key, head, body = entry
                status, headers = response_head(head)
                named = {k.lower(): v for k, v in headers}
                decoded, note = decode_body(body, named.get("content-encoding", ""))
                yield path, key.rpartition(" ")[2], status, [{"name": k, "value": v} for k, v in headers], named.get("content-type"), named.get("content-encoding"), len(body), decoded, note

        return gathered(parsed(), arrow)

    return files.where(F.col("path").rlike("_0$")).select("path", "content").mapInArrow(run, schema)


def orphaned(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries (``source``) whose file's hash the live index (``hash``) doesn't have; without any index nothing is orphaned."""
    hashed = entries.withColumn("hash", F.lower(F.regexp_extract("source", r"([0-9A-Fa-f]{16})_0$", 1))).where("hash <> ''")
    live = index.select(F.lower("hash").alias("hash"))
    known = live.limit(1).select(F.lit(True).alias("__any"))
    return hashed.join(live, "hash", "left_anti").join(F.broadcast(known)).drop("__any", "hash")  # one row at most


def resource_index(resources: DataFrame, seq: str = "seq") -> DataFrame:
    """One resource for each normalized URL, the last by ``seq``."""
    rest = [c for c in resources.columns if c != "key"]
    last = resources.withColumn("key", normalize_url(F.col("url"))).groupBy("key").agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return last.select("key", "r.*")


#: What a page takes in: an element with the attribute that names it. Links count by their ``rel`` below.
TAKEN = {"script": r'(?i)<script[^>]*\ssrc=["\']([^"\']*)["\']', "media": r'(?i)<(?:img|source|video|audio|embed)[^>]*\ssrc=["\']([^"\']*)["\']', "style_url": r"(?i)url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"}
LINK, SRCSET = r"(?i)<link\s[^>]*>", r'(?i)\ssrcset=["\']([^"\']*)["\']'


def page_resources(pages: DataFrame) -> DataFrame:
    """``page_id, kind, ref, url``: what each page (``page_id, url, html``) needs to be shown, with its absolute URL: style sheets
    and icons, scripts, media and their alternatives, and URLs in styles."""
    tagged = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))
    all_of = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    links = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda x: x.rlike(r"(?i)\srel=[\"']?[^\"'>]*(stylesheet|icon)"))
    hrefs = F.transform(links, lambda x: F.regexp_extract(x, r'(?i)\shref=["\']?([^"\'\s>]*)', 1))
    sets = F.flatten(F.transform(all_of(SRCSET), lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(F.trim(y), r"^(\S+)", 1))))
    found = F.concat(tagged("link", hrefs), *[tagged(k, all_of(p)) for k, p in TAKEN.items()], tagged("media", sets))
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(F.array_distinct(found)).alias("r")).select("page_id", "base", "r.*").where("ref <> '' AND ref NOT LIKE 'data:%'")
    return rows.select("page_id", "kind", "ref", resolve_ref(F.col("base"), F.col("ref")).alias("url"))


def rebuilt(pages: DataFrame, index: DataFrame) -> DataFrame:
    """``page_id, kind, ref, url, found``: which of a page's resources the cache holds."""
    needed = page_resources(pages).withColumn("key", normalize_url(F.col("url")))
    held = index.select("key", F.lit(True).alias("__held"))
    return needed.join(held, "key", "left").select("page_id", "kind", "ref", "url", F.coalesce("__held", F.lit(False)).alias("found"))


def with_local_copies(pages: DataFrame, index: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``page_id, html``: pages whose script, style and media references to resources in the cache are data URLs, so that a page
    is one file; references without a resource stay.

    Style sheets come with their own references inlined (``stylesheets.inlined_sheets``). A page takes resources in the order of
    their places as long as they stay within ``budget`` bytes, which bounds what meets in its row; later ones stay as they are.
    """
    sheets, _ = inlined_sheets(index, budget)
    content = index.join(sheets, "key", "left").select("key", F.coalesce("content_type", F.lit("application/octet-stream")).alias("type"), F.coalesce(F.col("text").cast("binary"), "body").alias("body"))
    content = cut(content.withColumn("size", F.octet_length("body").cast("long")), "contents")
    needed = page_resources(pages).withColumn("key", normalize_url(F.col("url")))
    places = needed.join(pages.select("page_id", "html"), "page_id").select("page_id", "ref", "key", F.instr("html", F.col("ref")).alias("at")).distinct()
    fits = within_budget(places.join(content.select("key", "size"), "key"), "page_id", budget).where("fits")
    data = F.concat(F.lit("data:"), "type", F.lit(";base64,"), base64("body"))
    own = fits.join(content, "key").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "ref", data.alias("data")))).alias("taken"))
    rows = pages.select("page_id", "html").join(own, "page_id", "left")
    return rows.select("page_id", F.when(F.col("taken").isNull(), F.col("html")).otherwise(replaced(F.col("html"), F.col("taken"))).alias("html"))
