"""Safari's URL cache: responses with their receivers and blobs, bodies in the database or in files beside it."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from waylens.sources.cache import decode_body
from waylens.sources.manifest import opened
from waylens.sources.sqlite import sqlite_tables

TABLES = {
    "cfurl_cache_response": "entry_ID bigint, request_key string", "cfurl_cache_receiver_data": "entry_ID bigint, isDataOnFS bigint, receiver_data binary", "cfurl_cache_blob_data": "entry_ID bigint, response_object binary",
}
FOLDER = "fsCachedData"
RESPONSE = StructType([StructField("status", IntegerType()), StructField("content_type", StringType()), StructField("content_encoding", StringType())])
#: The first bytes of bodies that are still packed; bodies of other encodings are tried.
PACKED = {"gzip": b"\x1f\x8b", "x-gzip": b"\x1f\x8b", "zstd": b"\x28\xb5\x2f\xfd"}


@F.pandas_udf(RESPONSE)
def response_facts(objects: pd.Series) -> pd.DataFrame:
    """Status, type and encoding of archived responses: entries 3, 4 and 6 of their array; nulls where they don't parse."""
    import plistlib

    def facts(raw: bytes | None) -> tuple:
        try:
            held = plistlib.loads(raw)["Array"]
            headers = {k.lower(): str(v) for k, v in held[4].items()} if len(held) > 4 and isinstance(held[4], dict) else {}
            kind = held[6] if len(held) > 6 and isinstance(held[6], str) else headers.get("content-type")
            return (int(held[3]) if len(held) > 3 and isinstance(held[3], int) else None, kind, headers.get("content-encoding"))
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, plistlib.InvalidFileException):
            return (None, None, None)

    return pd.DataFrame([facts(x) for x in objects], columns=["status", "content_type", "content_encoding"]).astype({"status": "Int32"})


def contents(paths: DataFrame) -> DataFrame:
    """``path, content`` of the files that ``path`` names, opened where they're needed; null for one that can't be read."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "content"])

    return paths.select("path").distinct().mapInArrow(run, "path string, content binary")


def decoded(rows: DataFrame) -> DataFrame:
    """Adds ``decoded, note``: bodies unpacked, unless they were stored unpacked, as most are whatever their headers say."""
    result = StructType([*rows.schema.fields, *StructType.fromDDL("decoded binary, note string").fields])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body, encoding = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("body", "content_encoding"))
                kind = (encoding or "").strip().lower()
                out, note = body, None
                if body and kind in (*PACKED, "br", "deflate"):
                    if body.startswith(PACKED.get(kind, b"")):
                        unpacked, said = decode_body(body, kind)
                        out, note = (body, f"stored unpacked though its encoding is {kind}") if said and said.startswith("broken") else (unpacked, said)
                    else:
                        note = f"stored unpacked though its encoding is {kind}"
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([out], pa.binary()), pa.array([note], pa.string())], names=result.names)

    return rows.mapInArrow(run, result)


def safari_cache(databases: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """``source, entry, url, status, content_type, content_encoding, body, decoded, note`` of each response of ``Cache.db`` files (``path, content``).

    Receivers and blobs are joined to responses from the left, so a response without either keeps its URL. A body in a file
    beside the database is looked up by its name: only files that some row names are opened, or taken from ``bodies`` (``path,
    content``) if that is given. A named file that isn't there is said in ``note``; such a body, and that of a response without
    a receiver, is empty.
    """
    t = sqlite_tables(databases, TABLES)
    key = ["source", "entry_ID"]
    rows = t["cfurl_cache_response"].join(t["cfurl_cache_receiver_data"], key, "left").join(t["cfurl_cache_blob_data"], key, "left")
    beside = F.coalesce(F.col("isDataOnFS") != 0, F.lit(False)) & F.col("receiver_data").isNotNull()
    folder = F.regexp_replace("source", "[^/]*$", "")
    rows = rows.withColumn("path", F.when(beside, F.concat(folder, F.lit(f"{FOLDER}/"), F.make_valid_utf8("receiver_data"))))
    named = rows.where("path IS NOT NULL").select("path").distinct()
    found = contents(named) if bodies is None else bodies.join(named, "path", "left_semi").select("path", "content")
    rows = rows.join(found, "path", "left").withColumn("r", response_facts("response_object"))
    missing = F.col("path").isNotNull() & F.col("content").isNull()
    body = F.when(F.col("path").isNotNull(), F.coalesce("content", F.lit(b""))).otherwise(F.coalesce("receiver_data", F.lit(b"")))
    own = rows.select("source", F.col("entry_ID").alias("entry"), F.coalesce("request_key", F.lit("")).alias("url"), "r.status", "r.content_type", "r.content_encoding", body.alias("body"), F.when(missing, F.concat(F.lit("no file "), "path")).alias("lost"))
    return decoded(own).withColumn("note", F.coalesce("lost", "note")).drop("lost")
