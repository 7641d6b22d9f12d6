"""LevelDB folders and the web storage in them: logs and tables decoded file by file, records joined by Spark."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions import times as tm
from waylens.sources.readers import events

#: The size of a log's blocks, the number a table ends with, and kinds of storage.
LOG_BLOCK, TABLE_END = 32768, 0xDB4775248B80FB57
LOCAL, SESSION = "local_storage", "session_storage"


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned number of seven bits a byte, and where it ends."""
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def _sized(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = varint(data, at)
    if at + n > len(data):
        raise IndexError("a value beyond the end")
    return data[at : at + n], at + n


def log_batches(data: bytes) -> Iterator[bytes]:
    """The write batches of a log; parts of one that isn't whole are passed over."""
    held: list[bytes] = []
    for start in range(0, len(data), LOG_BLOCK):
        block, at = data[start : start + LOG_BLOCK], 0
        while at + 7 <= len(block):
            _, size, kind = struct.unpack_from("<IHB", block, at)
            part = block[at + 7 : at + 7 + size]
            at += 7 + size
            if kind not in (1, 2, 3, 4) or len(part) < size:
                break
            if kind in (1, 2):
                held = []
            held.append(part)
            if kind in (1, 4):
                yield b"".join(held)
                held = []


def batch_records(batch: bytes) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Key, value (None: deleted) and number of each record of a write batch."""
    if len(batch) < 12:
        return
    seq, count = struct.unpack_from("<QI", batch)
    at = 12
    try:
        for i in range(count):
            put = batch[at] == 1
            key, at = _sized(batch, at + 1)
            value = None
            if put:
                value, at = _sized(batch, at)
            yield key, value, seq + i
    except IndexError:
        return


def _block(data: bytes, at: int, size: int) -> bytes:
    raw = data[at : at + size]
    if data[at + size] == 1:
        n, _ = varint(raw, 0)
        return pa.Codec("snappy").decompress(raw, n).to_pybytes()
    return raw


def _entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    (restarts,) = struct.unpack_from("<I", block, len(block) - 4)
    end, at, key = len(block) - 4 - 4 * restarts, 0, b""
    while at < end:
        shared, at = varint(block, at)
        own, at = varint(block, at)
        size, at = varint(block, at)
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + size]
        at += own + size


def table_records(data: bytes) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Key, value (None: deleted) and number of each record of a sorted table."""
    if len(data) < 48 or struct.unpack_from("<Q", data, len(data) - 8)[0] != TABLE_END:
        return
    at = len(data) - 48
    for _ in range(2):
        _, at = varint(data, at)
    index, at = varint(data, at)
    size, _ = varint(data, at)
    for _, handle in _entries(_block(data, index, size)):
        begin, where = varint(handle, 0)
        for key, value in _entries(_block(data, begin, varint(handle, where)[0])):
            (number,) = struct.unpack("<Q", key[-8:])
            yield key[:-8], None if number & 255 == 0 else value, number >> 8


def records(files: DataFrame) -> DataFrame:
    """``source, key, value, seq, deleted`` of the logs and tables of LevelDB folders (``path, content``); ``source`` is the
    folder. What follows a broken place in a file is left out."""
    schema = StructType.fromDDL("source string, key binary, value binary, seq bigint, deleted boolean")
    arrow = to_arrow_schema(schema)

    def decoded(path: str, data: bytes) -> Iterator[tuple]:
        try:
            if path.endswith(".log"):
                for batch in log_batches(data):
                    yield from batch_records(batch)
            else:
                yield from table_records(data)
        except (IndexError, struct.error, OSError):
            return

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder, out = path.rpartition("/")[0], []
                for key, value, seq in decoded(path, content.as_py() or b""):
                    out.append((folder, key, value, seq, value is None))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return files.where(F.col("path").rlike(r"\.(log|ldb|sst)$")).select("path", "content").mapInArrow(run, schema)


def _text(data: bytes | None) -> str | None:
    """A stored string: a byte for its encoding (0 UTF-16, 1 Latin-1), then its characters."""
    if not data:
        return None
    return data[1:].decode("utf-16-le" if data[0] == 0 else "latin-1", "replace")


def _shaped(rows: DataFrame, ddl: str, shape) -> DataFrame:
    """``source, seq, deleted`` and what ``shape(key, value)`` makes of a record, as columns of ``ddl``."""
    schema = StructType.fromDDL(f"source string, seq bigint, deleted boolean, {ddl}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                source, key, value, seq, deleted = (c.to_pylist() for c in batch.columns)
                made = [shape(k, v) for k, v in zip(key, value, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([source, seq, deleted, *zip(*made, strict=True)], arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _other(rows: DataFrame, storage: str) -> DataFrame:
    own = rows.where("kind = 'other'")
    label = F.concat(F.lit(f"unrecognized {storage} record (key "), F.octet_length("raw").cast("string"), F.lit(" bytes)"))
    return events(own, F.lit(0), "Chromium", "LocalStorage", label, storage_type=F.lit(storage), record=F.lit("other"), key_hex=F.lower(F.hex("raw")), seq=F.col("seq"), deleted=F.col("deleted"))


def local_storage(files: DataFrame) -> DataFrame:
    """An event for each record of a site's local storage, deleted ones too, at the time of the origin's latest live META."""
    def shape(key: bytes, value: bytes | None) -> tuple:
        if key.startswith(b"META:"):
            when = None
            if value and value[0] == 8:  # field 1, a number
                when, _ = varint(value + b"\0", 1)
            return "meta", key[5:].decode("utf-8", "replace"), None, None, when if when is None or when < 1 << 63 else (1 << 63) - 1, key
        origin, zero, name = key[1:].partition(b"\0")
        if key[:1] == b"_" and zero:
            return "data", origin.decode("utf-8", "replace"), _text(name), _text(value), None, key
        return "other", None, None, None, None, key

    rows = _shaped(records(files), "kind string, origin string, name string, text string, micros bigint, raw binary", shape)
    meta = rows.where("kind = 'meta' AND NOT deleted").groupBy("source", "origin").agg(F.max_by("micros", "seq").alias("when"))
    data = rows.where("kind = 'data'").join(meta, ["source", "origin"], "left")
    name, text = F.coalesce("name", F.lit("")), F.coalesce("text", F.lit(""))
    ns = F.coalesce(tm.webkit_micros(F.col("when")), F.lit(0))
    found = events(
        data, ns, "Chromium", "LocalStorage", F.concat("origin", F.lit(" — "), name, F.lit(" = "), text), storage_type=F.lit(LOCAL), record=F.lit("data"), origin=F.col("origin"), key=name, seq=F.col("seq"), deleted=F.col("deleted"), value=text,
    )
    return found.unionByName(_other(rows, LOCAL))


def session_storage(files: DataFrame) -> DataFrame:
    """An event for each record of session storage, with the host that its map belongs to by the latest namespace record."""
    def shape(key: bytes, value: bytes | None) -> tuple:
        text = key.decode("utf-8", "replace")
        kind, _, rest = text.partition("-")
        if kind == "map" and "-" in rest:
            number, _, name = rest.partition("-")
            return "map", number, None, name, (value or b"").decode("utf-16-le", "replace"), key
        if kind == "namespace" and "-" in rest:  # namespace-<id with dashes turned>-<host>
            return "namespace", (value or b"").decode("utf-8", "replace"), rest.partition("-")[2], None, None, key
        return "other", None, None, None, None, key

    rows = _shaped(records(files), "kind string, map string, host string, name string, text string, raw binary", shape)
    hosts = rows.where("kind = 'namespace' AND NOT deleted").groupBy("source", "map").agg(F.max_by("host", "seq").alias("owner"))
    data = rows.where("kind = 'map'").join(hosts, ["source", "map"], "left")
    found = events(
        data, F.lit(0), "Chromium", "LocalStorage", F.concat(F.coalesce("owner", F.lit("<unknown host>")), F.lit(" — "), "name", F.lit(" = "), "text"), storage_type=F.lit(SESSION), record=F.lit("map"), map_id=F.col("map"), host=F.col("owner"), key=F.col("name"),
        seq=F.col("seq"), deleted=F.col("deleted"), value=F.col("text"),
    )
    return found.unionByName(_other(rows, SESSION))
