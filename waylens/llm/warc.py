"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed on their own, and a bundle ends with a seek table in a skippable
frame, so any frame can be read without the others and plain Zstandard readers still see one stream. An index maps each
record's id to bundle, frame and the offset within the frame. A record whose payload occurs in another record with a
larger id is a ``revisit`` of it and holds no payload.

Bundles are written by tasks to a shared folder, under names that hold the attempt: a task that runs again after a lost
executor writes files of its own, and the index (committed by Spark) names only those of attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from waylens.llm.common import materialize, scratch_path, size_cuts, text_slices, utf8_size

#: Fixed values of the seekable format: skippable frame, end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE_BYTES, FRAME_BYTES = 16 << 20, 256 << 10
#: Bundles that one task writes or reads one after the other at most (512 MiB).
TASK_BUNDLES = 32
#: Payloads that occur more than once are broadcast (some 60 bytes each) up to this number.
BROADCAST_ROWS = 500_000
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: object) -> str:
    return f"<urn:page:{'~' if page_id is None else page_id}>"


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: object, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: object = None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit (``payload`` None) of record ``refers_to``."""
    target = "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or record_id(page_id)[1:-1]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(sha1)}", f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (empty for a revisit) of a record; ValueError if it isn't one or its digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + digest(hashlib.sha1(payload).digest()) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"wrong digest in {fields['WARC-Record-ID']}")
    return fields, payload


class BundleWriter:
    """Frames of records, then the seek table; at most one frame is held."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.limit, self.zstd = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.frames = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.held and self.size + len(data) > self.limit:
            self.flush()
        at = (len(self.frames), self.size)
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle (a seekable binary file)."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        step = 12 if flags & 0x80 else 8
        source.seek(end - 9 - n * step)
        table = source.read(n * step)
        sizes = [struct.unpack_from("<II", table, i * step) for i in range(n)]
        self.starts, at = [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.sizes = sizes
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            self.source.seek(self.starts[i])
            self.last = (i, self.zstd.decompress(self.source.read(self.sizes[i][0]), max_output_size=self.sizes[i][1]))
        return self.last[1]

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _open(path: str, mode: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def _share(spark, bundles: int) -> int:
    """How many of so many bundles a task takes: few while they would leave cores idle, at most TASK_BUNDLES."""
    return max(1, min(TASK_BUNDLES, bundles // (2 * spark.sparkContext.defaultParallelism)))


def write_bundles(pages: DataFrame, folder: str, min_revisit: int = 0, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row to bundles below ``folder`` (a URI all executors share) and returns the index:
    ``page_id, record_id, bundle, frame, offset, length``.

    Null html is an empty payload. Among equal payloads of ``min_revisit`` bytes or more the largest page_id is the
    response and the others revisit it; rows that repeat that id are responses too, rows without an id revisit it if there
    is one. An empty table gives no bundle and an empty index. Other columns aren't read.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    rows = rows.select("*", utf8_size(F.col("html")).alias("size"), F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"))
    same = rows.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialize(same.where("n > 1").select(F.col("sha1").alias("__sha1"), F.col("size").alias("__size"), "first"), "warc-shared")
    if shared.count() <= BROADCAST_ROWS:  # else both sides are shuffled, and payloads with them
        shared = F.broadcast(shared)
    rows = rows.join(shared, (F.col("sha1") == F.col("__sha1")) & (F.col("size") == F.col("__size")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.lit(False))
    total = pages.agg(F.sum(utf8_size(F.col(f"`{html_col}`")) + 512)).first()[0] or 0
    n = max(1, -(-total // bundle_bytes))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("html").cast("binary")).alias("payload"), "size", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), F.pmod(F.xxhash64("page_id", "sha1"), F.lit(n)).cast("int").alias("bundle"))
    id_type = pages.schema[id_col].dataType
    schema = StructType([StructField("page_id", id_type), *StructType.fromDDL("record_id string, bundle string, frame int, offset bigint, length bigint").fields])
    arrow = to_arrow_schema(schema)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path, writer = None, "", None
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for part in text_slices(batch, 256, 2):
                index = []
                for page_id, url, payload, size, sha1, refers_to, bundle in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bundle != at:
                        if writer:
                            writer.close()
                        at, path = bundle, f"{folder}/bundle-{bundle:06d}-{attempt}.warc.zst"
                        writer = BundleWriter(_open(path, "w"), frame_bytes)
                    data = record(page_id, url, payload, size, sha1, refers_to)
                    index.append((page_id, record_id(page_id), path, *writer.add(data), len(data)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*index, strict=True), arrow, strict=True)], schema=arrow)
        if writer:
            writer.close()

    # a task writes its bundles one after the other
    share = _share(pages.sparkSession, n)
    spread = rows.repartitionById(-(-n // share), F.floor(F.col("bundle") / share).cast("int")).sortWithinPartitions("bundle", "page_id")
    return materialize(spread.mapInArrow(write, schema), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Reads every record that ``index`` names back from its bundle, frame by frame, and tests its id and digest:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``."""
    id_type = index.schema["page_id"].dataType
    schema = StructType([StructField("page_id", id_type), *StructType.fromDDL("payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary").fields])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            for start, n in size_cuts(batch.column("length").to_pylist(), 256):
                out = []
                for page_id, rid, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.slice(start, n).columns), strict=True):
                    if bundle != path:
                        path, reader = bundle, BundleReader(_open(bundle, "r"))
                    fields, payload = parse_record(reader.read(frame, offset, length))
                    if fields["WARC-Record-ID"] != rid:
                        raise ValueError(f"{rid} is not at its place in {bundle}")
                    refers = fields.get("WARC-Refers-To")
                    out.append((page_id, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], refers and refers[10:-1], fields["WARC-Target-URI"], payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    number = F.coalesce(F.regexp_extract("bundle", "bundle-([0-9]+)-[0-9]+[.]warc", 1).try_cast("int"), F.pmod(F.xxhash64("bundle"), F.lit(1 << 16)).cast("int"))
    rows = index.select("page_id", "record_id", "bundle", "frame", "offset", "length").withColumn("number", number)
    n = (rows.agg(F.max("number")).first()[0] or 0) + 1
    share = _share(index.sparkSession, n)
    ordered = rows.repartitionById(-(-n // share), F.floor(F.col("number") / share).cast("int")).sortWithinPartitions("bundle", "frame", "offset").drop("number")
    found = ordered.mapInArrow(read, schema)
    return found.withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` to bundles and returns what the bundles hold."""
    return read_records(write_bundles(pages, folder or scratch_path(pages.sparkSession, "warc"), **options))
