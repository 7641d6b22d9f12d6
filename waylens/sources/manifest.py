"""Custody manifests: files hashed in bounded reads, the comparison of two manifests, and bundles with sums.

Files are listed without their contents and opened in the tasks that hash them, so a file may be of any size; what can't be read
is a row with its error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions.times import rfc3339
from waylens.plans.scratch import cut, spread
from waylens.sources.dispatch import DISPATCH
from waylens.sources.ordered import read_ordered, write_ordered

#: Bytes of a file that are held at a time.
BLOCK = 1 << 20
SCHEMA = "waylens.manifest.v1"


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, size_bytes, modified`` of all files below the paths, by Spark's own listing; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def evidence_of(listing: DataFrame) -> DataFrame:
    """Files of a listing that some reader knows by their names, and the logs of databases."""
    known = "|".join(DISPATCH)
    return listing.where(F.col("path").rlike(rf"(^|/)({known})(-wal)?$"))


def opened(path: str):
    """A stream over a file of any store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = path[5:].replace("//", "/", 1) if path.startswith("file://") else path[5:]
        return fs.LocalFileSystem().open_input_stream("/" + path.lstrip("/"))
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_stream(place)


def _digests(path: str) -> tuple[int, str | None, str | None, str | None]:
    sha, md5, size = hashlib.sha256(), hashlib.md5(), 0
    try:
        with opened(path) as f:
            while block := f.read(BLOCK):
                sha.update(block)
                md5.update(block)
                size += len(block)
    except OSError as e:
        return 0, None, None, f"{type(e).__name__}: {e}".splitlines()[0]
    return size, sha.hexdigest(), md5.hexdigest(), None


def manifest(listing: DataFrame) -> DataFrame:
    """``path, size_bytes, sha256, md5, modified, error`` of each file of a listing (``path`` and, if there is one, ``modified``).

    A file that can't be read has size 0, no sums, and says why. Repeated paths count once, null ones not at all.
    """
    changed = F.max("modified") if "modified" in listing.columns else F.lit(None).cast("timestamp")
    rows = spread(listing.where("path IS NOT NULL").groupBy("path").agg(changed.alias("modified")))
    result = StructType([*StructType.fromDDL("path string, size_bytes bigint, sha256 string, md5 string").fields, rows.schema["modified"], *StructType.fromDDL("error string").fields])
    arrow = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                size, sha, md5, error = _digests(path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([sha], pa.string()), pa.array([md5], pa.string()), batch.column(1).slice(i, 1), pa.array([error], pa.string())], names=arrow.names)

    return cut(rows.mapInArrow(run, result), "manifest")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, status, before_sha256, after_sha256`` of two manifests: ``added``, ``removed``, ``changed``, ``same``, or ``unreadable`` if either has no
    sum of a file that both list. A full outer join on the path; of repeated paths the first by sum counts."""
    one = lambda m, side: m.groupBy("path").agg(F.min_by("sha256", F.coalesce("sha256", F.lit("~"))).alias(f"{side}_sha256"), F.lit(True).alias(side))
    both = one(before, "before").join(one(after, "after"), "path", "full")
    a, b = F.col("before_sha256"), F.col("after_sha256")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(a.isNull() | b.isNull(), "unreadable").when(a == b, "same").otherwise("changed")
    return both.select("path", status.alias("status"), "before_sha256", "after_sha256")


def manifest_lines(inputs: DataFrame, run: dict[str, str] | None = None) -> DataFrame:
    """``at, path, line``: a head with the schema and facts of the run, then each file as JSON, to be written in this order."""
    import json

    spark = inputs.sparkSession
    head = spark.createDataFrame([(0, "", json.dumps({"schema": SCHEMA, "run": run or {}}, sort_keys=True))], "at int, path string, line string")
    packed = F.to_json(F.struct("error", "md5", F.when(F.col("modified").isNotNull(), rfc3339(F.unix_micros("modified") * 1000)).alias("modified"), "path", "sha256", "size_bytes"))
    return head.unionByName(inputs.select(F.lit(1).alias("at"), "path", packed.alias("line")))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What ``manifest_lines`` wrote, again as ``path, size_bytes, sha256, md5, error``."""
    lines = read_ordered(spark, folder).where(~F.startswith(F.col("line"), F.lit('{"run"')))
    return lines.select(F.from_json("line", "path string, size_bytes bigint, sha256 string, md5 string, error string").alias("m")).select("m.*")


def sums(files: DataFrame) -> DataFrame:
    """``path, line``: SHA-256 and path of each file of a manifest, as checking tools read them."""
    return files.where("sha256 IS NOT NULL").select("path", F.concat("sha256", F.lit("  "), "path").alias("line"))


def write_bundle(folder: str, parts: dict[str, tuple[DataFrame, list[str | Column]]]) -> DataFrame:
    """Writes each part (rows with ``line``, and their order) as ordered files below ``folder/<name>``, and ``folder/SHA256SUMS`` over all of them;
    returns the manifest of what was written."""
    spark = None
    for name, (rows, order) in parts.items():
        spark = rows.sparkSession
        write_ordered(rows, f"{folder}/{name}", order)
    written = manifest(listed(spark, *[f"{folder}/{n}" for n in parts]))
    own = written.withColumn("path", F.regexp_replace("path", "^.*?" + folder.rpartition("/")[2].replace("-", "[-]") + "/", ""))
    write_ordered(sums(own), f"{folder}/SHA256SUMS", ["path"])
    return own
