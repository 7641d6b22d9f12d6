"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Bytes of texts that a task works on at a time.
LIST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or a new one of our own where it is unset and driver
    and executors are one machine (tests); an error on a cluster, whose machines don't share a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="waylens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waylens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: later stages, and retries after a lost executor, start
    from those files instead of the source texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column) -> Column:
    """md5 over values, nulls marked: the same in any run, partitioning or engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def unit(key: Column) -> Column:
    """A uniform double in (0, 1) from the first 52 bits of a hex key."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def size_cuts(sizes: list[int], rows: int):
    """Start and number of runs of at most ``rows`` sizes that, but for a single larger one, add up to LIST_BYTES at most."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == rows or held + size > LIST_BYTES):
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def text_slices(batch, rows: int, column: int = 1):
    """Slices of an Arrow batch, whose ``column`` is a text or binary, of at most ``rows`` of them and, but for a single longer one,
    LIST_BYTES of them."""
    import pyarrow.compute as pc

    for start, n in size_cuts(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), rows):
        yield batch.slice(start, n)


def map_texts(docs: DataFrame, make, columns: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """``doc_id`` and what ``make()`` computes from lists of texts, with nulls as None, in tasks.

    ``make`` runs once a task and returns a function from a list of texts to a list of columns for the DDL ``columns``.
    Texts go through in lists of ``rows``, or fewer where they are long, so a task holds few results at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            for part in text_slices(batch, rows):
                found = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=f.type) for c, f in zip(found, list(arrow)[1:], strict=True)]], schema=arrow)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
