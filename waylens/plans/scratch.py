"""Tables written once to the folder that all executors share, to cut lineage in iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a task of a scan reads at most, as Spark splits files by itself.
SPLIT_BYTES = 128 << 20
#: Bytes, compressed, of a row group of whole files: a reader takes up to 4,096 rows at once, but none of the next group.
GROUP_BYTES = 4 << 20
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir``, or below a folder of our own where that is unset and driver and executors
    are one machine; an error on a cluster, whose machines don't share a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="waylens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/waylens-events/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def forget() -> int:
    """Deletes what this driver wrote to the shared folder, once results that read it are written elsewhere; how many tables
    went. Stores that this process can't reach keep theirs."""
    from pyarrow import fs

    n = 0
    while _written:
        store, place = fs.FileSystem.from_uri(_written.pop())
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_dir(place)
            n += 1
    return n


def cut(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; ``group_bytes`` bounds a row group, which a reader holds of large contents."""
    path = scratch_path(df.sparkSession, name)
    (df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores if they are so few bytes that a scan may have put them into fewer tasks; else as they are."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows
