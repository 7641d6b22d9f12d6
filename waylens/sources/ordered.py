"""Lines in a total order: a sink whose files, by their names, hold all lines in that order, and its reader.

Rows are dealt to tasks by ranges of the order and sorted inside them. Each task writes its range under a name that begins
with the range's number, in a folder for attempts; when all are done the driver moves one attempt of each range to its place.
A job that fails leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from waylens.plans.scratch import cut

ATTEMPTS = "_attempts"
#: Lines that a reader holds at a time.
HELD = 1 << 14


def store_of(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    lines: int


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.header = options["folder"].rstrip("/"), options.get("header")
        self.job = uuid.uuid4().hex
        self.suffix = options.get("suffix", "txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        store, place = store_of(f"{self.folder}/{ATTEMPTS}/{self.job}")
        out, n, name = None, 0, f"part-{number:06d}-{attempt}.{self.suffix}"
        try:
            if number == 0 and self.header is not None:
                store.create_dir(place, recursive=True)
                out = store.open_output_stream(f"{place}/{name}")
                out.write((self.header + "\n").encode())
            for batch in iterator:
                if out is None and batch.num_rows:
                    store.create_dir(place, recursive=True)
                    out = store.open_output_stream(f"{place}/{name}")
                lines = [x or "" for x in batch.column(0).to_pylist()]
                if lines:
                    out.write(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"))
                    n += len(lines)
        finally:
            if out is not None:
                out.close()
        return Part(name if out is not None else None, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, place = store_of(self.folder)
        for part in messages:
            if part is not None and part.name:
                number = part.name.split("-")[1]
                store.move(f"{place}/{ATTEMPTS}/{self.job}/{part.name}", f"{place}/part-{number}.{self.suffix}")
        self._forget()

    def abort(self, messages: list[Part | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        from pyarrow import fs

        store, place = store_of(f"{self.folder}/{ATTEMPTS}")
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_dir(place)


class OrderedLines(DataSource):
    """The format ``ordered_lines``: options ``folder``, ``header`` (a first line of the first file) and ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options))


def write_ordered(rows: DataFrame, folder: str, order: list[str | Column], header: str | None = None, suffix: str = "txt") -> None:
    """Writes ``line`` of the rows to ``folder``, which should be new, in ``order``. Null lines are empty ones; line breaks inside a
    line should be escaped before. Without rows there is a file only for a header. Rows are written once before they are sorted,
    as the ranges come from a sample of them: what makes them doesn't run for that too."""
    spark = rows.sparkSession
    if all(isinstance(o, str) for o in order):
        rows = rows.select(*dict.fromkeys(["line", *order]))
    rows = cut(rows, "unordered")
    spark.dataSource.register(OrderedLines)
    options = {"folder": folder, "suffix": suffix} | ({"header": header} if header is not None else {})
    ordered = rows.orderBy(*order).select("line")
    ordered.write.format("ordered_lines").options(**options).mode("append").save()


def read_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """``file, at, line``: the lines of ordered files, whose order is that of ``file, at``. A file is read by one task, line by line."""
    import io

    listing = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = store_of(path)
                name, at = place.rpartition("/")[2], 0
                with store.open_input_stream(place) as f, io.TextIOWrapper(io.BufferedReader(f), "utf-8", "replace", "\n") as lines:
                    while held := list(islice(lines, HELD)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), pa.array([x.removesuffix("\n") for x in held])], names=["file", "at", "line"])
                        at += len(held)

    return listing.mapInArrow(run, "file string, at bigint, line string")


def read_placed(spark: SparkSession, folder: str) -> DataFrame:
    """``rank, line`` of ordered files, from 0: a line's place in its file and the lines of the files before, which a row a file
    tells, so nothing is sorted again."""
    lines = read_ordered(spark, folder)
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(before), "file").select((F.col("before") + F.col("at")).alias("rank"), "line")
