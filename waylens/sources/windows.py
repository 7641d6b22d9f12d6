"""Raw files of any size as overlapping byte ranges, for scans of memory and disk images.

A file is planned as ranges of ``window`` bytes, and each is read with ``overlap`` bytes of what follows it. A match belongs to
the range in which it starts, so one that lies across the end of a range is found once and whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOW, OVERLAP = 8 << 20, 64 << 10
#: Bytes of a file that one task reads, in windows one after the other.
TASK_BYTES = 128 << 20
SCHEMA = "path string, size bigint, start bigint, owned bigint, content binary"


class Ranges(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        super().__init__((path, begin))
        self.path, self.size, self.begin, self.end = path, size, begin, end


def listing(paths: list[str]) -> list[tuple[str, int]]:
    """``(path, size)`` of all files below the paths, by path; hidden files and those of other tools' bookkeeping
    (names with ``_`` or ``.`` in front) are left out."""
    from pyarrow import fs

    found = []
    for path in paths:
        store, place = fs.FileSystem.from_uri(path)
        head = path[: len(path) - len(place)] if path.endswith(place) else ""
        info = store.get_file_info(place)
        below = store.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found += [(head + f.path, f.size) for f in below if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(found)


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.window, self.overlap = int(options.get("window", WINDOW)), int(options.get("overlap", OVERLAP))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        if self.window < 1 or self.overlap < 0:
            raise ValueError("a window has at least one byte, an overlap isn't negative")

    def partitions(self) -> list[InputPartition]:
        step = max(1, self.task_bytes // self.window) * self.window
        return [Ranges(path, size, at, min(size, at + step)) for path, size in listing(self.paths) for at in range(0, size, step)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(partition.path)
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("owned", pa.int64()), ("content", pa.binary())])
        with store.open_input_file(place) as f:
            for start in range(partition.begin, partition.end, self.window):
                owned = min(self.window, partition.size - start)
                f.seek(start)
                content = f.read(min(owned + self.overlap, partition.size - start))
                columns = [[partition.path], [partition.size], [start], [owned], [content]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class ByteWindows(DataSource):
    """The format ``byte_windows``: options ``paths`` (a JSON list), ``window``, ``overlap`` and ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "byte_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WindowReader:
        return WindowReader({k.lower(): v for k, v in self.options.items()})


def read_windows(spark: SparkSession, *paths: str, window: int = WINDOW, overlap: int = OVERLAP, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``path, size, start, owned, content`` of every window of the files below ``paths``: ``content`` begins at ``start`` and has
    ``owned`` bytes of the window's own and at most ``overlap`` more. Empty files have no window."""
    spark.dataSource.register(ByteWindows)
    return spark.read.format("byte_windows").options(paths=json.dumps(list(paths)), window=window, overlap=overlap, taskBytes=task_bytes).load()


def whole_files(files: DataFrame) -> DataFrame:
    """Files whose content is a column (``path, content``) as one window each."""
    size = F.octet_length("content").cast("long")
    return files.select("path", size.alias("size"), F.lit(0).cast("long").alias("start"), size.alias("owned"), "content")


def scan(windows: DataFrame, pattern: bytes, value: str) -> DataFrame:
    """``source, offset`` and the first group, as text called ``value``, of all matches of a pattern in windows, each in the window in
    which it starts. Bytes that aren't UTF-8 become replacement characters, zero bytes blanks.

    A pattern that looks ahead for its whole match finds overlapping matches too, as the windows want it: what matches in a
    window then doesn't depend on matches before it. A match that is longer than the overlap may be cut.
    """
    result = StructType.fromDDL(f"source string, offset bigint, {value} string")
    arrow = to_arrow_schema(result)
    compiled = re.compile(pattern)

    def run(batches):
        for batch in batches:
            for path, start, owned, content in zip(*batch.columns, strict=True):
                data, limit, first = content.as_buffer(), owned.as_py(), start.as_py()
                at, values = [], []
                for m in compiled.finditer(memoryview(data)):
                    if m.start() >= limit:
                        break
                    at.append(first + m.start())
                    values.append(bytes(m[1]).decode("utf-8", "replace").replace("\0", " "))
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.string())], schema=arrow)

    return windows.where("content IS NOT NULL").select("path", "start", "owned", "content").mapInArrow(run, result)
