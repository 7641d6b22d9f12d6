"""SQLite evidence files as DataFrames.

Spark reads the files (any store it knows) and deals them to tasks; a task opens a file's bytes in memory, read-only, and
yields the rows of the tables asked for. Missing tables give no rows, missing columns nulls, and rows of another type are
skipped. Committed frames of a ``-wal`` file beside the database are laid over its pages first: a live profile's newest
rows are there.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from waylens.plans.scratch import GROUP_BYTES, cut, scratch_path

ROWS = 4096
#: A file's content of more bytes goes on at once.
RAW_BYTES = 1 << 20
#: A database's first bytes, and the two magic numbers of a write-ahead log, whose last bit is the byte order of its sums.
MAGIC, WAL_MAGIC = b"SQLite format 3", (0x377F0682, 0x377F0683)


def evidence_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of files below a path or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _with_logs(files: DataFrame, *more: str) -> DataFrame:
    """``path, content, wal`` and the columns ``more`` of the files that are no companions. Only databases with a log travel to it;
    which ones have one is read from the listing, so without logs the files are scanned once."""
    wal = files.where(F.col("path").endswith("-wal")).select(F.regexp_replace("path", "-wal$", "").alias("path"), F.col("content").alias("wal"))
    own = files.where(~F.col("path").rlike("-(wal|shm|journal)$")).select("path", "content", *more)
    logged = wal.select("path").distinct()
    if logged.isEmpty():
        return own.select("path", "content", F.lit(None).cast("binary").alias("wal"), *more)
    alone = own.join(logged, "path", "left_anti").select("path", "content", F.lit(None).cast("binary").alias("wal"), *more)
    return alone.unionByName(own.join(logged, "path", "left_semi").join(wal, "path"))


def _sums(data: memoryview, order: str, s0: int, s1: int) -> tuple[int, int]:
    words = struct.unpack(f"{order}{len(data) // 4}I", data)
    for x, y in zip(words[::2], words[1::2], strict=True):
        s0 = (s0 + x + s1) & 0xFFFFFFFF
        s1 = (s1 + y + s0) & 0xFFFFFFFF
    return s0, s1


def overlaid(data: bytes, wal: bytes | None) -> bytes:
    """A database with the pages of its log's committed frames, in rollback mode so that it opens from bytes alone.

    Frames count up to the last commit before the first one with another salt or a wrong checksum.
    """
    pages: dict[int, memoryview] = {}
    size = 0
    if wal and len(wal) > 32:
        log = memoryview(wal)
        magic, _, page, _, salt1, salt2, sum0, sum1 = struct.unpack(">8I", log[:32])
        order = ">" if magic & 1 else "<"
        if magic in WAL_MAGIC and page >= 512 and _sums(log[:24], order, 0, 0) == (sum0, sum1):
            held: dict[int, memoryview] = {}
            for at in range(32, len(wal) - page - 23, page + 24):
                number, commit, one, two, s0, s1 = struct.unpack(">6I", log[at : at + 24])
                body = log[at + 24 : at + 24 + page]
                sum0, sum1 = _sums(body, order, *_sums(log[at : at + 8], order, sum0, sum1))
                if (one, two) != (salt1, salt2) or (s0, s1) != (sum0, sum1):
                    break
                held[number] = body
                if commit:
                    pages.update(held)
                    held, size = {}, commit * page
    if pages:
        out = bytearray(data[:size].ljust(size, b"\0"))
        for number, body in pages.items():
            if number * len(body) <= size:
                out[(number - 1) * len(body) : number * len(body)] = body
        data = bytes(out)
    return data[:18] + b"\x01\x01" + data[20:]


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """The path and an open connection of each SQLite file; closed when the next is asked for."""
    import sqlite3

    for batch in batches:
        for path, content, wal in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data, log = content.as_py(), wal.as_py()
            if (not data or data[:15] != MAGIC) and not (data == b"" and log):
                continue
            db = sqlite3.connect(":memory:")
            db.text_factory = bytes
            try:
                db.deserialize(overlaid(data, log))
                yield path, db
            except sqlite3.Error:
                continue
            finally:
                db.close()


def _cast(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_integer(kind):
        return int(value)
    if pa.types.is_floating(kind):
        return float(value)
    if pa.types.is_binary(kind):
        return value if isinstance(value, bytes) else str(value).encode()
    return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array] | None:
    """The columns of rows whose cells all have their column's type; None if some haven't."""
    try:
        cells = [pa.array(c, pa.binary() if pa.types.is_string(k) else k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return [c.cast(k) for c, k in zip(cells, kinds, strict=True)]
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        return None


def _table_rows(db, name: str, columns: StructType, kind: pa.StructType) -> Iterator[list[pa.Array]]:
    """The rows of a table, some at a time, as columns: missing columns are null, rows of another type are left out."""
    have = {r[1].decode() for r in db.execute(f'PRAGMA table_info("{name}")')}
    if not have:
        return
    if "rowid" in columns.names and "rowid" not in have:
        try:
            db.execute(f'SELECT rowid FROM "{name}" LIMIT 0')
            have.add("rowid")
        except Exception:  # noqa: BLE001 - a table that has none
            pass
    picked = ", ".join(f'"{f.name}"' if f.name in have else "NULL" for f in columns.fields)
    kinds = [f.type for f in kind]
    cursor = db.execute(f'SELECT {picked} FROM "{name}"')
    while rows := cursor.fetchmany(ROWS):
        found = _columns(rows, kinds)
        if found is None:  # cell by cell
            kept = []
            for row in rows:
                try:
                    kept.append([_cast(v, k) for v, k in zip(row, kinds, strict=True)])
                except (TypeError, ValueError):
                    continue
            found = [pa.array(list(c), k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)]
        if found:
            yield found


def sqlite_tables(files: DataFrame, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Rows of each table in each of ``files``: ``source`` (the file's path) and the columns of its DDL.

    A file is opened once for all of its tables; where there are several their rows are written to the shared folder.
    """
    wanted = {t: StructType.fromDDL(ddl) for t, ddl in tables.items()}
    schema = StructType([StructField("source", StringType()), *[StructField(t, s) for t, s in wanted.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for path, db in _opened(batches):
            for at, (name, columns) in enumerate(wanted.items(), 1):
                try:
                    for kept in _table_rows(db, name, columns, arrow.field(at).type):
                        n = len(kept[0])
                        own = pa.StructArray.from_arrays(kept, fields=list(arrow.field(at).type))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), *[own if i == at else pa.nulls(n, arrow.field(i).type) for i in range(1, len(arrow))]], schema=arrow)
                except sqlite3.Error:
                    continue

    rows = _with_logs(files).mapInArrow(run, schema)
    if len(tables) > 1:
        rows = cut(rows, "sqlite-rows")
    return {t: rows.where(F.col(t).isNotNull()).select("source", f"{t}.*") for t in tables}


def _listed(cells: list[pa.Array]) -> pa.Array:
    """Columns of one type as one column of lists, a list a row."""
    import numpy as np

    n, k = len(cells[0]), len(cells)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.concat_arrays(cells).take(pa.array(np.arange(n * k).reshape(k, n).T.ravel())))


def routed(files: DataFrame, tables: dict[str, tuple[int, str, str]], raw: set[int]) -> tuple[dict[str, DataFrame], dict[int, DataFrame]]:
    """Files of many kinds in one scan, by their column ``route``: rows of tables, and whole files for other readers.

    ``tables`` has, by a key, the route of the databases, a table and its DDL; each key's rows come back as ``sqlite_tables`` has
    them. Files of the routes ``raw`` come back as ``path, content, modificationTime``, a database with its log laid over it.
    All of it is written once, a folder a key, and whoever asks for a key reads that folder, whose size tells Spark how large
    the key is; keys and routes without rows aren't in the result. Cells are written as one list a type, so that a
    row is as wide as its own table. Only databases, and files with a log, go through Python: other contents are written as
    they are, however large.
    """
    wanted = {k: (route, t, StructType.fromDDL(ddl)) for k, (route, t, ddl) in tables.items()}
    kinds = {k: to_arrow_schema(s) for k, (_, _, s) in wanted.items()}
    fixed = StructType.fromDDL("source string, content binary, modificationTime timestamp")
    types = {f.dataType.simpleString(): f.dataType for _, _, s in wanted.values() for f in s.fields}
    lists = StructType([StructField(f"list_{i}", ArrayType(t)) for i, t in enumerate(types.values())])
    at_list = {t: i for i, t in enumerate(types)}
    placed = {k: [(at_list[f.dataType.simpleString()], j) for j, f in enumerate(s.fields)] for k, (_, _, s) in wanted.items()}
    schema = StructType([StructField("kind", StringType()), *fixed.fields, *lists.fields])
    arrow = to_arrow_schema(schema)

    def batch_of(kinds: list[str], sources: list[str], whole: list | None = None, own: dict[int, pa.Array] | None = None) -> pa.RecordBatch:
        n = len(sources)
        cells = [pa.array(kinds), pa.array(sources), *[pa.array([w[i] for w in whole], arrow.field(2 + i).type) if whole else pa.nulls(n, arrow.field(2 + i).type) for i in (0, 1)]]
        cells += [own[i].cast(f.type) if own and i in own else pa.nulls(n, f.type) for i, f in enumerate(list(arrow)[4:])]
        return pa.RecordBatch.from_arrays(cells, schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        databases = {w[0] for w in wanted.values()}
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for i, (path, route, changed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "route", "modificationTime")), strict=True)):
                if route in raw and batch.column(2)[i].is_valid:
                    data, log = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    held.append((f"file{route}", path, overlaid(data, log) if log and data else data, changed))
                    size += len(held[-1][2] or b"")
                if len(held) == ROWS or size > RAW_BYTES:
                    yield batch_of([h[0] for h in held], [h[1] for h in held], [h[2:] for h in held])
                    held, size = [], 0
                for _, db in _opened([batch.slice(i, 1)]) if route in databases else ():
                    for key, (of, name, columns) in wanted.items():
                        if of != route:
                            continue
                        try:
                            for kept in _table_rows(db, name, columns, pa.struct(list(kinds[key]))):
                                own = {i: _listed([kept[j] for k, j in placed[key] if k == i]) for i in {k for k, _ in placed[key]}}
                                yield batch_of([key] * len(kept[0]), [path] * len(kept[0]), None, own)
                        except sqlite3.Error:
                            continue
            if held:
                yield batch_of([h[0] for h in held], [h[1] for h in held], [h[2:] for h in held])

    spark = files.sparkSession
    place = scratch_path(spark, "routed")
    logged = _with_logs(files, "modificationTime", "route")
    opened = logged.where(F.col("route").isin({w[0] for w in wanted.values()}) | F.col("wal").isNotNull()).mapInArrow(run, schema)
    plain = logged.where(F.col("route").isin(raw) & F.col("wal").isNull()).select(F.concat(F.lit("file"), F.col("route").cast("string")).alias("kind"), F.col("path").alias("source"), "content", "modificationTime", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lists.fields])
    opened.unionByName(plain).write.option("parquet.block.size", GROUP_BYTES).partitionBy("kind").parquet(place)
    there = {r["kind"] for r in spark.read.schema("kind string").parquet(place).distinct().collect()}  # a row a key at most
    whole = StructType(fixed.fields)
    found = {}
    for key, (_, _, columns) in wanted.items():
        if key in there:
            rows = spark.read.schema(StructType([fixed.fields[0], *[lists.fields[i] for i in sorted({k for k, _ in placed[key]})]])).parquet(f"{place}/kind={key}")
            seen: dict[int, int] = {}
            cells = []
            for (i, _), f in zip(placed[key], columns.fields, strict=True):
                cells.append(F.get(f"list_{i}", F.lit(seen.get(i, 0))).alias(f.name))
                seen[i] = seen.get(i, 0) + 1
            found[key] = rows.select("source", *cells)
    return found, {r: spark.read.schema(whole).parquet(f"{place}/kind=file{r}").select(F.col("source").alias("path"), "content", "modificationTime") for r in raw if f"file{r}" in there}


def sqlite_table(files: DataFrame, table: str, columns: str) -> DataFrame:
    return sqlite_tables(files, {table: columns})[table]


def sqlite_rows(files: DataFrame, table: str) -> DataFrame:
    """``source, row`` of a table whose columns vary: each row as JSON of what it holds, blobs left out."""
    schema = StructType.fromDDL("source string, row string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import sqlite3

        for path, db in _opened(batches):
            try:
                cursor = db.execute(f'SELECT * FROM "{table}"')
            except sqlite3.Error:
                continue
            names = [d[0] for d in cursor.description]
            while rows := cursor.fetchmany(ROWS):
                out = []
                for row in rows:
                    own = {k: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for k, v in zip(names, row, strict=True) if v is not None}
                    out.append(json.dumps(own))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out)), pa.array(out, pa.string())], schema=arrow)

    return _with_logs(files).mapInArrow(run, schema)


def integrity_failures(files: DataFrame) -> DataFrame:
    """``source, message`` of SQLite files that their own check finds broken."""
    schema = StructType.fromDDL("source string, message string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import sqlite3

        for batch in batches:
            out = []
            for path, content, wal in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, message = content.as_py(), None
                if data and data[:15] == MAGIC:
                    db = sqlite3.connect(":memory:")
                    try:
                        db.deserialize(overlaid(data, wal.as_py()))
                        found = db.execute("PRAGMA integrity_check(1)").fetchone()[0]
                        message = None if found == "ok" else found
                    except sqlite3.Error as e:
                        message = str(e)
                    finally:
                        db.close()
                if message:
                    out.append((path, message))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _with_logs(files).mapInArrow(run, schema)
