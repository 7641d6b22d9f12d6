"""Browser stores made of tables: SQLite files as bytes, written in tasks.

A store is described by SQL for each of its tables; the first column, ``store``, says which file a row belongs to. The same
SQL runs in Spark, where its rows become files for the readers, and in DuckDB, where it stands for what the files hold.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructType

from waylens.plans.activity import table
from waylens.plans.scratch import GROUP_BYTES, cut
from waylens.sources.batches import contents, gathered

#: Tables of the driver that SQL may name in braces.
SOURCES = ("events", "pages", "documents", "orders", "customer", "supplier", "part", "nation")


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of SQL that names driver tables in braces."""
    used = {t: table(spark, sf_dir, t) for t in SOURCES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duckdb(sql: str) -> str:
    for t in SOURCES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def sqlite_bytes(tables: Iterable[tuple[str, list[str], list[list]]]) -> bytes:
    """A SQLite file of tables ``name, columns, values of each column``; tables of one name are one, with the first one's columns."""
    import sqlite3

    db = sqlite3.connect(":memory:")
    made: dict[str, int] = {}
    for name, columns, cells in tables:
        if name not in made:
            made[name] = len(columns)
            if name == "sqlite_sequence":  # the library keeps this one; it's there once a table numbers its rows
                db.execute("CREATE TABLE numbered (id INTEGER PRIMARY KEY AUTOINCREMENT)")
            else:
                db.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)}" for c in columns)})')
        db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * made[name])})', zip(*cells, strict=True))
    db.commit()
    data = db.serialize()
    db.close()
    return data


def _values(cells: pa.ChunkedArray) -> list:
    """Whole numbers or texts as Python objects, nulls as None; many times faster than one by one."""
    import numpy as np

    if not pa.types.is_integer(cells.type):
        return cells.to_numpy().tolist()
    return np.where(cells.is_valid().to_numpy(), cells.fill_null(0).to_numpy().astype(object), None).tolist() if cells.null_count else cells.to_numpy().tolist()


def sqlite_stores(tables: dict[str, DataFrame] | list[tuple[str, DataFrame]], folder: str = "profile") -> DataFrame:
    """``path, content``: a SQLite file for each value of ``store``, of the tables' other columns.

    A row travels as its table's number, its whole numbers and its texts; values of other types are texts of JSON.
    """
    parts = list(tables.items() if isinstance(tables, dict) else tables)
    rows, columns = None, []
    for i, (_, df) in enumerate(parts):
        fields = [f for f in df.schema.fields if f.name != "store"]
        whole = [f.name for f in fields if isinstance(f.dataType, IntegralType | BooleanType)]
        texts = [(f.name, isinstance(f.dataType, StringType)) for f in fields if f.name not in whole]
        columns.append(([f.name for f in fields], whole, texts))
        numbers = F.array(*[F.col(c).cast("long") for c in whole]).cast("array<bigint>")
        others = F.array(*[F.col(c) if plain else F.to_json(F.struct(c)) for c, plain in texts]).cast("array<string>")
        own = df.select(F.col("store").cast("string").alias("store"), F.lit(i).alias("part"), numbers.alias("numbers"), others.alias("texts"))
        rows = own if rows is None else rows.unionByName(own)
    schema = StructType.fromDDL("path string, content binary")
    arrow = to_arrow_schema(schema)
    names = [name for name, _ in parts]

    def make(key: tuple, group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        made = []
        for i, (name, (fields, whole, texts)) in enumerate(zip(names, columns, strict=True)):
            held = group.filter(pc.equal(group.column("part"), i)).combine_chunks()
            if not len(held):
                continue
            cells = {}
            for column, own in (("numbers", [(c, True) for c in whole]), ("texts", texts)):
                flat = _values(pc.list_flatten(held.column(column)))
                for j, (c, plain) in enumerate(own):
                    cells[c] = flat[j :: len(own)] if plain else [json.loads(x).get(c) for x in flat[j :: len(own)]]
            made.append((name, fields, [cells[c] for c in fields]))
        return pa.Table.from_arrays([pa.array([f"{folder}/{key[0].as_py()}"]), pa.array([sqlite_bytes(made)], pa.binary())], schema=arrow)

    return cut(rows.groupBy("store").applyInArrow(make, schema), "stores", GROUP_BYTES)


def text_stores(lines: DataFrame, folder: str = "profile") -> DataFrame:
    """``path, content``: a file for each ``store`` of its ``line`` values, by ``at``."""
    joined = lines.groupBy(F.col("store").cast("string").alias("store")).agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return cut(joined.select(F.concat(F.lit(f"{folder}/"), "store").alias("path"), content.cast("binary").alias("content")), "stores")


def simple_cache_files(entries: DataFrame) -> DataFrame:
    """``path, content``: entry files of a simple cache for rows ``name, url, status, content_type, encoding, body``."""
    schema = StructType.fromDDL("path string, content binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import gzip
        import struct

        def made():
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    name, url, status, kind, encoding, body = (x.as_py() for x in row)
                    body = gzip.compress(body, mtime=0) if encoding == "gzip" else body
                    head = f"HTTP/1.1 {status} OK\0Content-Type: {kind}\0" + (f"Content-Encoding: {encoding}\0" if encoding else "") + "\0"
                    key = f"_dk_https://top.example https://top.example {url}".encode()
                    end = lambda size: struct.pack("<QIIII", 0xF4FA6F45970D41D8, 1, 0, size, 0)
                    head_bytes = b"\4\0\0\0" + head.encode()
                    yield f"cache/{name}_0", struct.pack("<QIIII", 0xFCFB6D1BA7725C30, 5, len(key), 0, 0) + key + body + end(len(body)) + head_bytes + end(len(head_bytes))

        return gathered(made(), arrow)

    return cut(entries.select("name", "url", "status", "content_type", "encoding", "body").mapInArrow(run, schema), "cache-files")


def leveldb_logs(rows: DataFrame, folder: str = "store") -> DataFrame:
    """``path, content``: a LevelDB log for each ``store`` of its records ``seq, key, value`` (null: deleted), one a batch."""
    schema = StructType.fromDDL("path string, content binary")
    arrow = to_arrow_schema(schema)

    def make(key: tuple, group: pa.Table) -> pa.Table:
        import struct

        def sized(data: bytes) -> bytes:
            n, out = len(data), b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n]) + data

        out = bytearray()
        for seq, name, value in sorted(zip(*(group.column(c).to_pylist() for c in ("seq", "key", "value")), strict=True)):
            left, first = struct.pack("<QI", seq, 1) + (b"\0" + sized(name) if value is None else b"\1" + sized(name) + sized(value)), True
            while left or first:
                room = 32768 - len(out) % 32768
                if room < 7:
                    out += bytes(room)
                    continue
                part, left = left[: room - 7], left[room - 7 :]
                out += struct.pack("<IHB", 0, len(part), (1 if not left else 2) if first else (4 if not left else 3)) + part
                first = False
        return pa.Table.from_arrays([pa.array([f"{folder}/{key[0].as_py()}/000003.log"]), pa.array([bytes(out)], pa.binary())], schema=arrow)

    return cut(rows.select(F.col("store").cast("string").alias("store"), "seq", "key", "value").groupBy("store").applyInArrow(make, schema), "leveldb")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each ``path, content`` as a file below ``folder``, in tasks; its ``path``. A task that runs twice writes the same."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from waylens.sources.ordered import store_of

        for batch in batches:
            made = []
            for path, content in contents([batch]):
                store, place = store_of(f"{folder}/{path}")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content)
                made.append(f"{folder}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    return cut(files.select("path", "content").mapInArrow(run, "path string"), "written")
