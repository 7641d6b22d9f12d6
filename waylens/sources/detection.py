"""What unknown files and folders are: markers of a profile, first bytes, and the tables of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylens.sources.sqlite import sqlite_table

#: Files that mark a folder as a profile; tables that tell a database; first bytes (in hex, from which byte) of others.
MARKERS = {"History": "Chromium profile", "places.sqlite": "Firefox profile", "History.db": "Safari profile"}
SCHEMAS = (
    (("urls", "visits"), "Chromium History (SQLite)"), (("cookies",), "Chromium Cookies (SQLite)"), (("moz_places",), "Firefox places (SQLite)"), (("moz_cookies",), "Firefox cookies (SQLite)"),
    (("history_items", "history_visits"), "Safari History (SQLite)"),
)
SIGNATURES = (("EFCDAB89", 5, "ESE database", "medium"), ("6D6F7A4C7A343000", 1, "Firefox mozLz4 (jsonlz4)", "high"), ("455646", 1, "EnCase/EWF disk image (E01)", "high"), ("4C5646", 1, "EnCase/EWF disk image (E01)", "high"))
SQLITE = "53514C69746520666F726D6174203300"


def detect_files(files: DataFrame) -> DataFrame:
    """``path, kind, confidence, basis`` of each file (``path, content``).

    A database is told by its tables, high where they're known, medium where they aren't or can't be read; other files by
    their first bytes. What nothing tells is low, and its first bytes are shown.
    """
    tables = sqlite_table(files, "sqlite_master", "type string, name string").where("type = 'table'").groupBy("source").agg(F.array_sort(F.collect_set("name")).alias("tables"))
    head = F.hex(F.substring("content", 1, 16))
    rows = files.select("path", head.alias("head"), F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1)).alias("name")).join(tables.withColumnRenamed("source", "path"), "path", "left")
    known = F.lit(None).cast("string")
    for names, kind in reversed(SCHEMAS):
        held = F.array_contains("tables", names[0])
        for n in names[1:]:
            held = held & F.array_contains("tables", n)
        known = F.when(held, kind).otherwise(known)
    database, signed = F.col("head") == SQLITE, F.lit(None).cast("struct<kind:string,confidence:string,basis:string>")
    for bytes_, at, kind, confidence in reversed(SIGNATURES):
        webcache = (F.col("name") == "webcachev01.dat") & F.lit(kind.startswith("ESE"))
        own = F.struct(F.when(webcache, "IE/Edge-Legacy WebCacheV01 (ESE)").otherwise(kind).alias("kind"), F.when(webcache, "high").otherwise(confidence).alias("confidence"), F.lit(f"signature {bytes_}").alias("basis"))
        signed = F.when(F.substring("head", 2 * at - 1, len(bytes_)) == bytes_, own).otherwise(signed)
    of_tables = F.struct(F.coalesce(known, F.when(F.col("tables").isNull(), "SQLite database (schema probe failed)").otherwise("SQLite database (unrecognized schema)")).alias("kind"), F.when(known.isNotNull(), "high").otherwise("medium").alias("confidence"), F.concat(F.lit("SQLite header, tables: "), F.coalesce(F.array_join("tables", ", "), F.lit("none read"))).alias("basis"))
    unknown = F.struct(F.lit("unknown (possible raw disk or memory image)").alias("kind"), F.lit("low").alias("confidence"), F.concat(F.lit("no known signature; first bytes: "), "head").alias("basis"))
    return rows.select("path", F.when(database, of_tables).otherwise(F.coalesce(signed, unknown)).alias("d")).select("path", "d.*")


def detect_folders(files: DataFrame) -> DataFrame:
    """``path, kind, confidence`` of each folder that directly holds files: a profile by its marker, else a home or image
    layout by its path, else nothing known."""
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.regexp_extract("path", "([^/]*)$", 1)
    found = files.select(folder.alias("path"), F.array_position(F.array(*[F.lit(m) for m in MARKERS]), name).alias("at")).groupBy("path").agg(F.min(F.when(F.col("at") > 0, F.col("at"))).alias("at"))
    profile = F.get(F.array(*[F.lit(k) for k in MARKERS.values()]), (F.col("at") - 1).cast("int"))
    layout = F.lower("path").rlike("/users/|appdata|/home/")
    return found.select(
        "path", F.coalesce(profile, F.when(layout, "browser evidence directory (home/image layout)").otherwise("directory (no browser-profile markers)")).alias("kind"),
        F.when(profile.isNotNull(), "high").when(layout, "medium").otherwise("low").alias("confidence"),
    )
