"""Sinks: events as lines and tables that other tools read. Each returns a DataFrame for Spark's own writers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.functions.cookies import interpret_cookie
from waylens.functions.text import bodyfile_field, csv_field
from waylens.functions.times import rfc3339
from waylens.functions.urls import interpret_url
from waylens.plans.model import ENVELOPE, attribute, with_kinds
from waylens.plans.scratch import cut

#: What a graph has at most.
MAX_NODES, MAX_EDGES = 10_000, 50_000
#: Rows that a task makes Python objects of at a time.
HELD = 4096
#: The columns of the export, of the l2t table, and of find hits.
EXPORT = ("timestamp", "browser", "artifact", "url", "title", "description", "interpretation", "source")
L2T_HEADER = "date,time,timezone,MACB,source,sourcetype,type,user,host,short,desc,version,filename,inode,notes,format,extra"
HIT_HEADER = "TERM,SOURCE,STATE,CONF,RULE,TIME-BASIS,USER-ACTION,MATCH"


def bodyfile(events: DataFrame) -> DataFrame:
    """``line``: eleven fields with bars; the event's second goes to its kind's slot."""
    rows = with_kinds(events.withColumn("__url", attribute(events, "url")), "slot", "label")
    seconds = F.expr("CAST(floor(CAST(timestamp_ns AS decimal(20,0)) / 1000000000) AS bigint)")
    slot = lambda s: F.when(F.col("slot") == s, seconds).otherwise(F.lit(0)).cast("string")
    detail = F.coalesce(F.when(F.col("__url") != "", F.col("__url")), F.col("description"))
    name = F.concat(F.lit("["), F.lower("browser"), F.lit(" "), F.lower("artifact"), F.lit("] "), detail, F.lit(" ("), F.col("label"), F.lit(")"))
    return rows.select(F.concat_ws("|", F.lit("0"), bodyfile_field(name), *[F.lit("0")] * 5, slot("A"), slot("M"), F.lit("0"), slot("B")).alias("line"))


def l2t_csv(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """``line``: seventeen CSV columns (see ``L2T_HEADER``); times in ``zone``, ``extra`` has all attributes by key. Events
    without a time get zeros."""
    if "attrs" in events.columns:
        extra = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    else:  # columns are known by name: no map is built
        extra = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in sorted(events.columns) if c not in ENVELOPE])
    rows = events.withColumns({f"__{k}": attribute(events, k) for k in ("url", "user", "host")} | {"__time": rfc3339(F.col("timestamp_ns"), zone), "__extra": extra})
    rows, text, extra = with_kinds(rows, "slot", "label"), F.col("__time"), F.col("__extra")
    date = F.concat_ws("/", F.substring(text, 6, 2), F.substring(text, 9, 2), F.substring(text, 1, 4))
    macb = F.when(F.col("slot") == "A", ".A..").when(F.col("slot") == "B", "...B").otherwise("M...")
    desc = F.when(F.col("__url") != "", F.concat("description", F.lit(" ["), F.col("__url"), F.lit("]"))).otherwise(F.col("description"))
    untimed = F.col("timestamp_ns").isNull()
    fields = [
        F.when(untimed, "00/00/0000").otherwise(date), F.when(untimed, "00:00:00").otherwise(F.substring(text, 12, 8)), F.lit(zone), macb, F.lit("WEBHIST"), F.concat("browser", F.lit(" "), F.col("artifact")), F.col("label"),
        F.col("__user"), F.col("__host"), F.col("description"), desc, F.lit("2"), F.col("source"), F.lit(""), F.lit(""), F.lit("waylens"), extra,
    ]
    return rows.select(_csv(fields).alias("line"))


def _csv(fields: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(F.coalesce(f, F.lit(""))) for f in fields])


def interpretation(events: DataFrame) -> Column:
    """What an event's URL says, else what its cookie of name and value does; null if neither says anything."""
    url, name, value = (attribute(events, k) for k in ("url", "name", "value"))
    return F.coalesce(F.when(url != "", interpret_url(url)), F.when(name.isNotNull() & value.isNotNull(), interpret_cookie(name, value)))


def export_rows(events: DataFrame, zone: str = "UTC", interpret: bool = True) -> DataFrame:
    """The eight text columns of ``EXPORT``; cells of attributes that an event doesn't have are empty."""
    cells = {"timestamp": rfc3339(F.col("timestamp_ns"), zone), "interpretation": interpretation(events) if interpret else attribute(events, "interpretation")}
    own = lambda c: cells.get(c, F.col(c) if c in ("browser", "artifact", "description", "source") else attribute(events, c))
    return events.select(*[F.coalesce(own(c).cast("string"), F.lit("")).alias(c) for c in EXPORT])


def export_lines(events: DataFrame, form: str = "csv", zone: str = "UTC") -> DataFrame:
    """The export as ``line`` of CSV (without its header ``EXPORT``), JSON or text."""
    rows = export_rows(events, zone)
    if form == "csv":
        return rows.select(_csv([F.col(c) for c in EXPORT]).alias("line"))
    if form == "jsonl":
        return rows.select(F.to_json(F.struct(*sorted(EXPORT))).alias("line"))
    said = F.when(F.col("interpretation") == "", "").otherwise(F.concat(F.lit("  {"), "interpretation", F.lit("}")))
    return rows.select(F.concat(F.lit("["), "timestamp", F.lit("] "), "browser", F.lit("/"), "artifact", F.lit(": "), "description", F.lit("  <"), "url", F.lit(">"), said).alias("line"))


def event_lines(events: DataFrame, form: str = "jsonl", zone: str = "UTC") -> DataFrame:
    """Events as ``line``: flat JSON (keys in order, attributes beside the envelope), five CSV columns (time, browser, artifact,
    url, title), those of the other contract (``source_csv``: time, browser, artifact, source, description), or text."""
    time, url, title = rfc3339(F.col("timestamp_ns"), zone), F.coalesce(attribute(events, "url"), F.lit("")), F.coalesce(attribute(events, "title"), F.lit(""))
    if form == "csv":
        return events.select(_csv([time, F.col("browser"), F.col("artifact"), url, title]).alias("line"))
    if form == "source_csv":
        return events.select(_csv([time, F.col("browser"), F.col("artifact"), F.col("source"), F.col("description")]).alias("line"))
    if form == "text":
        return events.select(F.concat(F.lit("["), time, F.lit("] "), "browser", F.lit("/"), "artifact", F.lit(": "), "description", F.lit("  <"), url, F.lit(">")).alias("line"))
    json = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fixed = {"timestamp_ns": F.col("timestamp_ns"), "timestamp": time, "browser": F.col("browser"), "artifact": F.col("artifact"), "source": F.col("source"), "description": F.col("description"), "url": url, "title": title}
    pairs = [F.struct(F.lit(k).alias("k"), json(v).alias("v")) for k, v in fixed.items()]
    if "attrs_json" in events.columns:
        typed = F.transform(F.map_entries(F.from_json("attrs_json", "map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
        every = F.concat(F.array(*pairs), F.filter(typed, lambda e: ~e["k"].isin(*fixed)))
    else:
        more = [F.struct(F.lit(c).alias("k"), F.when(F.col(f"`{c}`").isNotNull(), json(F.col(f"`{c}`"))).alias("v")) for c in events.columns if c not in ENVELOPE and c not in fixed]
        every = F.filter(F.array(*pairs, *more), lambda e: e["v"].isNotNull())
    line = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(every), lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}"))
    return events.select(line.alias("line"))


def hit_lines(hits: DataFrame, form: str = "csv") -> DataFrame:
    """Find hits as ``line`` of CSV (see ``HIT_HEADER``), of a Markdown table, or of JSON with the time where there is one."""
    columns = ["term", "evidence_source", "state", "confidence", "rule_id", "basis", "action", "match"]
    if form == "csv":
        return hits.select(_csv([F.col(c) for c in columns]).alias("line"))
    if form == "text":
        bar = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
        return hits.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[bar(c) for c in columns]), F.lit(" |")).alias("line"))
    provenance = F.struct(F.col("evidence_source").alias("source"), "state", F.col("basis").alias("timestamp_basis"), F.col("action").alias("user_action_claim"))
    time = F.when(F.col("timestamp_ns") != 0, rfc3339(F.col("timestamp_ns")))
    return hits.select(F.to_json(F.struct("browser", "confidence", "match", provenance.alias("provenance"), "rule_id", "term", time.alias("timestamp"), "timestamp_ns")).alias("line"))


def hashes(files: DataFrame, key: str = "path") -> DataFrame:
    """Custody hashes of ``content``."""
    return files.select(key, F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("bytes"))


def page_references(pages: DataFrame) -> DataFrame:
    """What each page refers to: links, sources and anchors, with how often."""
    patterns = {"link": r'<link[^>]*\shref="([^"]*)"', "src": r'<(?:script|img|source|video|audio)[^>]*\ssrc="([^"]*)"', "anchor": r'<a[^>]*\shref="([^"]*)"'}
    found = [F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), _tag(k)) for k, p in patterns.items()]
    rows = pages.select("page_id", F.explode(F.concat(*found)).alias("r"))
    return rows.groupBy("page_id", "r.kind", "r.ref").agg(F.count("*").alias("n"))


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref"))


#: Bytes of a SQLite file beyond which the next rows go to another one.
FILE_BYTES = 32 << 20


def write_sqlite(rows: DataFrame, folder: str, name: str = "timeline", most: int = FILE_BYTES) -> DataFrame:
    """SQLite files of one table, all text, written in tasks below ``folder`` (which all executors share): ``path, rows``. A
    partition is one file, or several of some ``most`` bytes. A file gets its name from its place and what it holds, so a
    task that runs twice writes the same files."""
    columns = rows.columns
    schema = StructType.fromDDL("path string, rows bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import hashlib
        import sqlite3
        from itertools import chain

        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces = chain.from_iterable((b.slice(i, HELD) for i in range(0, b.num_rows, HELD)) for b in batches)
        at = 0
        while (piece := next(pieces, None)) is not None:
            db = sqlite3.connect(":memory:")
            db.execute(f'CREATE TABLE "{name}" ({", ".join(f"{chr(34)}{c}{chr(34)} TEXT" for c in columns)})')
            n, size = 0, db.execute("PRAGMA page_size").fetchone()[0]
            while piece is not None:
                db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns))})', zip(*(c.to_pylist() for c in piece.columns), strict=True))
                n += piece.num_rows
                piece = next(pieces, None) if db.execute("PRAGMA page_count").fetchone()[0] * size < most else None
            db.commit()
            data = db.serialize()
            db.close()
            path = f"{folder.rstrip('/')}/{name}-{part:06d}-{at:04d}-{hashlib.sha256(data).hexdigest()[:32]}.db"
            store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            with store.open_output_stream(place) as out:
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], schema=arrow)
            at += 1

    texts = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return cut(texts.mapInArrow(run, schema), "sqlite-files")


def _bounded(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames, written once, if they are within the graph's caps; what is larger isn't sent to the driver."""
    nodes, edges = cut(nodes, "graph-nodes"), cut(edges, "graph-edges")
    if nodes.count() > MAX_NODES or edges.count() > MAX_EDGES:
        raise ValueError(f"a graph of more than {MAX_NODES} nodes or {MAX_EDGES} edges: take those of entity_graph")
    return nodes, edges


def graph_json(nodes: DataFrame, edges: DataFrame, flags: DataFrame, window_seconds: int) -> str:
    """The graph (at most 10,000 nodes and 50,000 edges) as JSON text."""
    import json

    nodes, edges = _bounded(nodes, edges)
    cut_nodes, cut_edges = flags.first()
    made = {
        "nodes": [{"id": r["id"], "event_count": r["events"], "browsers": r["browsers"]} for r in nodes.collect()],
        "edges": [{"from": r["src"], "to": r["dst"], "kind": r["kind"], "weight": r["weight"]} for r in edges.collect()],
        "cooccurrence_window_secs": window_seconds, "nodes_truncated": cut_nodes, "edges_truncated": cut_edges,
    }
    return json.dumps(made)


def graph_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph (at most 10,000 nodes and 50,000 edges) as DOT text."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    nodes, edges = _bounded(nodes, edges)
    lines = [f"  {quote(r['id'])} [events={r['events']}];" for r in nodes.collect()]
    lines += [f"  {quote(r['src'])} -> {quote(r['dst'])} [kind={r['kind']}, weight={r['weight']}];" for r in edges.collect()]
    return "\n".join(["digraph hosts {", *lines, "}"])
