"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles, and the components of its links.

Shingles have one global order: those known to be frequent last, by count, the others by hash. If two sets are similar,
the ``m``-prefixes of both (``n - ceil(t * n) + m`` first shingles) share ``m`` shingles at least, for any ``m``. Each
document picks the ``m`` whose prefix is estimated to cost least: a longer prefix has more postings to read, but a partner
must share more of it before the pair is verified. A pair needs the smaller ``m`` of the two at least, and mostly more:
shingles that both have and that aren't in both prefixes lie behind the prefix that ends first, ``ceil(t * n) - m`` at
most, and the sizes of a pair say how many it must share in all. A node can't share more of its prefix than there are
other nodes' postings for, which rules pairs out before they're counted.

Equal sets are one node. Postings lists may be long (a passage, a group of near copies), so they're never paired in full:

1. each posting pairs with the list's leader and with ``NEAR`` neighbours, which is all pairs in short lists;
2. each node verifies its best candidate first, and what that links falls into one component;
3. other candidates are verified where they join different components;
4. for long lists that still hold several components, members outside the largest one are held against the others.

So links inside a component found already aren't needed, and no link between components is lost. A list of a very frequent
shingle is split by node into parts that are paired on their own; their leaders are paired among themselves.

A set's id has 128 bits. The first 64 stand for it in tables; sets that share those with another set get other ones.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from waylens.llm.common import materialize, text_slices
from waylens.llm.components import components
from waylens.llm.shingles import set_id, shingle_sets

#: Largest m, and shingles past the first prefix whose frequency is counted.
MOST_MATCHES, SPARE = 8, 16
#: Estimated cost of verifying a candidate, in postings read.
VERIFY = 8
#: Frequent shingles that are broadcast at most (16 MB); the least count rises until they fit. Order stays total and the
#: result the same whatever it is.
FREQUENT, LEAST_COUNT = 1 << 20, 8
NEAR = 15
#: Nodes of a part of a list.
HOT = 4096
#: Bytes of the sets of a block that is held against another, and its nodes.
BLOCK_BYTES, BLOCK_NODES = 8 << 20, 1024
#: Ids of documents whose sets are needed that are broadcast at most (some 50 bytes each); more are joined with a shuffle.
NEEDED = 500_000


def _needed_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` must share with any similar set."""
    return -(-n * percent // 100)


def _batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in text_slices(batch, rows):
            yield part, shingle_sets(part.column(1).to_pylist())


class NodeIds:
    """64-bit ids of sets: the first ``bits`` bits of the 128, or another number for sets that share them with another."""

    def __init__(self, bits: int = 64, other: dict[tuple[int, int], int] | None = None):
        self.bits, self.other = bits, other or {}

    def pair(self, shingles: np.ndarray) -> tuple[int, int]:
        one, two = set_id(shingles)
        return one >> (64 - self.bits), two

    def of(self, shingles: np.ndarray) -> int:
        pair = self.pair(shingles)
        return self.other.get(pair, pair[0]) if self.other else pair[0]


def _record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def nodes_of(docs: DataFrame, ids: NodeIds) -> DataFrame:
    """``doc_id, node, twin, n_shingles`` of every row; ``twin`` is the other half of the id."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("node bigint, twin bigint, n_shingles bigint").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part, sets in _batches(batches):
            one, two = zip(*(ids.pair(s) for s in sets), strict=True)
            yield _record(arrow, [part.column(0), one, two, [len(s) for s in sets]])

    return docs.mapInArrow(run, schema)


def told_apart(nodes: DataFrame, ids: NodeIds) -> tuple[DataFrame, NodeIds]:
    """``nodes`` with one id for each set, and the ids that do so.

    Different sets share 64 bits once in 2 ** 64 pairs: none of a billion sets, some hundred of 10 ** 11. Only those come
    to the driver.
    """
    sets = nodes.where("n_shingles > 0").groupBy("node", "twin").agg(F.count("*").alias("n"))
    shared = sets.groupBy("node").agg(F.min("twin").alias("stays"), F.count("*").alias("n")).where("n > 1").select("node", "stays")
    rows = sets.join(shared, "node").where("twin <> stays").select("node", "twin").collect()
    if not rows:
        return nodes, ids
    number = lambda pair: xxhash.xxh3_64_intdigest(struct.pack("<2q", *pair), 1) - (1 << 63)
    ids = NodeIds(ids.bits, {tuple(r): number(r) for r in rows})
    other = nodes.sparkSession.createDataFrame([(*pair, new) for pair, new in ids.other.items()], "node bigint, twin bigint, __new bigint")
    return nodes.join(other, ["node", "twin"], "left").withColumn("node", F.coalesce("__new", "node")).drop("__new"), ids


def frequent_shingles(docs: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the prefix regions, sorted, with their counts.

    Each block of texts counts its own shingles first; every text counts, copies too.
    """
    schema = StructType.fromDDL("shingle bigint, n bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(values), 1 << 16):
                yield _record(arrow, [values[i : i + (1 << 16)], counts[i : i + (1 << 16)]])

        for _, sets in _batches(batches):
            for s in sets:
                region = s[: len(s) - _needed_overlap(len(s), percent) + SPARE + len(s) // 16]
                held.append(region)
                size += len(region)
            if size > 1 << 20:
                yield from counted()
                held, size = [], 0
        if size:
            yield from counted()

    counts = docs.mapInArrow(run, schema).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = materialize(counts, "shingle-counts")
    least = LEAST_COUNT
    while counts.where(F.col("n") >= least).count() > FREQUENT:
        least *= 2
    table = counts.where(F.col("n") >= least).toArrow()
    values, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """The chosen prefix of a set, its ``m``, and how many of its shingles aren't frequent."""
    n = len(shingles)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        cost = np.where(frequent[at] == shingles, counts[at], 0)
        order = np.argsort(cost, kind="stable")
        shingles, cost = shingles[order], cost[order]
    else:
        cost = np.zeros(n, np.int64)
    overlap = _needed_overlap(n, percent)
    base, most = n - overlap, min(MOST_MATCHES, overlap)
    read = np.cumsum(cost[: base + most])[base:].astype(np.float64)
    m = int(np.argmin(read + VERIFY * read / np.arange(1, most + 1))) + 1
    return shingles[: base + m], m, int((cost[: base + m] == 0).sum())


def postings(docs: DataFrame, ids: NodeIds, frequent: np.ndarray, counts: np.ndarray, percent: int, hot: int) -> DataFrame:
    """``shingle, part, node, n, m, own`` for the prefix of every distinct set (of a block; copies elsewhere repeat it).

    ``part`` is 0 in lists that aren't split, else from 1.
    """
    schema = StructType.fromDDL("shingle bigint, part int, node bigint, n int, m int, own int")
    arrow = to_arrow_schema(schema)
    known = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def parts_of(prefix: np.ndarray, node: int) -> np.ndarray:
        frequent, counts = known.value
        if not len(frequent):
            return np.zeros(len(prefix), np.int32)
        at = np.minimum(np.searchsorted(frequent, prefix), len(frequent) - 1)
        parts = np.where(frequent[at] == prefix, counts[at] // hot, 0)
        return np.where(parts > 0, 1 + node % (parts + 1), 0).astype(np.int32)

    def run(batches):
        frequent, counts = known.value
        done: set[int] = set()
        for _, sets in _batches(batches):
            found = []
            if len(done) > 1_000_000:
                done.clear()
            for s in sets:
                if len(s) and (node := ids.of(s)) not in done:
                    done.add(node)
                    prefix, m, own = prefix_of(s, frequent, counts, percent)
                    found.append((prefix, parts_of(prefix, node), node, len(s), m, own))
            if found:
                sizes = [len(x[0]) for x in found]
                repeated = (np.repeat(np.array([x[i] for x in found], t), sizes) for i, t in ((2, np.int64), (3, np.int32), (4, np.int32), (5, np.int32)))
                yield _record(arrow, [np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), *repeated])

    return docs.mapInArrow(run, schema)


def _in_list() -> Window:
    """A list or its part in order: first the node with the fewest frequent shingles behind its own, its leader, the likely
    centre of a group of near copies."""
    return Window.partitionBy("shingle", "part").orderBy("own", "node")


def shared_lists(posts: DataFrame) -> DataFrame:
    """Postings without repeated rows, of shingles that several nodes have (those of split lists stay)."""
    copy = F.coalesce(F.lag("node").over(_in_list()) == F.col("node"), F.lit(False))
    one = posts.withColumn("__copy", copy).where("NOT __copy").drop("__copy")
    several = F.coalesce(F.lag("node").over(_in_list()), F.lead("node").over(_in_list())).isNotNull() | (F.col("part") > 0)
    return one.withColumn("__several", several).where("__several").drop("__several")


def _need(one: str, two: str, percent: int) -> str:
    """SQL of how many prefix shingles two nodes must share; ``one`` and ``two`` hold the names with ``{}`` for n and m."""
    n1, m1, n2, m2 = one.format("n"), one.format("m"), two.format("n"), two.format("m")
    overlap = f"(({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent})"
    behind = f"greatest(({percent} * {n1} + 99) div 100 - {m1}, ({percent} * {n2} + 99) div 100 - {m2})"
    return f"greatest(least({m1}, {m2}), {overlap} - {behind})"


def _possible(one: str, two: str, percent: int) -> str:
    """SQL of whether two nodes can be similar: by their sizes, and by how many prefix shingles each shares with anyone."""
    need, small, large = _need(one, two, percent), f"least({one.format('n')}, {two.format('n')})", f"greatest({one.format('n')}, {two.format('n')})"
    return f"({small} * 100 >= {large} * {percent} AND least({one.format('s')}, {two.format('s')}) >= {need})"


def _partners(rows: DataFrame, order: Window, percent: int) -> DataFrame:
    """``a, b, need`` of each row with the ``NEAR`` rows before it and the first of its list."""
    me = F.struct("node", "n", "m", "s")
    near = F.collect_list(me).over(order.rowsBetween(-NEAR, -1))
    rows = rows.select("node", "n", "m", "s", near.alias("near"), F.first(me).over(order).alias("leader"), F.row_number().over(order).alias("place"))
    partners = F.when(F.col("place") > NEAR + 1, F.concat("near", F.array("leader"))).otherwise(F.col("near"))
    rows = rows.where("place > 1").select("node", "n", "m", "s", F.explode(partners).alias("p")).where(_possible("{}", "p.{}", percent))
    return rows.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"), F.least("m", "p.m").alias("need"))


def candidate_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b, need``: a row for each shingle that a possible pair was seen to share. Pairs of long lists may share more."""
    leaders = lists.where("part > 0").groupBy("shingle", "part").agg(F.min(F.struct("own", "node", "n", "m", "s")).alias("x")).select("shingle", "x.*")
    among = _partners(leaders, Window.partitionBy("shingle").orderBy("own", "node"), percent)
    return _partners(lists, _in_list(), percent).union(among)


def _sets(needed: DataFrame, docs: DataFrame, firsts: DataFrame, ids: NodeIds) -> DataFrame:
    """``node, shingles`` of the nodes of ``needed``, made again from the text of one document of each."""
    needed = materialize(needed.select("node").distinct().join(firsts, "node").select(F.col("first").alias("__first")).distinct(), "needed")
    wanted = F.broadcast(needed) if needed.count() <= NEEDED else needed
    docs = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi")
    schema = StructType.fromDDL("node bigint, shingles binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for _, sets in _batches(batches, 64):
            found = {ids.of(s): s.tobytes() for s in sets if len(s)}
            if found:
                yield _record(arrow, [list(found), list(found.values())])

    return materialize(docs.mapInArrow(run, schema).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, ids: NodeIds, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, firsts, ids)
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    result = to_arrow_schema(StructType.fromDDL("a bigint, b bigint"))

    def compare(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            if out:
                yield _record(result, [list(c) for c in zip(*out, strict=True)])

    return materialize(joined.mapInArrow(compare, StructType.fromDDL("a bigint, b bigint")), "verified")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the components ``ca`` and ``cb`` of a pair (the node itself where it has none)."""
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("__ca"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("__cb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").withColumns({"ca": F.coalesce("__ca", "a"), "cb": F.coalesce("__cb", "b")}).drop("__ca", "__cb")


def similar_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block_bytes: int = BLOCK_BYTES, id_bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: documents link where ``100 * |A and B| >= percent * |A or B|``,
    and a component's id is its smallest doc_id.

    Null and empty texts and texts without words have no shingles and link with nothing, other such texts included. Texts
    of fewer than five words have one shingle, all of them. Repeated rows are one node; the smallest id that isn't null
    names a component, null if there is none. An empty table gives no rows. Other columns aren't read. Shingles are told
    apart by 64-bit hashes, sets by 128 bits. ``hot``, ``block_bytes`` and ``id_bits`` change the work, never the result.
    """
    docs = _input(docs, id_col, text_col)
    nodes = materialize(nodes_of(docs, NodeIds(id_bits)), "nodes")
    nodes, ids = told_apart(nodes, NodeIds(id_bits))
    firsts = materialize(nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first")), "firsts")
    frequent, counts = frequent_shingles(docs, percent)
    lists = materialize(shared_lists(postings(docs, ids, frequent, counts, percent, hot)), "lists")
    lists = materialize(lists.join(lists.groupBy("node").agg(F.count("*").cast("int").alias("s")), "node"), "counted-lists")

    pairs = candidate_pairs(lists, percent).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need"))
    pairs = materialize(pairs.where("shared >= need"), "pairs")

    best = lambda x, y: pairs.groupBy(F.col(x).alias("n")).agg(F.max_by(F.struct("a", "b"), F.struct("shared", F.col(y))).alias("p")).select("p.*")
    first = materialize(best("a", "b").union(best("b", "a")).distinct(), "first-pairs")
    links = _verified(first, docs, firsts, ids, percent)
    labels = materialize(components(links), "labels")

    others = materialize(_labelled(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels).where("ca <> cb").select("a", "b"), "other-pairs")
    if not others.isEmpty():
        links = materialize(links.union(_verified(others, docs, firsts, ids, percent)), "all-links")
        labels = materialize(components(links), "labels")

    late = _across(lists, labels, docs, firsts, ids, percent, block_bytes)
    if late is not None:
        labels = materialize(components(materialize(links.union(late), "all-links")), "labels")

    named = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    return nodes.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _across(lists: DataFrame, labels: DataFrame, docs: DataFrame, firsts: DataFrame, ids: NodeIds, percent: int, block_bytes: int) -> DataFrame | None:
    """Links between different components that share a list of more than ``NEAR + 1`` nodes; None if there is no such list.

    Lists are grouped by their largest component. The members outside of it are held against the group's members in the
    same band of set sizes and the two beside it (sizes of a link differ by no more), in blocks of ``block_bytes`` of sets
    and BLOCK_NODES nodes: a task gets two blocks, counts shared prefix shingles with an index over one of them, and verifies pairs that share
    enough, as long as links found there haven't brought their components together. So a set travels once for each
    block it is held against, a block holds thousands of usual texts, and a task returns fewer links than components.
    """
    own = lists.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    groups = own.groupBy("shingle", "c").agg(F.count("*").alias("k"))
    mixed = groups.groupBy("shingle").agg(F.sum("k").alias("size"), F.count("*").alias("parts"), F.max_by("c", F.struct("k", "c")).alias("main"))
    mixed = materialize(mixed.where((F.col("parts") > 1) & (F.col("size") > NEAR + 1)).select("shingle", "main"), "mixed")
    if mixed.isEmpty():
        return None
    members = own.join(mixed, "shingle").groupBy("main", "node").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    members = materialize(members.withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))), "members")
    blocks = lambda n: F.ceil(F.greatest(F.coalesce(F.sum(n), F.lit(0)) * 8 / block_bytes, F.count(n) / BLOCK_NODES)).cast("int")
    bands = materialize(members.groupBy("main", "band").agg(blocks(F.col("n")).alias("all"), blocks(F.when(F.col("c") != F.col("main"), F.col("n"))).alias("outside")), "bands")
    asking = bands.where("outside > 0").select("main", F.col("band").alias("q"), "outside", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    cells = materialize(asking.join(bands.select("main", "band", "all"), ["main", "band"]).withColumnRenamed("band", "r"), "cells")
    count_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asks = members.where("c <> main").withColumnRenamed("band", "q").join(cells, ["main", "q"])
    asks = asks.select("main", "q", "r", "node", "c", "n", "m", F.lit(True).alias("asks"), place("outside").alias("i"), count_to("all").alias("j"))
    those = members.withColumnRenamed("band", "r").join(cells, ["main", "r"])
    those = those.select("main", "q", "r", "node", "c", "n", "m", F.lit(False).alias("asks"), count_to("outside").alias("i"), place("all").alias("j"))
    wanted = materialize(asks.select("node").union(those.select("node")).distinct(), "held")
    prefixes = lists.join(wanted, "node", "left_semi").groupBy("node").agg(F.collect_list("shingle").alias("prefix"))  # a prefix at most
    sets = materialize(_sets(wanted, docs, firsts, ids).join(prefixes, "node"), "held-sets")
    sent = asks.unionByName(those).join(sets, "node")
    result = StructType.fromDDL("a bigint, b bigint")
    arrow = to_arrow_schema(result)

    def links(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        asks = table.column("asks").to_numpy()
        rows = {k: table.column(k).to_numpy() for k in ("node", "c", "n", "m")}
        sets, prefixes = table.column("shingles"), table.column("prefix")
        those = np.flatnonzero(~asks)
        index: dict[int, list[int]] = {}
        for at, i in enumerate(those.tolist()):
            for x in prefixes[i].as_py():
                index.setdefault(x, []).append(at)
        n2, m2, c2, node2 = (rows[k][those].astype(np.int64) for k in ("n", "m", "c", "node"))
        behind2 = -(-n2 * percent // 100) - m2
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for i in np.flatnonzero(asks).tolist():
            n, m, c, node = (int(rows[k][i]) for k in ("n", "m", "c", "node"))
            met = [index[x] for x in prefixes[i].as_py() if x in index]
            if not met:
                continue
            shared = np.bincount(np.concatenate(met), minlength=len(those))
            overlap = -(-percent * (n + n2) // (100 + percent))
            need = np.maximum(np.minimum(m, m2), overlap - np.maximum(_needed_overlap(n, percent) - m, behind2))
            mine = None
            for at in np.flatnonzero((shared >= need) & (c2 != c) & (np.minimum(n, n2) * 100 >= np.maximum(n, n2) * percent)).tolist():
                if top(c) == top(int(c2[at])):
                    continue
                mine = np.frombuffer(sets[i].as_py(), np.int64) if mine is None else mine
                common = len(np.intersect1d(mine, np.frombuffer(sets[int(those[at])].as_py(), np.int64), assume_unique=True))
                if 100 * common >= percent * (n + int(n2[at]) - common):
                    found.append((max(node, int(node2[at])), min(node, int(node2[at]))))
                    parent[top(c)] = top(int(c2[at]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.Table.from_arrays([pa.array(a, arrow[0].type), pa.array(b, arrow[1].type)], schema=arrow)

    return materialize(sent.groupBy("main", "q", "r", "i", "j").applyInArrow(links, result).distinct(), "late-links")
