"""SimHash near duplicates by tiled exact comparison.

A fingerprint's tile is named by the population counts of its four 16-bit quarters. Two fingerprints differ in at least as many
bits as their counts do, quarter by quarter, so tiles whose counts differ by more than the radius in all are skipped; the
other pairs of tiles are compared whole with numpy's exclusive or and bit counts. From a pair of tiles come the edges of a
forest over what links there, never all pairs of a group.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from waylens.llm.common import map_texts, materialize
from waylens.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile's part, shingles hashed at a time, and cells compared at a time.
TILE_ROWS, PART, CELLS = 512, 1 << 15, 1 << 20
QUARTERS, SIDE = 4, 17
#: Classes of so many fingerprints at most (16 bytes each) are broadcast to the documents.
BROADCAST_ROWS = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned whole number: a bit is set if over half of the shingles' hashes have it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line, size = b" ".join(found), len(found)
    if size <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, size) + 1) - 1
    del found
    n, counts, digest = size - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, PART):
        until = min(n, at + PART)
        starts = np.concatenate(([0], ends[: until - 1] + 1))[at:until].tolist()
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[at + shingle - 1 : until + shingle - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long."""
    def work(texts: list) -> tuple:
        return (np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64),)

    return map_texts(docs, lambda: work, "fp bigint", id_col, text_col)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def tile_of(fp: Column) -> Column:
    """A number for the population counts of the quarters."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int") for q in range(QUARTERS)]
    return sum((c * SIDE**q for q, c in enumerate(counts)), F.lit(0))


def near_tiles(radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Differences of counts between a tile and those it is compared with: one of each two opposite ones, and none at all."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius]
    return sorted(s for s in steps if s >= (0,) * QUARTERS)


def forest(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest with the components that links between ``a`` and ``b`` make, the least of each being its root."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    first, second = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    step = max(1, CELLS // max(1, len(b)))
    for start in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[start : start + step, None] ^ b[None, :]) <= radius)
        i, j = first[start + i], second[j]
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``a, b``: forests over all links between the fingerprints ``fp`` of ``distinct``, one a pair of tiles.

    Tiles are cut into parts of ``tile_rows`` fingerprints on average by a hash, so a crowded tile is many parts, each with
    pairs of its own. There are at most 17^4 tiles, whose numbers of parts are broadcast.
    """
    keyed = distinct.select("fp", tile_of(F.col("fp")).alias("tile"))
    sizes = materialize(keyed.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")), "tiles")
    parts = keyed.join(F.broadcast(sizes), "tile").groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    parts = materialize(parts.agg(F.collect_list("fp").alias("fps")), "tile-parts")

    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in near_tiles(radius)])).alias("step")
    counts = [F.floor(F.col("tile") / SIDE**q) % SIDE for q in range(QUARTERS)]
    moved = [(c + F.col("step")[q]).cast("int") for q, c in enumerate(counts)]
    valid = moved[0].between(0, SIDE - 1)
    for m in moved[1:]:
        valid = valid & m.between(0, SIDE - 1)
    pairs = sizes.select("tile", steps).where(valid).select("tile", sum((m * SIDE**q for q, m in enumerate(moved)), F.lit(0)).alias("other"))
    pairs = pairs.join(F.broadcast(sizes.select(F.col("tile").alias("other"), F.col("parts").alias("others"))), "other")
    pairs = materialize(pairs, "tile-pairs")
    sent = parts.join(pairs.hint("broadcast") if pairs.count() <= BROADCAST_ROWS else pairs, "tile")
    sent = sent.select(F.col("tile").alias("from"), F.col("part").alias("from_part"), F.col("fps").alias("left"), F.col("other").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("part"))
    sent = sent.where("from <> tile OR from_part <= part")
    met = sent.join(parts, ["tile", "part"]).select("left", F.col("fps").alias("right"))
    result = StructType.fromDDL("a bigint, b bigint")
    arrow = to_arrow_schema(result)

    def compare(batches):
        for batch in batches:
            left, right = batch.columns
            lefts, rights = left.offsets.to_numpy(), right.offsets.to_numpy()
            a, b = left.values.to_numpy(), right.values.to_numpy()
            found = [forest(a[lefts[i] : lefts[i + 1]], b[rights[i] : rights[i + 1]], radius) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in (0, 1)], schema=arrow)

    return met.mapInArrow(compare, result)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: fingerprints link at ``radius`` or fewer differing bits, and a
    component's id is its smallest doc_id.

    Null and empty texts and texts without words have fingerprint zero, which links like any other. Texts of fewer than four
    words hash as a whole. Repeated rows are rows of one fingerprint; the smallest id that isn't null names a component, null
    if there is none. An empty table gives no rows; other columns aren't read. ``tile_rows`` changes the work, never
    the result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    labels = materialize(components(materialize(tile_links(firsts, radius, tile_rows), "tile-links")), "labels")
    named = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    # a row alone with its fingerprint is a component of its own; only classes of several rows are joined
    classes = materialize(named.join(names, "component").where("n > 1 OR size > 1").select("fp", "component_id", F.lit(True).alias("shared")), "classes")
    found = rows.join(F.broadcast(classes) if classes.count() <= BROADCAST_ROWS else classes.hint("merge"), "fp", "left")
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
