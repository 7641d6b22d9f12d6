"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every document gets a global row number that only its own values and the table decide, a keyed permutation of 0..N-1
turns it into a place, and shard and slot follow from the place by arithmetic: ``shard = place % n`` and
``slot = place // n``. So counts differ by one at most, slots are gapless, and the place of any row number can be computed
without looking at another row.

The permutation is a Feistel network over a rectangle ``a * b >= N`` (Black and Rogaway's generalized form): halves mix
by addition modulo ``a`` and ``b`` in turn. Places from N on are walked along their cycle until they fall below N. With
``a = ceil(sqrt(N))`` the rectangle has fewer than ``a`` spare cells, so a walk rarely has a second step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waylens.llm.common import materialize, row_key, utf8_size

PRIME = 2147483647
ROUNDS = ((48271, 11), (69621, 101), (39373, 1009), (16807, 10007))
#: Steps of a walk. Up to 4,096 rows the spare cells number at most 64; above that one step more is needed with a chance
#: below 1/64, so 64 steps fall short with a chance below 64 ** -64. A row that did would raise, not be misplaced.
WALK = 64
#: Rows of a bucket that the row numbers count through, and the most buckets (their counts are broadcast).
BUCKET_ROWS, MAX_BITS = 64, 14


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def mixed(x: str, factor: int, add: int, seed: int, div: str = "div") -> str:
    """SQL of a round's value: two modular steps, the second a square, so that it isn't linear in x."""
    once = f"(({x} + {seed % PRIME}) * {factor} + {add}) % {PRIME}"
    return f"((({once}) * ({once}) + {add * 7919}) % {PRIME})"


def feistel_sql(x: str, n: int, seed: int, div: str = "div") -> list[tuple[str, str]]:
    """Named SQL steps (l0, r0, l1, ...) of the permutation of ``x`` over ``a * b``; the last is the result ``p``."""
    a, b = sides(n)
    steps = [("l0", f"({x}) {div} {b}"), ("r0", f"({x}) % {b}")]
    left, right = "l0", "r0"
    for i, (factor, add) in enumerate(ROUNDS):
        if i % 2 == 0:
            steps.append((f"l{i + 1}", f"({left} + {mixed(right, factor, add, seed + i)}) % {a}"))
            left = f"l{i + 1}"
        else:
            steps.append((f"r{i + 1}", f"({right} + {mixed(left, factor, add, seed + i)}) % {b}"))
            right = f"r{i + 1}"
    return [*steps, ("p", f"{left} * {b} + {right}")]


def feistel(x: int, n: int, seed: int) -> int:
    """One step of the same permutation for a single number: the place of a row without Spark."""
    a, b = sides(n)
    half = [x // b, x % b]
    for i, (factor, add) in enumerate(ROUNDS):
        here, size = (0, a) if i % 2 == 0 else (1, b)
        once = ((half[1 - here] + (seed + i) % PRIME) * factor + add) % PRIME
        half[here] = (half[here] + (once * once + add * 7919) % PRIME) % size
    return half[0] * b + half[1]


def place(x: int, n: int, seed: int) -> int:
    """Where row number ``x`` of ``n`` goes."""
    while (x := feistel(x, n, seed)) >= n:
        pass
    return x


def _nested(x: str, n: int, seed: int) -> str:
    """The steps as one expression over a lambda variable: each step is bound once through a struct of one-row transforms."""
    out = ""
    for name, sql in feistel_sql(x, n, seed):
        out = f"transform(array({sql}), {name} -> " + "{}" + ")[0]" if not out else out.format(f"transform(array({sql}), {name} -> " + "{}" + ")[0]")
    return out.format("p")


def row_numbers(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Adds ``row_number`` from 0 in the order of the hex string ``key``, and returns the number of rows.

    No task sees all rows: the leading bits of the key make buckets of about ``BUCKET_ROWS`` rows (of more, evenly, beyond
    2 ** 14 buckets), each bucket is numbered on its own, and the 16,384 counts at most give the offsets.
    """
    n = rows.count()
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS)))))
    bucketed = rows.withColumn("__bucket", F.shiftright(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), 16 - bits))
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy(key, *[c for c in rows.columns if c != key])
    numbered = bucketed.withColumn("__inside", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "__bucket")
    return numbered.withColumn("row_number", F.col("__offset") + F.col("__inside")).drop("__bucket", "__inside", "__offset"), n


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place``.

    Law ``rows``: shard counts are at most one apart. Null texts have no bytes (size 16, CRC of nothing); null ids take
    part like any value. Rows are numbered by md5(doc_id, md5(text)); rows equal in both swap places freely, which changes
    no result. An empty table gives no rows. Other columns of ``docs`` aren't read.
    """
    text = F.col(f"`{text_col}`")
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (utf8_size(text) + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        row_key(F.col(f"`{id_col}`"), F.md5(text)).alias("__key"),
    )
    slim = materialize(slim, "shards")
    numbered, n = row_numbers(slim, "__key")
    walked = F.expr(
        f"aggregate(sequence(1, {WALK}), struct(row_number AS p, true AS more), "
        f"(acc, i) -> if(acc.more, transform(array({_nested('acc.p', n, seed)}), q -> struct(q AS p, q >= {n} AS more))[0], acc))"
    )
    placed = numbered.withColumn("__walk", walked)
    p = F.when(F.col("__walk.more"), F.raise_error(F.lit("a cycle walk did not end"))).otherwise(F.col("__walk.p"))
    return placed.withColumn("place", p).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number", "place",
    )


