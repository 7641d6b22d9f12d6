"""Mixing sources to target weights: Efraimidis-Spirakis sampling within each source.

Each document draws an exponential key ``-ln(u) / w`` with ``u`` from a hash of its id and ``w`` its quality weight, so
the ascending order of keys is a weighted sample without replacement of any length. A source first takes its complete
epochs (``target div size``), then the documents at the head of that order whose prefix sum fills the rest of its target;
the document across the edge is in if that brings the sum nearer.

A source may hold a third of all rows, so no task sorts a source. The weights have 20 levels; with the share of rows on
each level, ``F(k) = sum(share * (1 - exp(-w * k)))`` is the very distribution of a source's keys, and ``F(k) * buckets``
cuts each source into even, ordered buckets. Buckets are sorted and summed on their own, their totals give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylens.llm.common import materialize, row_key, unit, words

LEVELS = 20
CYCLE = (5, 2, 1)
#: Rows of a bucket, and the most buckets of a source.
BUCKET_ROWS, MAX_BUCKETS = 128, 16384
#: Sources up to this number are broadcast (some 1 kB each); beyond it they're joined by key and salt.
BROADCAST_SOURCES, SALTS = 20_000, 32


def quality_level(text: Column, n_words: Column) -> Column:
    """Quality weight as a level from 1 to 20: the fewer of ``# * $ % & | < > !`` a word, the higher."""
    marks = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>!]"))
    share = F.when(n_words > 0, F.least(F.lit(1.0), marks / n_words)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(1), F.ceil(LEVELS * (1 - share))).cast("int")


def source_targets(sizes: DataFrame, cap: int = 3, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: sources by code point, null last, weigh ``cycle`` in turn and share the
    total; a target stops at ``cap`` times its source's size and the excess is shared again by weight.

    That sharing has a closed form: in the order of ``cap * size / weight``, the first sources are capped, and the first
    one that holds ``(total - capped) / (weights left)`` per weight ends them. Only one row a source goes through this.
    """
    ranked = sizes.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weigh = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.col("__i") % len(cycle) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weigh).withColumn("__cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("__before", F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__free", F.col("__total") - F.col("__before"))
        .withColumn("__holds", F.col("__free") * F.col("__w") <= F.col("__cap") * F.col("__left"))
        .withColumn("__row", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("__holds"), F.col("__row"))).over(everything)
    edge = F.min(F.when(F.col("__holds"), F.struct("__row", "__free", "__left"))).over(everything)
    target = F.when(F.col("__row") < first, F.col("__cap").cast("double")).otherwise(edge["__free"] * F.col("__w").cast("double") / edge["__left"])
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the rows of sources to each row of theirs: one hot source never meets in one task."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["__source"])).drop("__source")
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__row_salt", F.conv(F.substring("__key", 14, 4), 16, 10).cast("int") % SALTS)
    on = rows["source"].eqNullSafe(salted["__source"]) & (F.col("__row_salt") == F.col("__salt"))
    return rows.join(salted, on).drop("__source", "__salt", "__row_salt")


def mix_sources(
    docs: DataFrame, seed: int = 1, cap: int = 3, cycle: tuple[int, ...] = CYCLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, epochs, picked``: how often each row of ``docs`` is taken.

    Size is the number of words. Null texts have none: they are never taken and take up no budget; a null source is a
    source of its own, last in the order. Rows that repeat an id and a text stand next to each other in the order and
    each counts; ties end with the size. An empty table gives no rows. The same table gives the same mix in any
    partitioning. Other columns aren't read.
    """
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.size(words(text)).cast("long").alias("size"), text.alias("__text"))
    slim = slim.select("doc_id", "source", "size", quality_level(F.col("__text"), F.col("size")).alias("__level"), row_key(F.lit(seed), F.col("doc_id"), F.col("size")).alias("__key"))
    slim = materialize(slim, "mix")

    levels = slim.groupBy("source", "__level").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = levels.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("n").alias("__n"), F.sort_array(F.collect_list(F.struct("__level", "n"))).alias("__levels")
    )
    sizes = materialize(sizes, "mix-sources")
    targets = source_targets(sizes.select("source", "source_size"), cap, cycle).withColumnRenamed("source", "__source").drop("source_size")
    buckets = F.greatest(F.lit(1), F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("__n") / BUCKET_ROWS)))
    sources = materialize(
        sizes.join(targets, sizes["source"].eqNullSafe(targets["__source"])).drop("source").select("__source", "source_size", "target", "__n", "__levels", buckets.alias("__buckets")), "mix-targets"
    )

    rows = _with_sources(slim, sources).withColumn("__k", -F.log(unit(F.col("__key"))) * LEVELS / F.col("__level"))
    below = F.aggregate("__levels", F.lit(0.0), lambda a, x: a + x["n"] / F.col("__n") * (1 - F.exp(-F.col("__k") * x["__level"] / LEVELS)))
    rows = rows.withColumn("__bucket", F.least(F.col("__buckets") - 1, F.floor(below * F.col("__buckets"))).cast("int")).drop("__levels", "__buckets", "__n")

    totals = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("__source"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    joined = rows.join(offsets, rows["source"].eqNullSafe(offsets["__source"]) & (F.col("__bucket") == F.col("__at"))).drop("__source", "__at")
    inside = Window.partitionBy("source", "__bucket").orderBy("__k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    mixed = joined.withColumn("__prior", prior).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    mixed = mixed.withColumn("picked", ((F.col("size") > 0) & (2 * F.col("__prior") + F.col("size") <= 2 * rest)).cast("long"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("picked")) * F.col("size")).alias("taken"), "epochs", "picked")
