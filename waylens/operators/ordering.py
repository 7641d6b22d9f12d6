"""Ranks and neighbours in a global order, without a task that sees all rows of a key.

Rows are dealt to tasks by ranges of the order and written once, so that the ranges stay what they are; ranks and
neighbours are found inside the ranges, and a row for each range and key tells what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waylens.plans.scratch import cut


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``__p``, the number of their range of ``order``."""
    return cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in ``order``, which should be total."""
    placed = ranged(rows, *order)
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))  # a row a range
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn("rank", F.col("__before") + F.col("__i") - 1).drop("__p", "__i", "__before")


def with_largest_before(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the largest ``value`` of all rows that stand before in ``order``, which should be total where it matters;
    null if there is none."""
    placed = ranged(rows, *order)
    tops = placed.groupBy("__p").agg(F.max(value).alias("__top"))  # a row a range
    before = tops.select("__p", F.max("__top").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("__own", inside).join(F.broadcast(before), "__p").withColumn(name, F.greatest("__own", "__before")).drop("__p", "__own", "__before")


#: Rows of a key that one task takes in a window; keys with more are cut into ranges.
KEY_ROWS = 2_000_000


def with_previous(rows: DataFrame, by: str, order: list[str], what: list[str], most: int = KEY_ROWS) -> DataFrame:
    """``rows`` with ``previous``, a struct of ``what`` of the row before in the order of ``by`` and ``order``; null for the first row of a
    key.

    One aggregation tells the largest key. If no key has more than ``most`` rows that is a window over the key; otherwise
    rows are dealt by ranges, whose number ``__p`` they keep, and only the first row of a key in a range looks beyond it.
    """
    largest = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows.withColumn("previous", F.lag(F.struct(*what)).over(Window.partitionBy(by).orderBy(*order)))
    placed = ranged(rows, by, *order)
    inside = Window.partitionBy("__p", by).orderBy(*order)
    own = placed.withColumn("__i", F.row_number().over(inside)).withColumn("previous", F.lag(F.struct(*what)).over(inside))
    lasts = placed.groupBy("__p", by).agg(F.max_by(F.struct(*what), F.struct(*order)).alias("__last"))  # a row for each range and key
    carried = lasts.select(F.col("__p").alias("__q"), F.col(by).alias("__by"), F.lag("__last").over(Window.partitionBy(by).orderBy("__p")).alias("__carried"))
    joined = own.join(carried, (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.withColumn("previous", F.when(F.col("__i") == 1, F.col("__carried")).otherwise(F.col("previous"))).drop("__i", "__q", "__by", "__carried")


def running_total(rows: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row of its key; ``rows`` are those of ``with_previous``."""
    if "__p" not in rows.columns:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("__p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("__p", by).agg(F.sum(value).alias("__t"))
    before = totals.select(F.col("__p").alias("__q"), F.col(by).alias("__by"), F.coalesce(F.sum("__t").over(Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__own", F.sum(value).over(inside)).join(before, (F.col("__p") == F.col("__q")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.withColumn(name, F.col("__own") + F.col("__before")).drop("__p", "__own", "__q", "__by", "__before")
