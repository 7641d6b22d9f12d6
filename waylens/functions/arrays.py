"""Places of matches, and running totals over arrays, in time that grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk. An array grown by ``concat`` costs the square of its size, so only chunks are grown so.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(values: Column, start: Column, combine: Callable[[Column, Column], Column], before: bool) -> Column:
    def step(a: Column, x: Column) -> Column:
        total = combine(a["at"], x)
        return F.struct(total.alias("at"), F.concat(a["out"], F.array(a["at"] if before else total)).alias("out"))

    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])


def _running(values: Column, combine: Callable[[Column, Column], Column], before: bool, levels: int) -> Column:
    if not levels:
        return _grown(values, F.lit(0), combine, before)

    def whole(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, CHUNK))
        return let(F.when(F.size(xs) > 0, chunks).otherwise(F.array().cast("array<array<int>>")), inside)

    def inside(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), combine))
        return F.flatten(F.zip_with(chunks, _running(totals, combine, True, levels - 1), lambda x, at: _grown(x, at, combine, before)))

    return let(values, whole)


def running_sum(values: Column) -> Column:
    """Sums of an array of integers up to and with each element."""
    return _running(values, lambda a, x: a + x, False, 2)


def running_max(values: Column, before: bool = False) -> Column:
    """Maxima of an array of integers from 0 up to and with each element, or ``before`` it."""
    return _running(values, lambda a, x: F.greatest(a, x), before, 2)


def spans(matches: Column, gaps: Column, size: Callable[[Column], Column] = F.length) -> Column:
    """Structs s, e, v of matches: positions (end exclusive), in code points or what ``size`` counts, and text. ``gaps`` are
    the pieces around them."""
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: size(g) + size(m))
    found = F.zip_with(running_sum(sizes), matches, lambda e, m: F.struct((e - size(m)).alias("s"), e.alias("e"), m.alias("v")))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))
