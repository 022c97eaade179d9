"""Array functions: Column to Column, in built-in expressions only, near-linear in the array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in a block of blocks().
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: int = 0) -> Column:
    """For each of an array of longs, what op makes of zero and all values before it.

    A fold that appends copies its array at each step, so the array is folded in about
    sqrt(n) parts of about sqrt(n) values: n to the power of 1.5 copies in all, of longs.
    """
    start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def fold(part: Column, begin: Column) -> Column:
        return F.aggregate(part, begin, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        parts = let(size, lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda i: F.slice(v, i * k + 1, k)))
        return let(parts, lambda p: inside(p, fold(F.transform(p, lambda c: F.aggregate(c, F.lit(zero).cast("long"), lambda a, x: op(a, x))), start)))

    def inside(parts: Column, begins: Column) -> Column:
        each = F.zip_with(parts, begins, lambda c, b: fold(c, F.struct(b.alias("at"), F.array().cast("array<bigint>").alias("out"))))
        return F.flatten(each)

    return let(values, lambda v: F.when(F.size(v) > 32, whole(v)).otherwise(fold(v, start)))


def blocks(text: Column) -> Column:
    """text in pieces of BLOCK code points, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points begin to end (exclusive) of the text of blocks(), at a cost that doesn't grow with begin."""
    first = F.floor(begin / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    whole = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > begin, F.substring(whole, (begin % BLOCK + 1).cast("int"), (end - begin).cast("int"))).otherwise("")
