"""Searches in sorted arrays, prefix sums and chains of pointers as Column expressions.

All take a number of array passes that grows with the logarithm of the length, so long arrays in one row stay cheap
and need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let


def powers(n: Column) -> Column:
    """1, 2, 4 and so on, up to the last power of two that isn't above n (which is at least 1)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))


def prefix_sums(sizes: Column) -> Column:
    """0 and the running sums of an array of ints."""

    def sums(start: Column) -> Column:
        step = lambda acc, p: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= p, F.get(acc, i - p)), F.lit(0)))
        return F.aggregate(powers(F.size(start)), start, step)

    return let(F.concat(F.array(F.lit(0)), sizes), sums)


def first_at_least(ascending: Column, target: Column, steps: Column) -> Column:
    """The first place (from 0) of a value not below ``target``, or the length; ``steps`` are the powers up to the length."""
    n = F.size(ascending)
    further = lambda at, p: F.when((at + p <= n) & (F.get(ascending, at + p - 1) < target), at + p).otherwise(at)
    return F.aggregate(F.reverse(steps), F.lit(0), further)


def chain(following: Column) -> Column:
    """0, its successor and so on: the places before the last one that ``following`` leads through.

    ``following`` holds a later place for every place but the last, which leads to itself.  Each pass doubles the
    places known, and the stride of the pointers.
    """

    def places(pointers: Column) -> Column:
        last = F.size(pointers) - 1

        def double(acc: Column, _: Column) -> Column:
            known, jump = acc["known"], acc["jump"]
            longer = F.concat(known, F.transform(known, lambda s: F.get(jump, s)))
            more = F.struct(longer.alias("known"), F.transform(jump, lambda s: F.get(jump, s)).alias("jump"))
            return F.when(F.element_at(known, -1) < last, more).otherwise(acc)

        start = F.struct(F.array(F.lit(0)).alias("known"), pointers.alias("jump"))
        found = F.aggregate(F.concat(powers(F.size(pointers)), F.array(F.lit(0))), start, double, lambda acc: acc["known"])
        return F.filter(found, lambda s: s < last)

    return let(following, places)
