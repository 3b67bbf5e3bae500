"""Ranks, running totals and medians of groups of any size.

A window without an end puts a whole group into one task.  Here rows are sorted by range over all groups, every part
is reduced to one row a group, and a part's rows go on from what the parts before it came to.  A part is as large as
the range partitioning makes it, whatever the size of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize

#: Rows of a group that one task may well take in a plain window or an exact median.
LARGE = 1 << 20


def largest(df: DataFrame, *groups: str) -> int:
    """The rows of the largest group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _same(a: str, b: str, names: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for name in names:
        test &= F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return test


def running(df: DataFrame, groups: tuple[str, ...], order: tuple[Column, ...], sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with running sums and maxima of each group in the given order, a row's own value included."""
    sums, greatest = sums or {}, greatest or {}
    values = {**{f"v_{n}": c for n, c in sums.items()}, **{f"v_{n}": c for n, c in greatest.items()}}
    keys = [F.col(g) for g in groups]
    dealt = df.withColumns(values).repartitionByRange(*keys, *order).withColumn("part__", F.spark_partition_id())
    # written, so that a row's part stays what it is
    dealt = materialize(dealt, "ordered")
    whole = dealt.groupBy(*groups, "part__").agg(*(F.sum(f"v_{n}").alias(n) for n in sums), *(F.max(f"v_{n}").alias(n) for n in greatest))
    # a row for each part that a group has
    before = Window.partitionBy(*groups).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*groups, "part__", *(F.sum(n).over(before).alias(f"o_{n}") for n in sums), *(F.max(n).over(before).alias(f"o_{n}") for n in greatest))
    within = Window.partitionBy(*groups, "part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({**{n: F.sum(f"v_{n}").over(within) for n in sums}, **{n: F.max(f"v_{n}").over(within) for n in greatest}})
    both = local.alias("l").join(offsets.alias("o"), _same("l", "o", (*groups, "part__")), "left")
    totals = [(F.col(f"l.{n}") + F.coalesce(F.col(f"o_{n}"), F.lit(0))).alias(n) for n in sums]
    totals += [F.greatest(F.col(f"l.{n}"), F.col(f"o_{n}")).alias(n) for n in greatest]
    return both.select(*(F.col(f"l.`{c}`") for c in df.columns), *totals)


def levels(df: DataFrame, groups: tuple[str, ...], value: str, **counts: Column) -> DataFrame:
    """Each distinct value of a group with how often it occurs (``ties``) and how many values lie below it (``below``).

    ``counts`` adds sums over the value's rows.  Equal values are one row, so no tie crosses a border.
    """
    found = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("ties"), *(F.sum(c).alias(n) for n, c in counts.items()))
    return running(found, groups, (F.col(value),), {"upto": F.col("ties")}).withColumn("below", F.col("upto") - F.col("ties")).drop("upto")


def medians(df: DataFrame, groups: tuple[str, ...], value: str) -> DataFrame:
    """The exact median of each group's values that exist, as ``median``."""
    known = df.where(F.col(value).isNotNull())
    ranked = levels(known, groups, value)
    sizes = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    both = ranked.alias("r").join(sizes.alias("s"), _same("r", "s", groups))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("ties"))
    middle = both.where(holds(low) | holds(high)).select(*(F.col(f"r.{g}").alias(g) for g in groups), F.col(f"r.{value}").cast("double").alias("v"))
    return middle.groupBy(*groups).agg(F.avg("v").alias("median"))
