"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node.  A node with any
number of edges is reduced by partial aggregates; where there are more than
``FEW`` edges, so that a node could have more, its edges are dealt to several
tasks for the join.  Nothing is gathered in one task or the driver.  Each
step's edges are written to the shared folder, a file for ``FEW`` edges at
least, with a mark on those that the step changed: where a large star moves
nothing after a small star that hung nothing, the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.skew import Hot
from millrace.storage import discard, gather, materialize


#: Edges that one task may well join.
FEW = 1 << 12


def components(edges: DataFrame, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """``edges`` (a, b) to ``node`` and ``root``: each node but the least of its component, which is the root.

    An empty edge table gives an empty result; repeated edges and loops don't matter.  After ``rounds``, if that is
    given, the edges are returned as they are then: they have the same components, but a node may be in several rows,
    and what it is tied to may be tied to something less.  ``most`` says how many edges there are at most, if known.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now if most is None else gather(now, most, FEW), "edges")
    rows, hung, done = now.count(), True, 0
    while rows and done != rounds:
        # large star: larger neighbours of a node are tied to the least of all its neighbours and itself
        both = _each(now, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        tied = _tied(both, F.least("u", "m"), 2 * rows).where("v > u")
        large = _distinct(tied.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("changed")), rows)
        rows, moved = _state(large)
        if not (moved or hung):
            discard(now.sparkSession, large)
            break
        # small star: smaller neighbours of a node, and the node, are tied to the least of them
        less = F.struct(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("changed"))
        self = F.struct("u", F.col("m").alias("v"), F.lit(False).alias("changed"))
        small = _distinct(_each(_tied(large.select("u", "v"), F.col("m"), rows), less, self).where("u <> v"), 2 * rows)
        rows, hung = _state(small)
        discard(now.sparkSession, now, large)
        now, done = small, done + 1
        if not (moved or hung):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.max("changed")).first())


def _each(rows: DataFrame, *made: Column) -> DataFrame:
    """A row for each of the structs that are ``made`` of a row."""
    return rows.select(F.inline(F.array(*made)))


def _distinct(edges: DataFrame, most: int) -> DataFrame:
    """The distinct edges of at most ``most``, written down; ``changed`` if any of the equal ones was."""
    found = edges.groupBy("u", "v").agg(F.max("changed").alias("changed"))
    return materialize(gather(found, most, FEW), "edges")


def _tied(edges: DataFrame, least: Column, most: int) -> DataFrame:
    """The edges (u, v), at most ``most``, with ``m``, the least that ``least`` makes of u and of its neighbours' least."""
    ends = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = ends.select("u", least.alias("m"))
    if most <= FEW:
        return edges.join(tied, "u")
    return Hot(gather(ends.select("u", "n"), most, FEW), "u", "n").join(edges, tied, F.col("v"))
