"""Joins whose hot keys are dealt to several tasks.

A join of many rows with a table of one row per key sends all rows of a key to
one task.  ``Hot`` holds the keys with most rows, at most ``MOST`` of them and
a number each, so that the list may pass the driver and be broadcast; a key
beyond it has less than one in ``MOST`` of all rows.  Rows of a hot key get a number by a hash of another column, the
table's row is repeated once for every ``SHARE`` rows, and the join is on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000
SHARE = 512
MOST_PARTS = 10_000


class Hot:
    """The hot keys of ``sizes`` (a column of keys, one of their numbers of rows)."""

    def __init__(self, sizes: DataFrame, key: str, size: str):
        self.key = key
        top = sizes.where(F.col(size) > SHARE).orderBy(F.desc(size), key).limit(MOST)
        parts = F.least(F.ceil(F.col(size) / SHARE), F.lit(MOST_PARTS)).cast("int")
        found = top.select(F.col(key).alias("hot_key"), parts.alias("parts"))
        rows = found.collect()
        self.empty = not rows
        self.table = sizes.sparkSession.createDataFrame(rows, found.schema)

    def _with_parts(self, df: DataFrame) -> DataFrame:
        # at most MOST rows of a key and a number
        return df.join(F.broadcast(self.table), F.col(self.key) == F.col("hot_key"), "left").drop("hot_key")

    def salt(self, rows: DataFrame, by: Column) -> DataFrame:
        """``rows`` with ``salt``, by which rows of a hot key are dealt."""
        if self.empty:
            return rows.withColumn("salt", F.lit(0))
        part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")
        return self._with_parts(rows).withColumn("salt", part).drop("parts")

    def repeat(self, table: DataFrame) -> DataFrame:
        """``table`` with ``salt``, hot keys once for every value that it has in rows."""
        if self.empty:
            return table.withColumn("salt", F.lit(0))
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        return self._with_parts(table).withColumn("salt", F.explode(parts)).drop("parts")

    def join(self, rows: DataFrame, table: DataFrame, by: Column) -> DataFrame:
        """``rows`` joined with ``table`` on the key; ``by`` tells rows of a key apart."""
        if self.empty:
            return rows.join(table, self.key)
        return self.salt(rows, by).join(self.repeat(table), [self.key, "salt"]).drop("salt")
