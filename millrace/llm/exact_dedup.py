"""Exact deduplication by skew-safe combining.

Texts are equal when they agree after every run of white space has become one
space.  Each stage groups by digest and full content, so two texts of one
digest are never taken for one another:

1. Every task deduplicates what it reads: partial aggregates leave one row for
   each content and task.
2. These rows meet by digest, content and salt.  Digests of more than
   ``skew.SHARE`` documents have several salts, one for a task's rows, all
   others have one, so their groups are complete here.
3. The salts' winners, one row a content and salt, meet by digest and content.

Documents then take their group's result by digest, in narrow rows, the hot
digests again dealt to several tasks.  Only where two contents share a digest
do documents find their group by content as well.  Texts are shuffled once, as
far as a task has not seen them before.

Defined results: a null text counts as empty; a text of white space alone is
one space and not equal to an empty one.  The row with the smallest doc_id
stays, a null doc_id last; of rows that agree in that too exactly one stays.
A text of any length is compared whole.  An empty table gives an empty one.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.skew import Hot
from millrace.storage import materialize


def normal(text: Column) -> Column:
    """The text with one space for each run of white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ")


def digest_of(content: Column) -> Column:
    """Lower-case hex of the content's SHA-256."""
    return F.sha2(content, 256)


_RESULT = ("id", "keep_id", "group_size", "kept", "digest")


def _groups(rows: DataFrame, *key: str) -> DataFrame:
    """One row a key: the smallest id and the number of documents; ``rows`` may be documents or groups of them."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.groupBy(*key).agg(F.min("id").alias("id"), n.alias("n"))


def _first_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, digest, group, keep_id, group_size) with ``kept``: one row of each group whose id is the group's."""
    stays = rows.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "group").agg(F.min("row").alias("row"))
    return rows.join(stays.select("row", F.lit(True).alias("first")), "row", "left").withColumn("kept", F.coalesce("first", F.lit(False)))


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = digest_of) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    ``digest`` may be any function of the content; a weak one costs time, not exactness.
    """
    rows = docs.select(F.col(doc_id).alias("id"), normal(F.col(text)).alias("content")).withColumn("digest", digest(F.col("content")))
    narrow = materialize(rows.select("id", "digest").withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    hot = Hot(materialize(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "dedup-sizes"), "digest", "rows")
    salted = _groups(hot.salt(rows, F.spark_partition_id()), "digest", "content", "salt")
    if hot.empty:
        groups = salted.select("digest", "id", "n")
    else:
        # contents that no other salt can hold aren't needed any more
        many = hot.table.select(F.col("hot_key").alias("digest"), F.lit(True).alias("many"))
        salted = salted.join(F.broadcast(many), "digest", "left")  # at most skew.MOST rows
        salted = materialize(salted.select("digest", F.when(F.col("many"), F.col("content")).alias("content"), "id", "n", "many"), "dedup-salts")
        winners = _groups(salted.where("many"), "digest", "content")
        groups = salted.where("many IS NULL").select("digest", "id", "n").unionByName(winners.select("digest", "id", "n"))
    groups = materialize(groups.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")), "dedup-groups")
    clashes = materialize(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"), "dedup-clashes")
    if clashes.isEmpty():
        found = hot.join(narrow, groups, F.col("row")).withColumn("group", F.lit(""))
        return _first_of_each(materialize(found, "dedup-found")).select(*_RESULT)
    alone = groups.join(clashes, "digest", "left_anti")
    plain = hot.join(narrow, alone, F.col("row")).withColumn("group", F.lit(""))
    mixed = materialize(rows.join(clashes, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "dedup-clashing")
    sizes = materialize(_groups(mixed, "digest", "content").withColumnsRenamed({"id": "keep_id", "n": "group_size"}), "dedup-clash-groups")
    crowded = Hot(sizes.withColumn("key", F.struct("digest", "content")), "key", "group_size")
    keyed = mixed.withColumn("key", F.struct("digest", "content")).select("row", "id", "key")
    by_content = crowded.join(keyed, sizes.select(F.struct("digest", "content").alias("key"), "keep_id", "group_size"), F.col("row"))
    by_content = by_content.select("row", "id", "key.digest", F.col("key.content").alias("group"), "keep_id", "group_size")
    parts = [_first_of_each(materialize(p, "dedup-found")).select(*_RESULT) for p in (plain, by_content)]
    return parts[0].unionByName(parts[1])
