"""Conversation prefix trie by distributed MSD radix partitioning.

``encode`` gives every distinct turn (role, text) a number in a dictionary and
every conversation the list of its turns' numbers.  ``nodes`` builds the trie
of such lists.  Equal lists are one first, with the number of conversations
and the digest of their ids, so copies cost what one costs.

A bucket is the set of lists below one node.  A round steps over what all
lists of a bucket have in common (the greatest and the least list tell how
much), ends there the list that is used up, and deals the others by their next
number.  Buckets of more than ``local`` turns go to the next round; the rest
goes by bucket to tasks that finish it by multikey quicksort, where every
middle part is a node.  The upper nodes get their sums bottom up, a round at a
time, from the tops of the buckets below.  A node is named by its smallest
conversation and its depth, so buckets need no other keys.

Rows of frequent turns and of large buckets are dealt to several tasks
wherever they meet their one row.  Ids of conversations that end at one node
are sorted by range and joined to pieces of at most a batch; only these pieces
are read one after another, since a SHA-256 is a chain.

Defined results: rows without a conv_id take no part; a null role or text is
empty; turns without a number come first, equal numbers by the digest of role
and text; repeated rows are repeated turns.  Texts of any length count whole,
but only their digest, number and words are moved.  A conversation is one row
of 16 bytes a turn.  An empty table has no nodes.  Only the four named columns
are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, words
from millrace.llm.skew import Hot
from millrace.storage import materialize

#: Turns that a task may well sort, if the shuffle partitions' share isn't more.
LEAST_LOCAL = 1 << 10
#: Turns that a task sorts at once; whole buckets beyond it wait for the next.
_HELD = 1 << 17
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
)
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
RESULT = tuple(_COLUMNS[:-1])


def encode(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv (long), ids (of its turns in order) and words (of each turn's text)."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.size(words(said)).cast("long").alias("words"))
    turns = materialize(rows.where("conv IS NOT NULL"), "trie-turns")
    dictionary = materialize(turns.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = Hot(dictionary, "digest", "rows").join(turns, dictionary.select("digest", "id"), F.col("conv"))
    listed = coded.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words"))).alias("turns"))
    return listed.select("conv", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def shared_starts(sequences: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the start of another.

    The first h turns are those of conversation c - c % ``family`` (all if it has fewer, none if it is absent), then
    follow c's own turns after its first h; h is the CRC-32 of c in decimal modulo ``most``.  The remainder of a
    negative c is negative, as in SQL.
    """
    base = F.col("conv") - F.col("conv") % family
    heads = sequences.where(F.col("conv") % family == 0).select(
        F.col("conv").alias("base"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("words", 1, most - 1).alias("head_words")
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")

    def joined(head: str, own: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast("array<long>"))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    both = sequences.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    return both.select("conv", joined("head_ids", "ids"), joined("head_words", "words"))


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) rows to (key, first, n, ids), the ids of one key in one batch as text."""
    for batch in batches:
        keys, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        ends = [*starts[1:], len(keys)]
        yield _batch(
            {
                "key": pa.array([keys[a] for a in starts], pa.binary()),
                "first": pa.array([convs[a] for a in starts], pa.int64()),
                "n": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                "ids": pa.array([",".join(map(str, convs[a:b])) for a, b in zip(starts, ends, strict=True)], pa.string()),
            }
        )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (conv, n, ends): the smallest id of a key, how many there are, and the digest of all."""
    key, first, n, chain = None, None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for k, f, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if chain:
                    out.append((first, n, chain.hexdigest()))
                key, first, n, chain = k, f, 0, hashlib.sha256()
            else:
                chain.update(b",")
            chain.update(ids.encode())
            n += m
        yield _ended(out)
    if chain:
        yield _ended([(first, n, chain.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    conv, n, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return _batch({"conv": pa.array(conv, pa.int64()), "n": pa.array(n, pa.int64()), "ends": pa.array(ends, pa.string())})


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """Each list once: conv (the smallest with it), ids, words, n (conversations with it) and ends (digest of their ids)."""
    keyed = materialize(sequences.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))), "trie-lists")
    members = keyed.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    pieces = members.mapInArrow(_pieces, "key binary, first long, n long, ids string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_chained, "conv long, n long, ends string")
    return materialize(keyed.drop("key").join(ends, "conv"), "trie-distinct")


class _Nodes:
    """Nodes as columns; a child's place is after its parent's."""

    def __init__(self) -> None:
        self.conv, self.depth, self.above, self.n, self.words, self.ends, self.up, self.top = ([] for _ in range(8))

    def add(self, conv: int, depth: int, above: int, n: int, words: int, up: int) -> int:
        for column, value in zip((self.conv, self.depth, self.above, self.n, self.words, self.ends, self.up, self.top), (conv, depth, above, n, words, NO_ENDS, up, up < 0), strict=True):
            column.append(value)
        return len(self.conv) - 1

    def batch(self) -> pa.RecordBatch:
        children, leaves, saved = [0] * len(self.conv), [0] * len(self.conv), [0] * len(self.conv)
        for i in range(len(self.conv) - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n[i] - 1) * self.words[i]
            if (up := self.up[i]) >= 0:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        values = (self.conv, self.depth, self.above, self.n, children, leaves, saved, self.ends, self.top)
        kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
        return _batch({c: pa.array(v, k) for c, v, k in zip(_COLUMNS, values, kinds, strict=True)})


def quicksort_nodes(rows: list[tuple], above: int, depth: int, out: _Nodes) -> None:
    """Multikey quicksort of one bucket's distinct lists (conv, n, ends, ids, words); its middle parts are nodes.

    ``above`` and ``depth`` name the node that the bucket hangs on.
    """
    stack: list[tuple[list[tuple], int, int]] = [(rows, 0, -1)]
    while stack:
        part, at, up = stack.pop()
        if len(part) == 1:
            conv, n, ends, ids, counts = part[0]
            for k in range(at, len(ids)):
                up = out.add(conv, depth + k + 1, out.conv[up] if up >= 0 else above, n, counts[k], up)
            out.ends[up] = ends
            continue
        keys = [r[3][at] if at < len(r[3]) else -1 for r in part]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        for side in ([r for r, k in zip(part, keys, strict=True) if k < pivot], [r for r, k in zip(part, keys, strict=True) if k > pivot]):
            if side:
                stack.append((side, at, up))
        same = [r for r, k in zip(part, keys, strict=True) if k == pivot]
        if pivot < 0:
            out.ends[up] = same[0][2]
        else:
            conv = min(r[0] for r in same)
            node = out.add(conv, depth + at + 1, out.conv[up] if up >= 0 else above, sum(r[1] for r in same), same[0][4][at], up)
            stack.append((same, at + 1, node))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (b_conv, b_depth, next, conv, n, ends, ids, words) to the nodes of their buckets."""
    bucket, rows, out = None, [], _Nodes()
    for batch in batches:
        for b_conv, b_depth, following, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (b_conv, b_depth, following) != bucket:
                if rows:
                    quicksort_nodes(rows, bucket[0], bucket[1], out)
                if len(out.conv) >= _HELD:
                    yield out.batch()
                    out = _Nodes()
                bucket, rows = (b_conv, b_depth, following), []
            rows.append(tuple(row))
    if rows:
        quicksort_nodes(rows, bucket[0], bucket[1], out)
        yield out.batch()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper buckets (conv, top, depth, parent, n_convs, path, n_children, n_leaves, below, ends) to their nodes from depth up to top."""
    for batch in batches:
        for row in batch.to_pylist():
            m = len(row["path"])
            saved = row["below"] + np.cumsum(np.array(row["path"], dtype=np.int64)[::-1] * (row["n_convs"] - 1))[::-1]
            columns = {
                "conv_id": pa.array([row["conv"]] * m, pa.int64()),
                "depth": pa.array(range(row["top"], row["depth"] + 1), pa.int64()),
                "parent_conv_id": pa.array([row["parent"], *[row["conv"]] * (m - 1)], pa.int64()),
                "n_convs": pa.array([row["n_convs"]] * m, pa.int64()),
                "n_children": pa.array([*[1] * (m - 1), row["n_children"]], pa.int64()),
                "n_leaves": pa.array([row["n_leaves"]] * m, pa.int64()),
                "saved_tokens": pa.array(saved),
                "ends_sha256": pa.array([*[NO_ENDS] * (m - 1), row["ends"]], pa.string()),
                "top": pa.array([k == 0 for k in range(m)]),
            }
            yield _batch(columns)


def _common(a: Column, b: Column) -> Column:
    """How many numbers two lists share from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, F.lit(False)), lambda p: F.when(p == 0, F.size(a)).otherwise(p - 1)).cast("int")


_BUCKET = ("b_conv", "b_depth", "next")


def _deepest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each bucket: how deep all its lists agree, and the words of those turns."""
    found = rows.groupBy(*key).agg(F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.min_by("words", "conv").alias("w"))
    return found.withColumn("depth", _common(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def nodes(sequences: DataFrame, local: int | None = None) -> DataFrame:
    """The trie of ``sequences`` (conv, ids, words), a row for each node: ``RESULT``."""
    spark = sequences.sparkSession
    rows = distinct_sequences(sequences)
    total = rows.agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.sum(F.size("ids")).alias("turns")).first()
    if total["conv"] is None:
        return spark.createDataFrame([], _NODE).select(*RESULT)
    local = local or max(LEAST_LOCAL, total["turns"] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    root = _deepest(rows, F.lit(0).alias("one")).select("depth", F.slice("w", F.lit(1), F.col("depth")).alias("w"))
    buckets = root.select(
        F.lit(total["conv"]).alias("conv"),
        F.lit(0).alias("top"),
        "depth",
        F.lit(None).cast("long").alias("parent"),
        F.lit(total["n_convs"]).alias("n_convs"),
        F.concat(F.array(F.lit(0).cast("long")), "w").alias("path"),
    )
    buckets = materialize(buckets, "trie-buckets")
    depth = buckets.first()["depth"]  # one row
    live = rows.withColumns({"b_conv": F.lit(total["conv"]), "b_depth": F.lit(depth)})
    rounds, waiting = [], []
    while buckets is not None:
        dealt = live.withColumn("next", F.get("ids", F.col("b_depth")))
        rounds.append((buckets, dealt.where("next IS NULL").select("b_conv", "b_depth", "ends")))
        live, buckets, rest = _round(dealt, local)
        waiting.append(rest)
    left = waiting[0]
    for rest in waiting[1:]:
        left = left.unionByName(rest)
    cut = lambda c: F.slice(c, F.col("b_depth") + 1, F.size(c) - F.col("b_depth")).alias(c)
    left = left.select(*_BUCKET, "conv", "n", "ends", cut("ids"), cut("words"))
    lower = materialize(left.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInArrow(_finish, _NODE), "trie-nodes")
    tops = lower.where("top").select(F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"), "n_leaves", F.col("saved_tokens").alias("saved"))
    return lower.select(*RESULT).unionByName(_upper(spark, rounds, tops).select(*RESULT))


def _round(dealt: DataFrame, local: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """One round: rows of the next one with their buckets, those buckets, and the rows that tasks can finish."""
    going = dealt.where("next IS NOT NULL")
    sizes = going.groupBy(*_BUCKET).agg(
        F.min("conv").alias("c_conv"), F.count(F.lit(1)).alias("lists"), F.sum("n").alias("n_convs"), F.sum(F.size("ids") - F.col("b_depth")).alias("turns")
    )
    large = materialize(sizes.where(F.col("turns") > local).select(F.struct(*_BUCKET).alias("key"), "c_conv", "lists", "n_convs"), "trie-large")
    if large.isEmpty():
        return None, None, going
    hot = Hot(large, "key", "lists")
    keyed = hot.salt(going.withColumn("key", F.struct(*_BUCKET)), F.col("conv"))
    moved = keyed.join(hot.repeat(large.select("key", "c_conv")), ["key", "salt"], "left").drop("key", "salt")
    moved = materialize(moved, "trie-moved")
    deeper = moved.where("c_conv IS NOT NULL")
    reach = materialize(_deepest(deeper, "c_conv"), "trie-reach")
    above = large.select("c_conv", F.col("key.b_conv").alias("parent"), (F.col("key.b_depth") + 1).alias("top"), "n_convs", "lists")
    both = materialize(above.join(reach, "c_conv"), "trie-buckets")
    path = F.slice("w", F.col("top"), F.col("depth") - F.col("top") + 1)
    buckets = both.select(F.col("c_conv").alias("conv"), "top", "depth", "parent", "n_convs", path.alias("path"))
    live = Hot(both, "c_conv", "lists").join(deeper.drop(*_BUCKET), both.select("c_conv", F.col("depth").alias("b_depth")), F.col("conv"))
    return materialize(live.withColumnRenamed("c_conv", "b_conv"), "trie-live"), buckets, moved.where("c_conv IS NULL").drop("c_conv")


def _upper(spark: SparkSession, rounds: list, tops: DataFrame) -> DataFrame:
    """The nodes of all rounds; a round's sums come from the tops of the buckets below it."""
    summed = materialize(_sums(tops), "trie-sums")
    done, below = None, None
    for buckets, ended in reversed(rounds):
        sums = summed if below is None else _sums(summed.unionByName(_sums(below)), "children")
        found = buckets.join(sums, (F.col("conv") == F.col("parent_")) & (F.col("depth") == F.col("at")), "left")
        found = found.join(ended, (F.col("conv") == F.col("b_conv")) & (F.col("depth") == F.col("b_depth")), "left")
        zero = F.lit(0).cast("long")
        node = materialize(
            found.select(
                "conv",
                "top",
                "depth",
                "parent",
                "n_convs",
                "path",
                F.coalesce("children", zero).alias("n_children"),
                F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                F.coalesce("saved", zero).alias("below"),
                F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"),
            ),
            "trie-upper",
        )
        own = F.aggregate("path", zero, lambda a, x: a + x) * (F.col("n_convs") - 1)
        below = node.select("parent", (F.col("top") - 1).alias("at"), "n_leaves", (F.col("below") + own).alias("saved"))
        done = node if done is None else done.unionByName(node)
    return done.mapInArrow(_paths, _NODE)


def _sums(kids: DataFrame, count: str | None = None) -> DataFrame:
    """Per parent (parent_, at): children, their leaves and savings; ``count`` names a column of children already counted."""
    n = F.sum(count) if count else F.count(F.lit(1))
    name = "parent_" if count else "parent"
    return kids.groupBy(F.col(name).alias("parent_"), F.col("at").cast("long").alias("at")).agg(n.alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
