"""Exact top-k search by tiled matrix products.

Queries and candidates are packed into blocks: one row holds the ids and the
components of up to ``BLOCK`` vectors.  Candidate blocks are dealt to
shards, every shard gets every query block, and each pair of blocks is a tile:
one matrix product, a partial selection of k per query, and the tile's lists
merge with those of the shard's other tiles.  The shards' lists then merge in
a tree of fan-in ``FAN``: no task ever holds more than k rows for each query
and shard, however many vectors there are.

Scores are integer inner products, exact for components of any size.  A
floating-point product is exact where the sum of the terms' magnitudes stays
below 2**52.  In tiles where it doesn't, products in integers modulo 2**64 are
exact for every score that fits a long, and the floating-point product tells
which do; what it can't tell is summed in unbounded integers.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows without an id; vectors of different
length don't meet.  A query's own id is no candidate, so repeated rows of one
id don't find each other.  Ties go to the smaller id.  An id given twice can
fill two ranks of another query's list.  A score beyond the range of a long
counts as the nearest long (the least one excepted, which no score has).  An
empty table, or no query, gives an empty result.  Only the id and the vector
are read, so other columns may have any names; texts play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
FAN = 16
SCALE = 256
_MOST = np.iinfo(np.int64).max

_PACKED = "dim int, n int, ids binary, vectors binary"
_LISTS = "query_id long, vec_id long, score long"


def components(vector: Column) -> Column:
    """The vector as doubles; null where it takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(doubles) > 0) & finite, doubles)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, components) to blocks; a block's vectors have one length and ascend by id."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int, ids: list, vectors: list) -> pa.RecordBatch:
        a, v = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(a, kind="stable")
        data = [[dim], [len(a)], [a[order].tobytes()], [np.ascontiguousarray(v[order]).tobytes()]]
        return pa.RecordBatch.from_arrays(
            [pa.array(data[0], pa.int32()), pa.array(data[1], pa.int32()), pa.array(data[2], pa.binary()), pa.array(data[3], pa.binary())],
            names=["dim", "n", "ids", "vectors"],
        )

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths):
            rows = np.nonzero(lengths == dim)[0]
            at = starts[rows][:, None] + np.arange(dim)
            known = held.setdefault(int(dim), ([], []))
            for part in range(0, len(rows), BLOCK):
                known[0].append(ids[rows[part : part + BLOCK]].astype(np.int64))
                known[1].append(flat[at[part : part + BLOCK]])
                if sum(map(len, known[0])) >= BLOCK:
                    yield block(int(dim), *known)
                    known[0].clear(), known[1].clear()
    for dim, known in held.items():
        if known[0]:
            yield block(dim, *known)


def pack(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vectors`` as blocks; the rows of one task fill its blocks one after another."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), components(F.col(vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(_pack, _PACKED)


def _modular(raw: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` modulo 2**64, as signed 64-bit integers."""
    whole = np.floor(raw * scale)
    small = np.abs(whole) < 2.0**62
    out = np.where(small, whole, 0).astype(np.int64)
    for at in zip(*np.nonzero(~small), strict=True):
        out[at] = np.uint64(_exact(raw[at], scale) & 0xFFFFFFFFFFFFFFFF).astype(np.int64)
    return out


def _exact(x: float, scale: int) -> int:
    """``floor(scale * x)`` without bounds: a double of this size is an integer itself."""
    return int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale))


def products(q: np.ndarray, c: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of ``floor(scale * x)`` of all rows of ``q`` and ``c`` as longs; beyond their range the nearest."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole_q, whole_c = np.floor(q * scale), np.floor(c * scale)
        near = whole_q @ whole_c.T
        if np.abs(whole_q).max() * np.abs(whole_c).max() * q.shape[1] < 2.0**52:
            return near.astype(np.int64)
        reach = np.abs(whole_q) @ np.abs(whole_c).T
        error = reach * (q.shape[1] + 2) * 2.0**-52
        out = _modular(q, scale) @ _modular(c, scale).T
        above, below = near - error >= 2.0**63, near + error <= -(2.0**63)
        sure = above | below | (np.abs(near) + error < 2.0**63 - 1024)
        out = np.where(above, _MOST, np.where(below, -_MOST, out))
    for i, j in zip(*np.nonzero(~sure), strict=True):
        total = sum(_exact(x, scale) * _exact(y, scale) for x, y in zip(q[i].tolist(), c[j].tolist(), strict=True))
        out[i, j] = min(max(total, -_MOST), _MOST)
    return out


def best_of_tile(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one tile of scores for each query, as (query, id, score) arrays.  ``c_ids`` ascend."""
    n = len(c_ids)
    own = q_ids[:, None] == c_ids[None, :]
    take = min(k, n)
    if max(-int(scores.min()), int(scores.max())) < (1 << 61) // n:
        # one number holds the score and, among equals, the earlier place
        keys = scores * n + (n - 1 - np.arange(n))
        keys[own] = np.iinfo(np.int64).min
        top = np.argpartition(keys, n - take, axis=1)[:, n - take :]
    else:
        # the complement turns the order of longs round without overflow
        top = np.argsort(~np.where(own, np.iinfo(np.int64).min, scores), axis=1, kind="stable")[:, :take]
    keep = ~np.take_along_axis(own, top, 1)
    rows = np.broadcast_to(np.arange(len(q_ids))[:, None], top.shape)[keep]
    cols = top[keep]
    return q_ids[rows], c_ids[cols], scores[rows, cols]


def _first_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, ~scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.r_[True, query[1:] != query[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], scores[keep]


def _tiles(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            merged = _first_k(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                dim, qi, qv, ci, cv = (batch.column(x)[row].as_py() for x in ("dim", "q_ids", "q_vectors", "ids", "vectors"))
                q, c = (np.frombuffer(v, np.float64).reshape(-1, dim) for v in (qv, cv))
                held.append(best_of_tile(np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64), products(q, c, scale), k))
                waiting += len(held[-1][0])
                if waiting > 200_000:
                    out = flush()
                    held, waiting = [], 0
                    yield out
        if held:
            yield flush()

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shards: int | None = None
) -> DataFrame:
    """For each row of ``queries`` its ``k`` best of ``vectors``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")
    blocks = pack(vectors, vec_id, vector).withColumn("shard", dealt)
    asked = pack(queries, vec_id, vector).select(
        F.col("dim").alias("q_dim"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to"),
    )
    tiles = blocks.join(asked, (F.col("shard") == F.col("to")) & (F.col("dim") == F.col("q_dim")))
    lists = tiles.select("dim", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(_tiles(k, scale), _LISTS)
    lists = lists.withColumn("leaf", F.spark_partition_id())
    best = [F.col("score").desc(), F.col("vec_id")]
    width = shards
    while width > FAN:
        width = -(-width // FAN)
        lists = lists.withColumn("leaf", F.pmod("leaf", F.lit(width)))
        nth = F.row_number().over(Window.partitionBy("query_id", "leaf").orderBy(*best))
        lists = lists.withColumn("rank", nth).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
