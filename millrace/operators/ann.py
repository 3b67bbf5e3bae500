"""Approximate nearest neighbours by cosine: inverted lists around centroids, with residual codes.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors of least id hash) on the driver; every vector is indexed.
A row of the index holds its list, a part of that list, and its residual as one byte a component.  How many lists a
query probes is read off the sample as well: as many as hold ``target`` of its vectors' true neighbours.  A search
deals queries and parts of lists to groups of bounded size, scores codes there, and scores the best
``REFINE * k`` again by the vectors themselves.

Vectors that are null, empty, of another length than the sample's most frequent one, or hold a null or non-finite
component aren't indexed, and such queries find nothing.  Ties go to the lesser chunk_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dense import TINY, cosine
from millrace.operators.lexical import PLACES, best_first, rank_within

SAMPLE, ROUNDS = 20_000, 10
MOST_LISTS, TRIED = 4096, 500
#: Vectors of a part of a list, and queries of a group.
PART, ASKED = 8192, 2048
REFINE = 8


@dataclass(frozen=True)
class Lists:
    """The index: centroids, how many lists a query probes, and rows (list, part, chunk_id, scale, code and the vectors' other columns)."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame
    vectors: DataFrame


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1), TINY)[:, None]


def usable(vector: Column) -> Column:
    """The vector as doubles, or null."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.when((F.size(doubles) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), doubles)


def centroids_of(units: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from evenly spaced members; an empty cluster keeps its centroid."""
    out = units[np.linspace(0, len(units) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        mine = (units @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, mine, units)
        full = np.linalg.norm(sums, axis=1) > TINY
        out[full] = _unit(sums[full])
    return out


def probes_for(units: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """How many of a query's nearest lists hold ``target`` of the ``k`` true neighbours among the sample, for ``TRIED`` queries of it."""
    asked = np.linspace(0, len(units) - 1, min(TRIED, len(units))).astype(int)
    likeness = units[asked] @ units.T
    likeness[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-likeness, axis=1)[:, : min(k, len(units) - 1)]
    order = np.argsort(-(units[asked] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
    ranks = np.take_along_axis(place, (units @ centroids.T).argmax(1)[near], 1)
    return int(np.quantile(ranks, target, method="higher")) + 1 if ranks.size else len(centroids)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose lists have ``dim`` components, and these as unit vectors."""
    rows = np.nonzero(np.diff(column.offsets.to_numpy()) == dim)[0]
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return rows, _unit(flat.reshape(len(rows), dim))


def _coded(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _matrix(batch.column(1), centroids.shape[1])
            mine = (units @ centroids.T).argmax(1)
            rest = units - centroids[mine]
            scale = np.maximum(np.abs(rest).max(1, initial=0), TINY) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(mine.astype(np.int32)), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "list", "scale", "code"])

    return run


def build(vectors: DataFrame, keep: Callable[[DataFrame], DataFrame], lists: int | None = None, k: int = 10, target: float = 0.95) -> Lists:
    """Index ``vectors`` (chunk_id, embedding and any columns to filter by); ``keep`` stores the index rows."""
    rows = vectors.withColumn("embedding", usable(F.col("embedding"))).where("embedding IS NOT NULL")
    sample = [r["embedding"] for r in rows.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").collect()]
    dim = Counter(map(len, sample)).most_common(1)[0][0] if sample else 1
    units = _unit(np.array([v for v in sample if len(v) == dim], dtype=np.float64).reshape(-1, dim))
    n = lists or max(1, min(MOST_LISTS, int(2 * len(units) ** 0.5)))
    centroids = centroids_of(units, min(n, len(units))) if len(units) else np.zeros((1, dim))
    kind = dict(vectors.dtypes)["chunk_id"]
    coded = rows.select("chunk_id", "embedding").mapInArrow(_coded(centroids), f"chunk_id {kind}, list int, scale double, code binary")
    coded = keep(coded)
    # a row a list
    parts = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    dealt = coded.join(F.broadcast(parts), "list").withColumn("part", part).drop("parts")
    return Lists(centroids, min(probes_for(units, centroids, k, target), len(centroids)) if len(units) else 1, dealt, rows)


def _probing(centroids: np.ndarray, probes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _matrix(batch.column(1), centroids.shape[1])
            order = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            at = np.repeat(np.arange(len(rows)), order.shape[1])
            vectors = pa.array([u.tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), vectors.take(pa.array(at)), pa.array(order.ravel())], names=["query_id", "q", "list"])

    return run


def _scoring(centroids: np.ndarray, k: int) -> Callable:
    dim = centroids.shape[1]

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        """The ``k`` best codes of one part of a list for a group of queries."""
        queries = np.frombuffer(b"".join(asked["q"].to_pylist()), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(-1, dim) if held.num_rows else np.zeros((0, dim), np.int8)
        if not len(queries) or not len(codes):
            return asked.slice(0, 0).select(["query_id"]).append_column("chunk_id", held["chunk_id"].slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        likeness = queries @ centroids[key[0].as_py()][:, None] + (queries @ codes.T) * held["scale"].to_numpy()
        best = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(queries)), best.shape[1])
        return pa.table(
            {
                "query_id": asked["query_id"].take(pa.array(at)),
                "chunk_id": held["chunk_id"].take(pa.array(best.ravel())),
                "score": pa.array(np.take_along_axis(likeness, best, 1).ravel()),
            }
        )

    return run


def search(queries: DataFrame, index: Lists, k: int, where: Column | None = None, not_self: bool = False, probes: int | None = None, refine: int = REFINE) -> DataFrame:
    """About the ``k`` nearest chunks of each query (query_id, embedding); scores are exact.

    ``where`` filters by the vectors' columns before anything is scored.
    """
    held = index.rows
    if where is not None:
        held = held.join(index.vectors.where(where).select("chunk_id"), "chunk_id", "left_semi")
    kinds = {"q": dict(queries.dtypes)["query_id"], "c": dict(held.dtypes)["chunk_id"]}
    exact = queries.select("query_id", usable(F.col("embedding")).alias("asked")).where("asked IS NOT NULL")
    routed = exact.mapInArrow(_probing(index.centroids, min(probes or index.probes, len(index.centroids))), f"query_id {kinds['q']}, q binary, list int")
    # a row a list, at most MOST_LISTS
    groups = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("groups"))
    parts = index.rows.groupBy("list").agg((F.max("part") + 1).alias("parts"))
    sizes = F.broadcast(groups.join(parts, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = routed.join(sizes, "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("part", every("parts"))
    offered = held.join(sizes, "list").withColumn("group", every("groups"))
    keys = ["list", "part", "group"]
    tiles = asked.select(*keys, "query_id", "q").groupBy(*keys).cogroup(offered.select(*keys, "chunk_id", "scale", "code").groupBy(*keys))
    found = tiles.applyInArrow(_scoring(index.centroids, refine * k + not_self), f"query_id {kinds['q']}, chunk_id {kinds['c']}, score double")
    if not_self:
        found = found.where(F.col("query_id") != F.col("chunk_id"))
    near = rank_within(found, refine * k, *best_first()).select("query_id", "chunk_id")
    whole = near.join(index.vectors.select("chunk_id", "embedding"), "chunk_id").join(exact, "query_id")
    scored = whole.select("query_id", "chunk_id", F.round(cosine(F.col("asked"), F.col("embedding")), PLACES).alias("score"))
    return rank_within(scored, k, *best_first())


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, the (query_id, chunk_id) pairs of ``truth``, and recall, the share of them in ``found``."""
    hits = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
