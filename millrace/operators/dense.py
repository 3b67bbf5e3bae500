"""Dense retrieval: embeddings as arrays, exact top-k by matrix products, metadata filters.

Queries and chunks are packed into blocks of at most ``BLOCK`` rows and dealt to a grid: a row of it has a group of
queries, a column a group of chunks, and every pair of blocks in a cell is one matrix product of which at most ``k``
chunks a query leave the task.  A grid of P cells has as many rows as move the least, about the square root of P times
the queries' share, so that neither side is copied to all of P.  Nothing passes the driver, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lexical import PLACES, best_first, rank_within

BLOCK = 2048
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms of zero replaced by a tiny number."""
    norm = lambda v: F.sqrt(dot(v, v))
    safe = lambda n: F.when(n == 0, F.lit(TINY)).otherwise(n)
    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))


def wrong_dimension(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The rows whose vector is absent or not of the dimension; empty if all is well."""
    return vectors.where(F.coalesce(F.size(vector) != dimension, F.lit(True)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms == 0, TINY, norms)[:, None]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, vector) to blocks: the list of ids and the matrix, of vectors of one length."""
    for batch in batches:
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths[lengths > 0]):
            rows = np.nonzero(lengths == dim)[0]
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                matrix = flat[starts[part][:, None] + np.arange(dim)]
                ids = batch.column(0).take(pa.array(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([matrix.tobytes()], pa.binary())],
                    names=["dim", "ids", "matrix"],
                )


def _likeness(q: np.ndarray, c: np.ndarray, distance: str) -> np.ndarray:
    if distance == "cosine":
        return _unit(q) @ _unit(c).T
    # the nearer the better: the negative Euclidean distance
    squares = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * q @ c.T
    return -np.sqrt(np.maximum(squares, 0))


def _tile(k: int, distance: str):
    """The ``k`` best chunks of each tile for every query; ties go to the lesser id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, queries, q, chunks, c = (batch.column(n)[row] for n in ("dim", "q_ids", "q_matrix", "ids", "matrix"))
                q, c = (np.frombuffer(m.as_py(), np.float64).reshape(-1, dim.as_py()) for m in (q, c))
                names = chunks.values
                order = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable")
                score = np.round(_likeness(q, c[order], distance), PLACES)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                asked = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [queries.values.take(pa.array(asked)), names.take(pa.array(order[best.ravel()])), pa.array(np.take_along_axis(score, best, 1).ravel())],
                    names=["query_id", "chunk_id", "score"],
                )

    return run


def grid(cells: int, queries: int, chunks: int) -> tuple[int, int]:
    """Rows and columns of about so many cells: chunks are copied to every row, queries to every column."""
    most = max(1, min(cells, -(-queries // BLOCK)))
    rows = min(most, max(1, round((cells * queries / max(chunks, 1)) ** 0.5)))
    return rows, max(1, -(-cells // rows))


def search(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, not_self: bool = False, distance: str = "cosine") -> DataFrame:
    """The ``k`` nearest chunks of ``vectors`` (chunk_id, embedding) for ``queries`` (query_id, embedding).

    The score is the cosine, or for ``euclid`` the distance with its sign turned.  ``where`` filters before scoring.
    ``not_self`` leaves out the chunk of the query's own id.  Rows without a vector take no part, and vectors of
    different length don't meet.
    """
    if distance not in ("cosine", "euclid"):
        raise ValueError(f"unknown distance {distance!r}")
    pool = vectors if where is None else vectors.where(where)
    kinds = {"id": dict(pool.dtypes)["chunk_id"], "q": dict(queries.dtypes)["query_id"]}

    def blocks(rows: DataFrame, name: str, kind: str) -> DataFrame:
        rows = rows.where(F.col("embedding").isNotNull()).select(name, F.col("embedding").cast("array<double>"))
        return rows.mapInArrow(_packed, f"dim int, ids array<{kind}>, matrix binary")

    rows, columns = grid(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), queries.count(), pool.count())
    number = lambda n: F.pmod(F.xxhash64("matrix"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = blocks(pool, "chunk_id", kinds["id"]).withColumn("column", number(columns)).withColumn("row", every(rows))
    asked = blocks(queries, "query_id", kinds["q"]).withColumn("q_row", number(rows)).withColumn("q_column", every(columns))
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "q_row", "q_column")
    cell = (F.col("row") == F.col("q_row")) & (F.col("column") == F.col("q_column"))
    tiles = dealt.join(asked, cell & (F.col("dim") == F.col("q_dim"))).select("dim", "q_ids", "q_matrix", "ids", "matrix")
    found = tiles.mapInArrow(_tile(k + not_self, distance), f"query_id {kinds['q']}, chunk_id {kinds['id']}, score double")
    if not_self:
        found = found.where(F.col("query_id") != F.col("chunk_id"))
    return rank_within(found, k, *best_first())


def store_filter(conditions: dict, top: tuple[str, ...] = ("doc_id", "chunk_id", "chunk_index", "strategy")) -> Column:
    """A document store's filter: named fields by themselves, other keys at top level or in the metadata."""
    test = F.lit(True)
    for key, value in conditions.items():
        inside = F.coalesce(F.col("metadata")[key] == str(value), F.lit(False))
        test = test & ((F.col(key) == value) if key in top else inside)
    return test


def attribute_filter(conditions: dict, columns: list[str]) -> Column:
    """An in-memory store's filter: the attribute, or the metadata where that is null."""
    test = F.lit(True)
    for key, value in conditions.items():
        inside = F.col("metadata")[key]
        test = test & (F.coalesce(F.col(key).cast("string"), inside) == str(value) if key in columns else inside == str(value))
    return F.coalesce(test, F.lit(False))
