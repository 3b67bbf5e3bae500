"""Embedding whitening by LOBPCG over distributed covariance-block products.

Entries become integers, ``floor(STEP * c) + SHIFT``, whose counts and sums
are exact.  A row is centred before anything is multiplied: with a mean of
``whole + rest / n`` it is ``(x - whole) - rest / n``, which loses nothing to
the shift.  A product of the covariance with a block of directions is one
pass: every task adds up Y'(YB) over its rows, and the tasks' small matrices
are summed in a tree of fan-in ``FAN``, so that the driver gets ``FAN`` of
them at most.  The covariance itself is never formed.

The driver holds three blocks of at most ``components + EXTRA`` directions:
the iterate, its residuals, and the previous directions.  A step multiplies
what of the latter two is outside the iterate, and Rayleigh-Ritz on all three
gives the next iterate.  A result counts only if residuals of a product
computed afresh are below ``CERTIFIED`` of the largest eigenvalue; steps go on
until they are below ``GOAL``, or no longer fall.

Defined results: vectors that are null, empty, or hold a null or non-finite
entry take no part, nor do those with an entry of 2**52 or more after the
step, which no double holds beside its neighbours.  Vectors of another length than the most
frequent one (of equally frequent ones the shorter) take no part.  Repeated
rows count and return each by itself, a null id stays null, ties don't matter.
Directions without variance have nothing to whiten, so a table of one row, of
equal rows, or an empty one has no components and an empty result; in general
there are as many components as the covariance has rank, ``components`` at
most.  A deviation beyond the range of a long counts as the largest long.  Of
eigenvectors of one eigenvalue any orthonormal choice is right.  Only the id
and the vector are read, so other columns may have any names; texts play no
part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

STEP, SHIFT = 64, 1_000_000
COMPONENTS, EXTRA = 32, 8
FAN = 16
GOAL, CERTIFIED, STEPS = 4e-15, 1e-11, 500
#: Eigenvalues below this share of the largest are rounding errors of a covariance of lower rank.
NOTHING = 1e-13
_LIMIT = 1 << 52
_MOST = np.iinfo(np.int64).max
_PART = "leaf int, data binary"


def entries(vector: Column, step: int = STEP, shift: int = SHIFT) -> Column:
    """The vector as integers; null where it takes no part."""
    scaled = F.transform(vector, lambda c: c.cast("double") * step)
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LIMIT))
    return F.when((F.size(scaled) > 0) & fits, F.transform(scaled, lambda c: F.floor(c) + shift))


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: n vectors of ``sums`` in all, eigenvalues and unit eigenvectors (columns), the covariance's trace, and two measured errors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest of the division."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([s - w * self.n for s, w in zip(self.sums, whole, strict=True)], dtype=np.int64)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _part(data: bytes) -> pa.RecordBatch:
    leaf = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([data], pa.binary())], names=["leaf", "data"])


def _combined(rows: DataFrame, start: Callable, merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """One value over all rows: ``start`` makes one of a task's batches, ``merge`` makes one of two."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = start(_matrix(b.column(0)) for b in batches if b.num_rows)
        if data is not None:
            yield _part(data)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for x in batch.column(1).to_pylist():
                data = x if data is None else merge(data, x)
        if data is not None:
            yield _part(data)

    parts = rows.select("x").mapInArrow(first, _PART)
    width = rows.rdd.getNumPartitions()
    while width > FAN:
        width = -(-width // FAN)
        parts = parts.withColumn("leaf", F.pmod("leaf", F.lit(width))).repartition(width, "leaf").mapInArrow(later, _PART)
    out = None
    for row in parts.collect():  # FAN values of bounded size
        out = bytes(row["data"]) if out is None else merge(out, bytes(row["data"]))
    return out


def _count(matrices: Iterator[np.ndarray]) -> bytes | None:
    n, sums = 0, None
    for x in matrices:
        # halves of 26 bits, so that no partial sum leaves 64 bits
        parts = [int(a) * (1 << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), strict=True)]
        n, sums = n + len(x), parts if sums is None else [a + b for a, b in zip(sums, parts, strict=True)]
    return None if sums is None else json.dumps([n, sums]).encode()


def _add_counts(a: bytes, b: bytes) -> bytes:
    (n, s), (m, t) = json.loads(a), json.loads(b)
    return json.dumps([n + m, [x + y for x, y in zip(s, t, strict=True)]]).encode()


def _add(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a) + np.frombuffer(b)).tobytes()


def _moments(block: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = block.mean(0)
    return float(len(block)), mean, (block - mean).T @ (block - mean)


def _pooled(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets as those of both."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _packed(m: tuple) -> bytes:
    return np.concatenate([[m[0]], m[1], m[2].ravel()]).tobytes()


def _unpacked(data: bytes) -> tuple:
    flat = np.frombuffer(data)
    k = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
    return flat[0], flat[1 : 1 + k], flat[1 + k :].reshape(k, k)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole) - rest / n


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum of (n * x - S)**2, exact within a long, else the largest long."""
    off = x - whole
    most = (float(np.abs(off).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 2.0**62:
        return np.square(n * off - rest).sum(1)
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in off.tolist()]
    return np.array([min(v, _MOST) for v in exact], dtype=np.int64)


def _orthonormal(block: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """A basis of what the columns of ``block`` span outside the orthonormal columns of ``outside``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - outside @ (outside.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(size.max(initial=0), 1e-300)] if size.max(initial=0) > 1e-10 else block[:, :0]
    return block


def _ritz(basis: np.ndarray, image: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` largest Ritz values of a basis and the columns that make their vectors."""
    inner = basis.T @ image
    values, columns = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1][:m], columns[:, ::-1][:, :m]


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues, their unit vectors and the largest residual (as a share of the first value) of a symmetric operator."""
    m = min(size, k + EXTRA)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, m)))[0]
    image, previous = multiply(x), np.zeros((size, 0))
    best, waited, fresh = None, 0, True
    for _ in range(STEPS):
        values, turn = _ritz(x, image, m)
        x, image = x @ turn, image @ turn
        residuals = image - x * values
        worst = np.linalg.norm(residuals[:, :k], axis=0).max() / max(values[0], np.finfo(float).tiny)
        if worst <= CERTIFIED and not fresh:
            # what follows counts only for a product of its own
            x = np.linalg.qr(x)[0]
            image, fresh = multiply(x), True
            continue
        if fresh and worst <= CERTIFIED:
            waited = waited + 1 if best and worst > best[2] / 2 else 0
            best = min(best or (values, x, worst), (values, x, worst), key=lambda b: b[2])
            if worst <= GOAL or waited >= 2:
                break
        more = _orthonormal(np.hstack([residuals, previous]), x)
        if not more.shape[1]:
            if fresh:
                best = best or (values, x, worst)
                break
            image, fresh = multiply(x), True
            continue
        basis, images = np.hstack([x, more]), np.hstack([image, multiply(more)])
        values, columns = _ritz(basis, images, m)
        x, image, previous, fresh = basis @ columns, images @ columns, more @ columns[x.shape[1] :], False
    if best is None or best[2] > CERTIFIED:
        raise ArithmeticError(f"no certified eigenvectors after {STEPS} steps")
    return best[0][:k], best[1][:, :k], float(best[2])


def rows_of(vectors: DataFrame, vec_id: str, vector: str, step: int = STEP, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the vectors that take part, whatever their length."""
    return vectors.select(F.col(vec_id).alias("vec_id"), entries(F.col(vector), step, shift).alias("x")).where("x IS NOT NULL")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of ``rows`` (x), a written table of one length; None without a direction that varies."""
    counted = _combined(rows, _count, _add_counts)
    if counted is None:
        return None
    n, sums = json.loads(counted)
    blank = Whitening(n, tuple(sums), np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0, 0.0)
    whole, rest = blank.centre

    def multiply(block: np.ndarray) -> np.ndarray:
        def start(matrices: Iterator[np.ndarray]) -> bytes | None:
            total = None
            for x in matrices:
                y = _centred(x, whole, rest, n)
                part = y.T @ (y @ block)
                total = part if total is None else total + part
            return None if total is None else total.tobytes()

        return np.frombuffer(_combined(rows, start, _add)).reshape(block.shape) / n

    def spread(matrices: Iterator[np.ndarray]) -> bytes | None:
        squares = [np.square(_centred(x, whole, rest, n)).sum() for x in matrices]
        return np.array([sum(squares)]).tobytes() if squares else None

    trace = float(np.frombuffer(_combined(rows, spread, _add))[0]) / n
    if trace <= 0:
        return None
    values, found, residual = lobpcg(multiply, len(sums), min(components, len(sums)))
    keep = values > NOTHING * values[0]
    values, found = values[keep], found[:, keep]

    def whitened(matrices: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in matrices:
            part = _moments(_centred(x, whole, rest, n) @ (found / np.sqrt(values)))
            total = part if total is None else _pooled(total, part)
        return None if total is None else _packed(total)

    _, _, scatter = _unpacked(_combined(rows, whitened, lambda a, b: _packed(_pooled(_unpacked(a), _unpacked(b)))))
    error = float(np.abs(scatter / n - np.eye(len(values))).max())
    return Whitening(n, tuple(sums), values, found, trace, residual, error)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (vec_id, x) to one row for each component: vec_id, component, n, deviation, whitened, explained, identity_error, residual."""
    whole, rest = model.centre
    scaled, k = model.vectors / np.sqrt(model.values), len(model.values)
    shares = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, x = batch.column(0).slice(at, 2048), _matrix(batch.column(1).slice(at, 2048))
                m = len(x)
                columns = [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(deviations(x, whole, rest, model.n), k)),
                    pa.array((_centred(x, whole, rest, model.n) @ scaled).ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                    pa.array(np.full(m * k, model.residual)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return rows.select("vec_id", "x").mapInArrow(run, _schema(rows))


_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["vec_id"].dataType.simpleString()
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whiten a table by a fit on all of it."""
    rows = materialize(rows_of(vectors, vec_id, vector), "whitening-rows")
    # one row, the commonest length
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    same = rows.where(F.size("x") == (length["d"] if length else 0))
    model = fit(same, components)
    return apply(same, model) if model else rows.sparkSession.createDataFrame([], _schema(rows))
