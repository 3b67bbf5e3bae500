import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>"


def brute(rows, k=32):
    """vec_id, component -> deviation, whitened, explained by a dense eigensolver."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    exact = np.array([[n * a - s for a, s in zip(x, sums)] for _, x in kept], dtype=object)
    y = np.array(exact / n, dtype=float)
    covariance = y.T @ y / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    good = values > 1e-12 * values[0]
    scores = y @ vectors[:, good] / np.sqrt(values[good])
    deviation = [int(sum(e * e for e in row)) for row in exact]
    return n, deviation, scores, values[good] / np.trace(covariance), [i for i, _ in kept]


def check(got, rows):
    n, deviation, scores, explained, ids = brute(rows)
    k = len(explained)
    assert len(got) == len(ids) * k
    by_row = {i: {} for i in ids}
    for r in got:
        by_row[r["vec_id"]][r["component"]] = r
    signs = np.ones(k)
    for c in range(k):
        lead = int(np.argmax(np.abs(scores[:, c])))
        signs[c] = np.sign(scores[lead, c] * by_row[ids[lead]][c + 1]["whitened"])
    for place, i in enumerate(ids):
        assert sorted(by_row[i]) == list(range(1, k + 1))
        for c, r in by_row[i].items():
            assert r["n"] == n and r["deviation"] == deviation[place]
            assert r["whitened"] == pytest.approx(signs[c - 1] * scores[place, c - 1], abs=1e-9)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert r["identity_error"] < 1e-9 and r["residual"] < 1e-11


def test_query_against_dense_solver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, SF).collect(), rows)


def test_nulls_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame(good + bad, KIND).withColumns({"x": F.lit(1), "component": F.lit("c"), "n": F.lit(2)})
    check(whitening.whiten(table).collect(), good)


def test_repeated_rows_count_each(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(15)]
    got = whitening.whiten(spark.createDataFrame(rows + [(None, [9.0, 9.0, 1.0])] * 2, KIND)).collect()
    # the third direction never varies
    assert len(got) == 17 * 2 and sum(r["vec_id"] is None for r in got) == 4
    assert {r["n"] for r in got} == {17}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, KIND)).collect() == []


@pytest.mark.parametrize("size,k", [(40, 6), (200, 32), (7, 32)])
def test_iteration_against_dense_solver(size, k):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size * 3, size)) * 0.95 ** np.arange(size)
    v = a.T @ a / len(a)
    values, vectors, residual = whitening.lobpcg(lambda b: v @ b, size, min(k, size))
    wanted, columns = np.linalg.eigh(v)
    assert residual <= whitening.CERTIFIED
    assert np.allclose(values, wanted[::-1][:k], rtol=1e-12)
    assert np.allclose(np.abs((columns[:, ::-1][:, :k] * vectors).sum(0)), 1, atol=1e-9)


def test_equal_eigenvalues_and_missing_rank():
    values, vectors, _ = whitening.lobpcg(lambda b: np.diag([3.0] * 5 + [1.0] * 15) @ b, 20, 8)
    assert np.allclose(values, [3] * 5 + [1] * 3) and np.allclose(vectors.T @ vectors, np.eye(8))
    values, _, _ = whitening.lobpcg(lambda b: np.ones((20, 20)) @ b, 20, 8)
    assert np.allclose(values, [20] + [0] * 7, atol=1e-12)


def test_parts_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = [(i, [float(i), float(i * i % 7), float(i % 4)]) for i in range(60)]
    check(whitening.whiten(spark.createDataFrame(rows, KIND).repartition(11)).collect(), rows)


def test_deviation_beyond_a_long():
    x = np.array([[1 << 50, 0]])
    assert whitening.deviations(x, np.zeros(2, np.int64), np.zeros(2, np.int64), 10**6)[0] == whitening._MOST
    assert whitening.deviations(np.array([[3, 4]]), np.zeros(2, np.int64), np.array([1, 2]), 10**3)[0] == 2999**2 + 3998**2
