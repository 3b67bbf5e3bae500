"""Chunk borders without a fold, substring joins without nested loops, and approximate neighbours, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays
from millrace.operators import ann, chunking, ordering, qrels, stats


@pytest.mark.parametrize("strategy,size,overlap", [("sentence", 12, 5), ("sentence", 1, 0), ("recursive", 8, 3), ("recursive", 1, 0)])
def test_borders_equal_the_fold(spark, strategy, size, overlap):
    rng = random.Random(5)
    parts = ["a", " ", "\n", "\n\n", ". ", "\t", "é", "😀", " ", "word", "! ", "? ", "।", "x y z w v", "\r\n", "longer words in a row. "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 90)))) for i in range(80)] + [(900, None), (901, ""), (902, " \n"), (903, "w " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    other = lambda text: chunking.count_tokens(text)  # noqa: E731  not the counter that expressions know
    one, two = (sorted(map(tuple, chunking.chunk(docs, strategy, size=size, overlap=overlap, **t).collect())) for t in ({}, {"tokens": other}))
    assert one == two and one


def test_prefix_sums_and_chains(spark):
    rows = [([5, 1, 2],), ([],), ([7],), (list(range(40)),)]
    found = spark.createDataFrame(rows, "a array<int>").select("a", arrays.prefix_sums(F.col("a")).alias("p")).collect()
    assert all(r.p == [0, *np.cumsum(r.a, dtype=int).tolist()] for r in found)
    pointers = [([2, 2, 5, 4, 5, 5],), ([0],), ([1, 1],), ([k + 1 for k in range(99)] + [99],)]
    chains = [r[0] for r in spark.createDataFrame(pointers, "a array<int>").select(arrays.chain(F.col("a"))).collect()]
    assert chains == [[0, 2], [], [0], list(range(99))]


def test_substrings_by_equi_joins(spark):
    rng = random.Random(2)
    outer = [(i, "".join(rng.choice("abc  ") for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(99, None), (98, "")]
    inner = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 7)))) for i in range(80)] + [(99, None), (98, ""), (97, "  "), (96, "zz")]
    frames = [spark.createDataFrame(r, f"{n} int, text string") for r, n in ((inner, "a"), (outer, "b"))]
    found = {tuple(r) for r in qrels.contained_pairs(*frames, "a", "b", blank=True).collect()}
    assert found == {(a, b) for a, x in inner for b, y in outer if x is not None and y is not None and x in y}
    without = {tuple(r) for r in qrels.contained_pairs(*frames, "a", "b").collect()}
    assert without == {(a, b) for a, b in found if dict(inner)[a].strip()}


def test_containment_has_no_nested_loop(spark):
    passages = spark.createDataFrame([(1, "short text"), (2, "one two three four five six seven")], "passage int, snippet string")
    chunks = spark.createDataFrame([("x", "a short text here"), ("y", "zero one two three four five six seven")], "chunk_id string, content string")
    matches = qrels.containment_matches(passages, chunks)
    assert {tuple(r) for r in matches.collect()} == {(1, "x"), (2, "y")}
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_approximate_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 40)
    monkeypatch.setattr(ann, "ASKED", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)) + 3 * rng.standard_normal((12, 16))[rng.integers(0, 12, 1500)]
    rows = [(f"v{i:04d}", v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [("null", None, 0), ("empty", [], 0), ("nan", [float("nan")] * 16, 0), ("short", [1.0, 2.0], 0), ("zero", [0.0] * 16, 0)]
    vectors = spark.createDataFrame(rows + odd, "chunk_id string, embedding array<double>, kind int")
    index = ann.build(vectors, keep=lambda df: df.cache())
    assert index.rows.count() == 1501 and index.probes < len(index.centroids)
    queries = vectors.where("kind = 1 OR chunk_id IN ('null', 'nan', 'short')").select(F.col("chunk_id").alias("query_id"), "embedding")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for where, allowed in ((None, np.ones(1500, bool)), (F.col("kind") == 2, np.arange(1500) % 3 == 2)):
        found = {}
        for r in ann.search(queries, index, 10, where=where, not_self=True).collect():
            found.setdefault(r.query_id, {})[r.chunk_id] = r.score
        hits = total = 0
        for i in range(1, 1500, 3):
            likeness = unit @ unit[i]
            likeness[~allowed] = -9
            likeness[i] = -9
            for j in np.argsort(-likeness)[:10]:
                total += 1
                hits += f"v{j:04d}" in found[f"v{i:04d}"]
            assert all(s == pytest.approx(likeness[int(c[1:])], abs=1e-8) for c, s in found[f"v{i:04d}"].items() if c != "zero")
        assert hits / total >= 0.9 and len(found) == 500
    assert ann.search(queries, ann.build(vectors.limit(0), keep=lambda df: df), 3).collect() == []


def measured(spark, n=900):
    """One metric holds most rows; values tie, some are null."""
    rng = random.Random(8)
    rows = [(f"m{0 if i % 10 else i % 3}", i, None if i % 50 == 0 else rng.choice([0.0, 0.5, -0.5, rng.uniform(-1, 1)])) for i in range(n)]
    return spark.createDataFrame(rows, "metric string, unit int, value double").repartition(5)


def agree(a, b):
    a, b = (sorted((r.asDict() for r in x.collect()), key=lambda r: (str(r["metric"]), r.get("unit", 0))) for x in (a, b))
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k], abs=1e-12) for k in x)


def test_order_statistics_over_range_partitions(spark):
    values = measured(spark)
    agree(stats.summary(values, "metric", large=1), stats.summary(values, "metric"))
    pairs = values.where("value IS NOT NULL").withColumn("difference", F.col("value"))
    agree(stats.wilcoxon_statistic(pairs, "metric", large=1), stats.wilcoxon_statistic(pairs, "metric"))
    agree(stats._ranked(pairs, "metric", large=1), stats._ranked(pairs, "metric"))


def test_corrections_over_range_partitions(spark):
    tests = measured(spark).where("value IS NOT NULL").select("unit", (F.abs("value") / 40).alias("p_value"), "metric")
    for family in ("metric", None):
        for correct in (stats.holm, stats.benjamini_hochberg):
            agree(correct(tests, family=family, order="unit", large=1), correct(tests, family=family, order="unit"))


def test_no_task_holds_a_group(spark):
    values = measured(spark).where("value IS NOT NULL")
    ranked = ordering.running(values, ("metric",), (F.col("value"), F.col("unit")), sums={"nth": F.lit(1)})
    found = sorted((r.metric, r.nth, r.value, r.unit) for r in ranked.collect())
    wanted = sorted((r.metric, r.value, r.unit) for r in values.collect())
    assert [(m, v, u) for m, _, v, u in found] == wanted
    assert [n for m, n, _, _ in found if m == "m0"] == list(range(1, sum(m == "m0" for m, *_ in found) + 1))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
