"""Sweeps that share a table of runs."""

import threading
import time

from pyspark.sql import functions as F

from millrace.operators import relational
from millrace.plans import config, runner
from millrace.plans.runs import RunTable
from millrace.storage import create_once


def test_a_file_is_made_once(spark, tmp_path):
    wins = []
    race = [threading.Thread(target=lambda k=k: wins.append(k) if create_once(spark, f"file://{tmp_path}/one/x.json", str(k).encode()) else None) for k in range(12)]
    [t.start() for t in race], [t.join() for t in race]
    assert len(wins) == 1 and (tmp_path / "one/x.json").read_text() == str(wins[0])
    assert [p.name for p in (tmp_path / "one").iterdir() if "ready" in p.name] == []


def test_claims_and_states(spark, tmp_path):
    runs = RunTable(spark, f"file://{tmp_path}/runs", patience=1000)
    assert runs.latest("a").status == "NONE" and runs.claim("a") == 1
    assert runs.claim("a") is None and runs.latest("a").status == "RUNNING"
    assert runs.finish("a", 1, "FAILED", error="no") and not runs.finish("a", 1, "COMPLETED")
    # a failed run may be tried again, a completed one only on purpose
    assert runs.claim("a") == 2 and runs.finish("a", 2, "COMPLETED", {"mrr@5": 0.5}, queries=3, completed=3)
    assert runs.claim("a") is None and runs.claim("a", again=True) == 3
    hasty = RunTable(spark, f"file://{tmp_path}/runs", patience=0)
    time.sleep(0.01)
    assert hasty.claim("a") == 4 and not runs.finish("a", 3, "COMPLETED")
    assert runs.claim("b") == 1 and runs.finish("b", 1, "COMPLETED", {"mrr@5": 1.0})
    rows = {(r.cache_hash, r.attempt): r for r in runs.table().collect()}
    assert {k: r.status for k, r in rows.items()} == {("a", 1): "FAILED", ("a", 2): "COMPLETED", ("a", 3): "FAILED", ("a", 4): "RUNNING", ("b", 1): "COMPLETED"}
    assert rows["a", 2].means == {"mrr@5": 0.5} and rows["a", 3].error == "given up" and rows["a", 4].completed_at is None
    assert {r.cache_hash: r.attempt for r in relational.cached_runs(runs.table()).collect()} == {"a": 2, "b": 1}
    plan = spark.createDataFrame([("a",), ("c",)], "cache_hash string")
    assert {r.cache_hash: r.cache_status for r in relational.plan_status(plan, runs.table()).collect()} == {"a": "HIT", "c": "MISS"}


def test_two_sweeps_at_once_run_no_point_twice(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Whales live in the sea."), ("d2", "Cars drive on roads."), ("d3", "Bread is baked from flour.")], "doc_id string, content string")
    queries = spark.createDataFrame([("q1", "where do whales live")], "query_id string, query string")
    passages = spark.createDataFrame([("p1", "q1", "d1", "live in the sea", None, None)], "passage string, query_id string, doc_id string, snippet string, start_char int, end_char int")
    parts = {"chunking": {"strategy": "sentence", "chunk_size": 20, "chunk_overlap": 0}, "embedding": {"provider": "mock"}, "retrieval": {"mode": ["bm25", "dense"], "top_k": [1, 2]}, "evaluation": {"k_values": [1], "metrics": ["recall"]}}
    plan = config.Experiment("e", "set", components=parts)
    runs, ran, found = RunTable(spark, f"file://{tmp_path}/runs"), [], {}

    def sweep(name, **options):
        found[name] = runner.run_matrix(spark, plan, runner.Corpus(docs, "v1"), queries, passages, runs=runs, concurrent=2, save=lambda key, stages: ran.append(key), **options)

    both = [threading.Thread(target=sweep, args=(n,)) for n in ("one", "two")]
    [t.start() for t in both], [t.join() for t in both]
    assert len(ran) == len(set(ran)) == 4
    for results in found.values():
        assert [r.index for r in results] == [0, 1, 2, 3] and {r.status for r in results} == {"COMPLETED"} and [r.means["recall@1"] for r in results] == [1.0] * 4
    assert sum(not r.cached for results in found.values() for r in results) == 4
    sweep("again")
    assert all(r.cached for r in found["again"]) and len(ran) == 4
    single = config.Experiment("e", "set", components={**parts, "retrieval": {"mode": "bm25", "top_k": 1}})
    made = runner.run_matrix(spark, single, runner.Corpus(docs, "v1"), queries, passages, runs=runs, bypass_cache=True, save=lambda key, stages: ran.append(key))
    assert len(ran) == 5 and not made[0].cached
    assert runs.table().where(F.col("cache_hash") == made[0].cache_hash).count() == 2
