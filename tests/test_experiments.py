import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, context, metrics, relational, stats, transforms
from millrace.plans import config, runner, sweep
from millrace.sources import dataset, export, readers, report, store
from millrace.streaming import metric_stream


def test_fixed_windows_follow_the_loop(spark):
    texts = ["", "   ", "a" * 7, "ab cd ef gh ij kl", "x" * 10 + " " * 10 + "y" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    for size, overlap in ((5, 2), (10, 0), (7, 6)):
        expected = []
        for i, t in enumerate(texts):
            n, at = 0, 0
            while t.strip():
                if t[at : at + size].strip():
                    expected.append((i, n, t[at : at + size].strip(), at))
                    n += 1
                if at + size >= len(t):
                    break
                at += size - overlap
        rows = chunking.fixed_windows(docs, size, overlap).orderBy("doc_id", "chunk_index").collect()
        assert [(r.doc_id, r.chunk_index, r.content, r.start_char) for r in rows] == expected
    with pytest.raises(ValueError):
        chunking.fixed_windows(docs, 5, 5)


def test_merging_chunkers():
    text = "One two three. Four five six. Seven eight nine. Ten.\n\nEleven twelve."
    for size in (5, 8, 100):
        for made in (chunking.recursive(text, size, 2), chunking.by_sentence(text, size, 4)):
            words = {w.strip(".") for c in made for w in c.split()}
            assert words == {w.strip(".") for w in text.split()}
        assert all(chunking.count_tokens(c) <= size for c in chunking.recursive(text, size, 2))
    assert chunking.by_sentence("word " * 30 + ".", 5, 0) == ["word " * 30 + "."]
    apart = chunking.semantic("aaa bbb aaa. aaa bbb aaa. zzz yyy xxx.", threshold=0.5, least=1)
    assert apart == ["aaa bbb aaa. aaa bbb aaa.", "zzz yyy xxx."]


def test_chunks_have_ids_and_places(spark):
    docs = spark.createDataFrame([("d", "One two. Three four."), ("e", None)], "doc_id string, content string")
    made = chunking.with_ids(chunking.chunk(docs, "sentence", size=3, overlap=0)).orderBy("chunk_index").collect()
    assert [(r.content, r.start_char, r.end_char) for r in made] == [("One two.", 0, 8), ("Three four.", 9, 20)]
    assert len({r.chunk_id for r in made}) == 2


def pairs(spark, values):
    return spark.createDataFrame([("m", i, 0.0, float(v), float(v)) for i, v in enumerate(values)], "metric string, unit int, a double, b double, difference double")


@pytest.mark.parametrize(("values", "t", "dz"), [([0, 0, 0], 0.0, 0.0), ([1, 1, 1], math.inf, math.inf), ([-1, -1], -math.inf, -math.inf), ([5], None, None)])
def test_degenerate_pairs(spark, values, t, dz):
    row = stats.paired_statistics(pairs(spark, values), "metric").first()
    assert (row.t_statistic, row.cohens_dz) == (t, dz)


def test_corrections(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20)], "metric string, p_value double")
    assert [r.p_holm for r in stats.holm(rows).orderBy("metric").collect()] == pytest.approx([0.04, 0.09, 0.09, 0.20])
    assert [r.p_bh for r in stats.benjamini_hochberg(rows).orderBy("metric").collect()] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])
    marks = spark.createDataFrame([(0.0001,), (0.005,), (0.02,), (0.5,), (None,), (math.nan,)], "p double").select(stats.stars(F.col("p")).alias("s"))
    assert [r.s for r in marks.collect()] == ["***", "**", "*", "ns", "ns", "ns"]


def test_comparison_and_transfer(spark):
    mono = spark.createDataFrame([("recall@5", u, v) for u, v in (("a", 0.9), ("b", 0.85), ("c", 0.8))], "metric string, unit string, value double")
    cross = spark.createDataFrame([("recall@5", u, v) for u, v in (("a", 0.7), ("b", 0.65), ("c", 0.6))], "metric string, unit string, value double")
    row = stats.transfer(mono, cross).first()
    assert (row.mean_penalty, row.n, row.cohens_dz) == (0.2, 3, None)
    report = stats.compare(mono, cross, unit="unit").first()
    assert report.mean_difference == pytest.approx(-0.2) and report.adjustment == "holm"
    with pytest.raises(ValueError):
        stats.align({"k": 5}, {"k": 10}, mono, cross, unit="unit")
    with pytest.raises(ValueError):
        stats.align({}, {}, mono, cross.where("unit <> 'a'"), unit="unit")
    both = stats.align({}, {}, mono, cross.where("unit <> 'a'"), partial=True, unit="unit")
    assert both["common"].count() == 2 and both["only_a"].first().unit == "a"


def test_summary_of_one_value(spark):
    row = stats.summary(spark.createDataFrame([("m", 2.0), ("m", None)], "metric string, value double"), "metric").first()
    assert (row.stddev, row["count"], row["median"]) == (0.0, 1, 2.0)


def test_sweep_order_and_invalid_points():
    grid = {"chunking": {"chunk_size": [100, 400], "chunk_overlap": 20}, "retrieval": {"mode": ["dense", "sparse"], "top_k": [5, 10]}}
    points = sweep.expand(grid)
    assert [(p.chunking.chunk_size, p.retrieval.mode, p.retrieval.top_k) for p in points[:4]] == [(100, "dense", 5), (100, "dense", 10), (100, "bm25", 5), (100, "bm25", 10)]
    assert len({p.hash() for p in points}) == 8
    bad = {"chunking": {"chunk_size": [100, 400], "chunk_overlap": 200}}
    with pytest.raises(ValueError):
        sweep.expand(bad)
    assert [p.chunking.chunk_size for p in sweep.expand(bad, skip_invalid=True)] == [400]
    with pytest.raises(ValueError):
        sweep.expand({"chunking": {"strategies": ["fixed"]}})
    assert sweep.difference(points[0], points[3]) == {"retrieval.mode": "bm25", "retrieval.top_k": 10}
    assert sweep.preview({"a": list(range(7)), "b": list(range(7))})["size"] == "HEAVY"


def test_experiment_files(tmp_path):
    text = sweep.to_yaml("n", "d", "1", {"retrieval": {"top_k": [5, 10]}})
    path = tmp_path / "e.yaml"
    path.write_text(text)
    loaded = config.load(str(path))
    assert (loaded.dataset_id, len(sweep.expand(loaded.components))) == ("d", 2)
    whole = {"dataset_id": "d", "dataset_version_id": "1"}
    for broken in ({"name": "x"}, {"dataset": "x"}, {"dataset": whole, "odd": 1}, {"dataset": {"dataset_id": "d"}}, {"dataset": whole | {"dataset_id": ""}}):
        with pytest.raises(ValueError):
            config.experiment(broken)
    full = config.experiment({"author": "a", "tags": ["t"], "dataset": whole | {"corpus_path": "c"}, "chunking": {"strategy": "semantic", "similarity_threshold": [0.7, 0.9]}})
    assert (full.author, full.tags, full.name, full.corpus_path) == ("a", ("t",), "experiment", "c")
    assert [p.chunking.similarity_threshold for p in sweep.expand(full.components)] == [0.7, 0.9]
    assert config.Pipeline().chunking.chunk_overlap == 64 and config.make("evaluation", {"k_values": [5, 1, 5], "metrics": ["MRR "]}).k_values == (1, 5)
    with pytest.raises(ValueError):
        sweep.expand({"chunking": {"similarity_threshold": 1.5}})


def experiment_tables(spark):
    docs = spark.createDataFrame([("d1", "Whales are large mammals. They live in the sea."), ("d2", "Cars have engines. They drive on roads.")], "doc_id string, content string")
    queries = spark.createDataFrame([("q1", "where do whales live"), ("q2", "what drives on roads"), ("q3", "")], "query_id string, query string")
    passages = spark.createDataFrame([("p1", "q1", "d1", "They live in the sea", None, None)], "passage string, query_id string, doc_id string, snippet string, start_char int, end_char int")
    return docs, queries, passages


def test_a_failed_query_leaves_the_others(spark):
    docs, queries, passages = experiment_tables(spark)
    parts = {"chunking": {"strategy": "sentence", "chunk_size": 20, "chunk_overlap": 0}, "embedding": {"provider": "mock"}, "retrieval": {"mode": "bm25", "top_k": 3}, "evaluation": {"k_values": [2]}}
    plan = config.Experiment("e", "set", components=parts)
    silent = lambda prompt: F.when(prompt.contains("what drives"), F.lit(None).cast("string")).otherwise("They live in the sea [Source 1].")
    seen = {}
    [result] = runner.run_matrix(spark, plan, runner.Corpus(docs), queries, passages, model=silent, save=lambda key, stages: seen.update(stages))
    assert (result.status, result.queries, result.completed, result.failed) == ("PARTIAL", 3, 2, 1) and "1 of 3" in result.error
    runs = {r.query_id: (r.status, r.error) for r in seen["query_runs"].collect()}
    assert runs["q2"] == ("FAILED", "the model gave no answer") and runs["q1"][0] == runs["q3"][0] == "SUCCESS"
    rows = {(r.query_id, r.metric): r.value for r in seen["metrics"].collect()}
    assert not any(q == "q2" for q, _ in rows) and rows["q1", "faithfulness"] == 1.0 and 0 <= rows["q1", "answer_relevance"] <= 1
    assert rows["q1", "total_latency_ms"] >= rows["q1", "retrieval_latency_ms"] > 0 and ("q1", "reranking_latency_ms") not in rows
    assert runner.run_matrix(spark, plan, runner.Corpus(docs), queries, passages, model=lambda p: F.lit(None).cast("string"))[0].status == "FAILED"


def test_a_context_over_its_budget_is_an_error(spark):
    packed = spark.createDataFrame([("a", "x", 5), ("b", "y", 6)], "query_id string, text string, total_tokens int")
    assert [r.e for r in packed.select(context.over_budget(F.col("total_tokens"), 5).alias("e")).collect()] == [None, "context budget exceeded: 6 > 5"]
    assert context.guard(packed, 6).count() == 2
    with pytest.raises(Exception, match="budget exceeded"):
        context.guard(packed, 5).collect()


def test_extension_points(spark, tmp_path):
    docs, queries, passages = experiment_tables(spark)
    metrics.register_judge("never")(lambda: lambda c, p: F.lit(False))
    answers = spark.createDataFrame([("q", "Whales live in the sea.", "whales live in the sea")], "query_id string, answer string, context string")
    scores = lambda judged: metrics.faithfulness(answers, judged=judged).first().faithfulness
    assert (scores(None), scores(metrics.judge("never")), scores(metrics.judge("llm", model=lambda p: F.lit(" yes, it does")))) == (1.0, 0.0, 1.0)
    chunking.register("halves")(lambda text, tokens, **_: [text[: len(text) // 2], text[len(text) // 2 :]])
    assert chunking.chunk(docs, "halves").count() == 4
    transforms.register("twice")(lambda query, response, n, keep: F.array(query, query))
    assert transforms.sub_queries(queries, "twice").count() == 6
    runner.register_retriever("first")(lambda corpus, point: lambda q, k: q.select("query_id").join(corpus.chunks(point).select("chunk_id").limit(1), how="cross").withColumns({"score": F.lit(1.0), "rank": F.lit(1)}))
    point = sweep.expand({"chunking": {"strategy": "halves"}, "retrieval": {"mode": "first"}})[0]
    assert runner.searcher(runner.Corpus(docs), point)(queries, 1).count() == 3
    readers.register_parser("table", "csv")(lambda files: files.select("filename", "file_type", F.col("text").alias("content"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata")))
    (tmp_path / "x.csv").write_text("a,b")
    assert [(r.content, r.file_type, r.place) for r in readers.documents(spark, f"file://{tmp_path}", glob="*.csv").collect()] == [("a,b", "table", 0)]
    store.register_store("other")(store.VectorStore)
    assert not store.open_store("other", spark, f"file://{tmp_path}", "none").exists()
    for wrong in (lambda: metrics.judge("x"), lambda: store.open_store("x", spark, "", ""), lambda: transforms.sub_queries(queries, "x")):
        with pytest.raises(ValueError):
            wrong()


def test_dataset_registration(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.txt").write_text("Whales are large mammals. They live in the sea.")
    (tmp_path / "c" / "a.txt").write_text("Cars have engines. They drive on roads.")
    line = '{"query_id": "q%d", "query": "?", "ground_truth_passages": [{"doc_id": "%s", "text_snippet": "%s"}]}'
    (tmp_path / "qa.jsonl").write_text("\n".join([line % (1, "b", "They live in the sea"), line % (2, "a.txt", "They drive on roads")]))
    made = dataset.register(spark, f"file://{tmp_path}/w", "set", 1, f"file://{tmp_path}/c", f"file://{tmp_path}/qa.jsonl", size=60, overlap=0)
    assert made.totals.first().document_count == 2 and made.queries.count() == 2
    chunks = {r.chunk_id: r.content for r in made.chunks.collect()}
    found = {(r.query_id, chunks[r.chunk_id]) for r in made.relevant.collect()}
    assert {q for q, _ in found} == {"q1", "q2"} and all(("sea" in c or "live" in c or "They" in c) if q == "q1" else ("drive" in c or "road" in c or "They" in c) for q, c in found)
    import hashlib

    assert made.content_hash == hashlib.sha256(b"Cars have engines. They drive on roads.Whales are large mammals. They live in the sea.").hexdigest()
    (tmp_path / "bad.jsonl").write_text(line % (1, "zzz", "x"))
    with pytest.raises(ValueError, match="unknown documents"):
        dataset.register(spark, f"file://{tmp_path}/w", "set", 2, f"file://{tmp_path}/c", f"file://{tmp_path}/bad.jsonl", size=60, overlap=0)


def test_pareto(spark):
    rows = [(1, 0.9, 10), (2, 0.8, 5), (3, 0.7, 7), (4, 0.9, 10), (5, 0.95, 20), (6, 0.5, 5)]
    points = spark.createDataFrame(rows, "id int, recall double, latency int")
    assert {r.id for r in relational.pareto(points).collect()} == {1, 2, 4, 5}


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\n# Head\nbody\n```\ncode\n```\n")
    (tmp_path / "b.txt").write_bytes("caf\xe9\r\nx\x01".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = {r.filename: r for r in readers.documents(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.md", "b.txt"}
    assert rows["b.txt"].content == "café\nx" and rows["a.md"].metadata == {"title": "T"}
    assert readers.parse_markdown("---\na: 1\n---\n# H\n```\nx\n```")[2:] == ([(1, "H", 0)], 1)
    (tmp_path / "qa.jsonl").write_text('{"id": "x", "question": "why?", "passages": ["snip", {"doc_id": "d", "text_snippet": "s", "start_char": 1, "end_char": 2}]}\n\n{"query": "q2", "query_text": ""}\n')
    found = readers.questions(spark, f"file://{tmp_path}/qa.jsonl")
    assert [(r.query_id, r["query"]) for r in found.collect()] == [("x", "why?"), ("q_3", "q2")]
    assert [(r.doc_id, r.snippet, r.start_char) for r in readers.passages(found).collect()] == [("", "snip", None), ("d", "s", 1)]


def test_vector_store(spark, tmp_path):
    kept = store.VectorStore(spark, f"file://{tmp_path}", "c")
    assert not kept.exists() and kept.count() == 0
    schema = "chunk_id string, embedding array<double>, doc_id string, metadata map<string,string>"
    kept.upsert(spark.createDataFrame([("a", [1.0, 0.0], "d", {"lang": "en"}), ("b", [0.0, 1.0], "d", {"lang": "fr"})], schema))
    kept.upsert(spark.createDataFrame([("a", [0.0, 1.0], "d", {"lang": "en"})], schema))
    kept.rewrite()
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<double>")
    assert kept.count() == 2
    assert [r.chunk_id for r in kept.search(asked, 5).orderBy("rank").collect()] == ["a", "b"]
    assert [r.chunk_id for r in kept.search(asked, 5, {"lang": "fr"}).collect()] == ["b"]
    kept.delete()
    assert not kept.exists()


def test_exports(spark, tmp_path):
    assert export.latex_escape("a_b\\") == "a\\_b\\textbackslash\\{\\}"
    mono = spark.createDataFrame([("m", i, float(i % 3)) for i in range(6)], "metric string, query_id int, value double")
    other = mono.withColumn("value", F.col("value") * 2)
    report = stats.compare(mono, other)
    sums = export.bundle(str(tmp_path), report, stats.paired(mono, other), {"title": "T"}, [])
    assert "statistical_summary.csv" in sums and len((tmp_path / "raw_paired_observations.csv").read_text().splitlines()) == 7
    assert (tmp_path / "statistical_summary.csv").read_text().startswith("metric,mean_run_a")


def result_file():
    hypotheses = {h: {"statement": f"About {h}.", "mean_penalty": 0.1 * i, "cohens_dz": 0.5, "primary_decision": "SUPPORTED" if i != 1 else "NO", "wilcoxon_signed_rank": {"adj_p_holm": 0.0004 + 0.01 * i}} for i, h in enumerate(report.HYPOTHESES)}
    cells = lambda penalty: {"recall@5": {"mean_mono": 0.9, "mean_cross": 0.9 - penalty, "mean_penalty": penalty, "ci_95": [0.0, 0.3], "significance_stars": "**", "n_units": 25}}
    return {"metadata": {"study": "A_study", "embedding_configuration": {"model_identifier": "m", "embedding_dimension": 8}}, "hypotheses": hypotheses, "all_comparisons": {"dense_EN_to_BN": cells(0.2), "hybrid_EN_to_BN": cells(0.05)}}


def test_reports(tmp_path):
    import json

    data = result_file()
    (tmp_path / "r.json").write_text(json.dumps(data))
    found = report.read(str(tmp_path / "missing.json"), str(tmp_path / "r.json"))
    assert (found.units, found.model, len(found.comparisons)) == (25, "m", 2)
    assert [f.verdict() for f in found.findings] == ["SUPPORTED, p < 0.001", "NOT SUPPORTED (Gain)", "SUPPORTED, p = 0.020", "SUPPORTED, p = 0.030"]
    files = report.write(found, str(tmp_path / "out"))
    tex, body = (tmp_path / "out" / "comparisons.tex").read_text(), (tmp_path / "out" / "report.md").read_text()
    assert len(files) == 3 and "A\\_study (25 matched units)" in tex and "0.2000$^{**}$" in tex and tex.count("\\midrule") == 2
    assert "least for hybrid_EN_to_BN (0.0500) and greatest for dense_EN_to_BN (0.2000)" in body and "| H2 |" in body
    broken = [{}, [], {**data, "hypotheses": {}}, {**data, "all_comparisons": {"x": {"m": {"mean_mono": "no"}}}}]
    broken += [{**data, "all_comparisons": {"x": c}} for c in (None, {"m": 1})] + [{**data, "hypotheses": {**data["hypotheses"], report.HYPOTHESES[0]: None}}]
    other = json.loads(json.dumps(data))
    other["all_comparisons"]["hybrid_EN_to_BN"]["recall@5"]["n_units"] = 24
    del data["hypotheses"][report.HYPOTHESES[3]]["mean_penalty"]
    for wrong in (*broken, other, data):
        with pytest.raises(report.InvalidStudy):
            report.study(wrong)
    with pytest.raises(report.InvalidStudy):
        report.read(str(tmp_path / "missing.json"))


def test_experiment_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Whales are large mammals. They live in the sea."), ("d2", "Cars have engines. They drive on roads."), ("d3", "Bread is baked from flour and water.")], "doc_id string, content string")
    queries = spark.createDataFrame([("q1", "where do whales live"), ("q2", "what is bread baked from")], "query_id string, query string")
    passages = spark.createDataFrame(
        [("p1", "q1", "d1", "They live in the sea", None, None), ("p2", "q2", "d3", "baked from flour and water", None, None)],
        "passage string, query_id string, doc_id string, snippet string, start_char int, end_char int",
    )
    parts = {"chunking": {"strategy": "sentence", "chunk_size": 20, "chunk_overlap": 0}, "embedding": {"provider": "mock"}, "retrieval": {"mode": ["bm25", "hybrid"], "top_k": 3}, "reranker": {"enabled": True, "strategy": "mock", "top_n": 2}, "evaluation": {"k_values": [1, 2]}}
    plan = config.Experiment("e", "set", components=parts)
    saved = []
    corpus = runner.Corpus(docs, "v1")
    results = runner.run_matrix(spark, plan, corpus, queries, passages, save=lambda key, stages: saved.append(store.write_trace(f"file://{tmp_path}", key, **{k: v for k, v in stages.items() if k != "summary"})))
    assert runner.matrix_verdict(results) == "COMPLETED", [r.error for r in results]
    assert results[0].means["recall@2"] == 1.0 and results[0].means["doc_recall@2"] == 1.0
    again = runner.run_matrix(spark, plan, corpus, queries, passages, known={r.cache_hash: r.means for r in results})
    assert all(r.cached for r in again)
    trail = relational.evidence_trail(
        store.read_trace(spark, f"file://{tmp_path}", "context").select("run_id", "query_id").where(F.col("run_id") == results[0].cache_hash),
        "query_id",
        metrics=store.read_trace(spark, f"file://{tmp_path}", "metrics").where(F.col("run_id") == results[0].cache_hash),
    )
    assert trail.count() == 2 and trail.first().metrics["mrr@2"] in (0.5, 1.0)


def test_stream_rollup(spark, tmp_path):
    events = spark.sql("SELECT CAST(id AS long) event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,CAST(id*10 AS int)) ts, 'x' event_type, CAST(id AS double) value FROM range(12)")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = metric_stream.read(spark, f"file://{tmp_path}/e", "event_id long, ts timestamp, event_type string, value double")
    rows = metric_stream.run_once(metric_stream.rollup(stream), "rolled").orderBy("window_start").collect()
    assert [(r.n, r["mean"]) for r in rows] == [(6, 2.5), (6, 8.5)]
