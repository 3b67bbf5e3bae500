import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import context, dense, embed, fusion, lexical, metrics, qrels, rerank, transforms


def ranking(spark, **lists):
    rows = [(q, c, float(s), i) for q, items in lists.items() for i, (c, s) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int")


def naive_bm25(docs, query):
    n = len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    odds = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(odds.values()) / len(odds)
    idf = {t: 0.25 * mean if o < 0 else o for t, o in odds.items()}
    avg = sum(map(len, docs.values())) / n
    score = {}
    for name, words in docs.items():
        total = 0.0
        for t in query:
            tf = words.count(t)
            total += idf.get(t, 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        score[name] = round(total, 9)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_matches_the_formula_and_fills_with_zeros(spark):
    docs = {"a": "red red blue", "b": "blue green sky", "c": "sun moon", "d": "red moon dog", "e": "cat"}
    corpus = spark.createDataFrame(list(docs.items()), "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "red blue red"), ("z", "unseen"), ("n", "...")], "query_id string, query string")
    found = lexical.search(queries, corpus, lexical.index(corpus), 4).orderBy("query_id", "rank").collect()
    expected = naive_bm25({k: v.split() for k, v in docs.items()}, ["red", "blue", "red"])[:4]
    assert [(r.chunk_id, pytest.approx(r.score)) for r in found if r.query_id == "q"] == expected
    assert [r.chunk_id for r in found if r.query_id == "z"] == ["a", "b", "c", "d"]
    assert not [r for r in found if r.query_id == "n"]


def many_chunks(spark, n=400):
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(300)])
    share = 1 / np.arange(1, 301)
    docs = {f"c{i:03d}": [str(w) for w in rng.choice(words, rng.integers(3, 60), p=share / share.sum())] for i in range(n)}
    docs["e"] = []
    rows = [(c, " ".join(w), "even" if i % 2 == 0 else "odd") for i, (c, w) in enumerate(docs.items())]
    asked = {f"q{i}": [str(w) for w in rng.choice(words, 7, p=share / share.sum())] for i in range(12)} | {"common": ["w0", "w1"], "rare": ["w250", "w299"], "one": ["w0"]}
    return docs, spark.createDataFrame(rows, "chunk_id string, content string, half string"), asked


@pytest.mark.parametrize("few", [lexical.MANY, 0])
def test_bounds_change_no_list(spark, monkeypatch, few):
    monkeypatch.setattr(lexical, "MANY", few)
    docs, corpus, asked = many_chunks(spark)
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id string, query string")
    index = lexical.index(corpus, keep=lambda df: df.cache())
    wanted = {q: naive_bm25(docs, w) for q, w in asked.items()}
    for k, direct in ((8, 0), (8, 1 << 30), (200, 0)) if few else ((8, 0),):
        lists = {q: [] for q in asked}
        for r in lexical.search(queries, corpus, index, k, direct=direct).orderBy("query_id", "rank").collect():
            lists[r.query_id].append((r.chunk_id, r.score))
        for q, found in lists.items():
            assert [c for c, _ in found] == [c for c, _ in wanted[q][:k]], (k, direct, q)
            assert [s for _, s in found] == pytest.approx([s for _, s in wanted[q][:k]], abs=1e-8)
    halves = {c for i, c in enumerate(docs) if i % 2}
    for r in lexical.search(queries, corpus, index, 5, where=F.col("half") == "odd", direct=0).collect():
        assert [c for c, _ in wanted[r.query_id] if c in halves][r["rank"] - 1] == r.chunk_id


def test_few_postings_of_frequent_terms_are_read(spark):
    docs, corpus, asked = many_chunks(spark, 3000)
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id string, query string")
    steps = lexical.Search(queries, lexical.index(corpus, keep=lambda df: df.cache()), 5, direct=0)
    wanted, blocks = steps.survivors()
    read = steps.completing(wanted.join(blocks, ["query_id", "block"], "left_anti")).count() + steps.reading(blocks).count()
    held = steps.often.join(steps.index.terms, "term").agg(F.sum("df")).first()[0]
    assert steps.often.count() > 20 and read < held / 2


def test_zeros_fill_lists_before_scores_below_zero(spark):
    # most terms are in most chunks, so that all weights are negative
    docs = {f"c{i:02d}": ["a", "b"] if i < 30 else ["a"] if i < 38 else ["z"] for i in range(40)}
    corpus = spark.createDataFrame([(c, " ".join(w)) for c, w in docs.items()], "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "a b")], "query_id string, query string")
    index = lexical.index(corpus, keep=lambda df: df.cache())
    assert index.terms.agg(F.min("idf")).first()[0] < 0
    for k in (1, 2, 6):
        found = lexical.search(queries, corpus, index, k, direct=0).orderBy("rank").collect()
        assert [(r.chunk_id, pytest.approx(r.score)) for r in found] == naive_bm25(docs, ["a", "b"])[:k]


def test_common_term_does_not_push_its_documents_down(spark):
    corpus = spark.createDataFrame([("a", "python code"), ("b", "python snake"), ("c", "java code")], "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "python")], "query_id string, query string")
    found = lexical.search(queries, corpus, lexical.index(corpus), 3).orderBy("rank").collect()
    assert {r.chunk_id for r in found[:2]} == {"a", "b"}


def test_filter_applies_after_statistics(spark):
    corpus = spark.createDataFrame([("a", "x y", "en"), ("b", "x", "fr"), ("c", "z", "en")], "chunk_id string, content string, lang string")
    queries = spark.createDataFrame([("q", "y")], "query_id string, query string")
    index = lexical.index(corpus)
    whole = {r.chunk_id: r.score for r in lexical.search(queries, corpus, index, 3).collect()}
    part = lexical.search(queries, corpus, index, 3, where=F.col("lang") == "en").collect()
    assert {r.chunk_id: r.score for r in part} == {k: whole[k] for k in ("a", "c")}


def test_index_survives_saving(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x y"), ("b", "x")], "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "y x")], "query_id string, query string")
    index = lexical.index(corpus)
    lexical.save(index, f"file://{tmp_path}/i")
    again = lexical.load(spark, f"file://{tmp_path}/i")
    assert lexical.search(queries, corpus, index, 2).collect() == lexical.search(queries, corpus, again, 2).collect()


def test_dense_ties_go_to_the_lesser_id(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    found = dense.search(queries, vectors, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_reciprocal_ranks(spark):
    lists = ranking(spark, q=[("A", 3), ("B", 2), ("C", 1)]).union(ranking(spark, q=[("B", 9), ("A", 8), ("D", 7)]))
    found = {r.chunk_id: r for r in fusion.reciprocal_rank(lists, None).collect()}
    assert found["A"].score == found["B"].score == pytest.approx(1 / 61 + 1 / 62)
    assert found["C"].score == found["D"].score == pytest.approx(1 / 63)
    assert [found[c].rank for c in "ABCD"] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(lists, 3, -1)


def test_normalised_scores(spark):
    empty = ranking(spark).limit(0)
    single = fusion.normalised_scores(ranking(spark, q=[("A", 5.0)]), empty, None, 0.5).first()
    assert (single.chunk_id, single.score) == ("A", 0.5)
    one, two = ranking(spark, q=[("X", 2), ("Y", 1)]), ranking(spark, q=[("Y", 2), ("X", 1)])
    assert fusion.normalised_scores(one, two, 1, 0.8).first().chunk_id == "X"
    assert fusion.normalised_scores(one, two, 1, 0.2).first().chunk_id == "Y"


def test_overlap_reranking(spark):
    rows = [("q", "a", 9.0, 1, "red car", "blue bike"), ("q", "b", 8.0, 2, "red car", "a RED car")]
    ranked = spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, query string, content string")
    first = rerank.by_overlap(ranked, 1).first()
    assert (first.chunk_id, first.original_rank, first.score) == ("b", 2, pytest.approx(2 / 3))
    assert rerank.by_overlap(ranked, 1, {"a": 5.0}).first().chunk_id == "a"
    assert rerank.rerank(ranked, F.lit(1.0), 1, descending_ids=True).first().chunk_id == "b"


def test_transforms(spark):
    queries = spark.createDataFrame([("q", "why")], "query_id string, query string")
    reply = transforms.canned({"why": "1. what\n- how\n\n* what\n2) when"})
    subs = [r.sub_query for r in transforms.sub_queries(queries, "multi_query", reply, n=2).orderBy("sequence_index").collect()]
    assert subs == ["why", "what", "how"]
    assert [r.sub_query for r in transforms.sub_queries(queries, "step_back", transforms.canned({"why": " reasons "})).collect()] == ["reasons", "why"]
    assert transforms.sub_queries(queries, "none").first().sub_query == "why"
    assert transforms.sub_queries(queries, "hyde").first().sub_query.startswith("Mock response: ")
    with pytest.raises(ValueError):
        transforms.sub_queries(queries, "other")


@pytest.mark.parametrize(
    ("ranked", "relevant", "k", "expected"),
    [
        (["d1", "d2", "d3", "d4", "d5"], {"d2": 1, "d4": 1}, 3, (0.5, 1 / 3, 0.5, (1 / math.log2(3)) / (1 + 1 / math.log2(3)), 1.0)),
        (["A", "A"], {"A": 1}, 2, (1.0, 0.5, 1.0, 1.0, 1.0)),
        (["A", "A", "B"], {"A": 1, "B": 1}, 3, (1.0, 2 / 3, 1.0, 1.5 / (1 + 1 / math.log2(3)), 1.0)),
        (["A", "A", "B"], {"A": 3, "B": 1}, 3, (1.0, 2 / 3, 1.0, 7.5 / (7 + 1 / math.log2(3)), 1.0)),
        ([], {"A": 1}, 3, (0.0,) * 5),
        (["A"], {}, 3, (0.0,) * 5),
        (["A"], {"A": 1}, 0, (0.0,) * 5),
    ],
)
def test_ranking_metrics(spark, ranked, relevant, k, expected):
    queries = spark.createDataFrame([("q",)], "query_id string")
    rels = spark.createDataFrame([("q", c, g) for c, g in relevant.items()], "query_id string, chunk_id string, gain int")
    row = metrics.ranking_metrics(queries, ranking(spark, q=[(c, 1) for c in ranked]), rels, [k], gain="gain").first()
    assert (row.recall, row.precision, row.mrr, row.ndcg, row.hit) == pytest.approx(expected)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("ABCDEF"), max_size=8), st.sets(st.sampled_from("ABCDEF"), max_size=4))
def test_metrics_are_bounded(spark, ranked, relevant):
    queries = spark.createDataFrame([("q",)], "query_id string")
    rels = spark.createDataFrame([("q", c) for c in relevant], "query_id string, chunk_id string")
    for row in metrics.ranking_metrics(queries, ranking(spark, q=[(c, 1) for c in ranked]), rels, [1, 3]).collect():
        assert all(0 <= v <= 1 + 1e-12 for v in (row.recall, row.precision, row.mrr, row.ndcg, row.hit))


def test_faithfulness_and_citations(spark):
    answers = spark.createDataFrame([("a", "Whales are mammals [1]. Rocks sing loudly [9].", "whales are large mammals"), ("b", "", "x")], "query_id string, answer string, context string")
    rows = {r.query_id: r for r in metrics.faithfulness(answers).collect()}
    assert (rows["a"].faithfulness, rows["b"].faithfulness) == (0.5, 1.0)
    sources = spark.createDataFrame([("a", 1, "whales are large mammals")], "query_id string, source_index int, content string")
    cited = {r.query_id: r for r in metrics.citation_metrics(answers, sources).collect()}
    assert (cited["a"].citation_precision, cited["a"].citation_recall) == (0.5, 0.5)
    assert (cited["b"].citations, cited["b"].citation_recall) == (0, 0.0)


@pytest.mark.parametrize(("n", "order"), [(5, [1, 3, 5, 4, 2]), (6, [1, 3, 5, 6, 4, 2]), (2, [1, 2]), (1, [1])])
def test_lost_in_the_middle(spark, n, order):
    rows = spark.range(n).select("id", context.reorder_key(F.col("id"), F.lit(n), "lost_in_the_middle").alias("k"))
    assert [r.id + 1 for r in rows.orderBy("k").collect()] == order


def test_packing_skips_what_does_not_fit(spark):
    rows = [("q", 1, "a", "d", "one two", 3.0), ("q", 2, "b", "d", "word " * 60, 2.0), ("q", 3, "c", "d", "three", 1.0)]
    candidates = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, content string, score double")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    packed = {r.query_id: r for r in context.pack(queries, candidates, 30).collect()}
    assert [s.chunk_id for s in packed["q"].sources] == ["a", "c"] and packed["q"].truncated == 1 and packed["q"].fits
    assert packed["q"].text.startswith("[Source 1] (doc: d, chunk: a)\none two\n\n[Source 2]")
    assert (packed["none"].text, packed["none"].total_tokens) == ("", 0)


def test_gold_passages(spark):
    chunks = spark.createDataFrame(
        [("c0", "d1", "the quick brown fox jumps over the lazy dog today", 0, 50), ("c1", "d1", "nothing here", 50, 62), ("c2", "d2", "Quick brown fox jumps!", 0, 22)],
        "chunk_id string, doc_id string, content string, start_char int, end_char int",
    )
    rows = [("p0", "q0", "d1", "brown fox jumps over the", None, None), ("p1", "q1", "d1", "ignored", 49, 52), ("p2", "q2", "d9", "zzz", None, None)]
    passages = spark.createDataFrame(rows, "passage string, query_id string, doc_id string, snippet string, start_char int, end_char int")
    found = {(r.passage, r.chunk_id) for r in qrels.resolve(passages, chunks).collect()}
    assert found == {("p0", "c0"), ("p1", "c0"), ("p1", "c1")}
    assert [r.passage for r in qrels.unresolved(passages, qrels.resolve(passages, chunks)).collect()] == ["p2"]
    either_way = {(r.passage, r.chunk_id) for r in qrels.containment_matches(passages, chunks).collect()}
    assert either_way == {("p0", "c0")}


def test_hash_embeddings_agree(spark):
    texts = spark.createDataFrame([(0, "Hello abc"), (1, ""), (2, "résumé ab")], "id int, t string")
    sparse = np.zeros((3, 384))
    for r in embed.shingle_hashes(texts, "id", "t").collect():
        sparse[r.id, r.idx] = r.value
    whole = texts.select("id", embed.provider("mock", dimension=384)(F.col("t")).alias("v")).orderBy("id").collect()
    assert np.allclose(sparse, np.array([r.v for r in whole]))
    assert whole[1].v[0] == 1.0
    with pytest.raises(ValueError):
        embed.provider("nothing")
