"""Steps whose memory, time or order of sums once grew with the tables."""

import random

from pyspark.sql import functions as F

from millrace.operators import chunking, embed, lexical, qrels, relational


def test_likeness_of_neighbours_joins_no_grams(spark):
    rows = [(1, 0, "abcd"), (1, 1, "abcx"), (1, 2, "zz"), (2, 5, "abcd"), (None, 0, "abcd"), (None, 1, "abcd"), (3, 0, None), (3, 1, "abc"), (4, 0, "aé😀bc"), (4, 1, "Aé😀  b")]
    likeness = embed.gram_likeness(spark.createDataFrame(rows, "g int, p int, t string"), "g", "p", "t")
    found = {(r.g, r.p): round(r.similarity, 6) for r in likeness.collect()}
    assert found == {(1, 1): 0.5, (4, 1): round(1 / 3, 6)}
    assert "Join" not in likeness._jdf.queryExecution().optimizedPlan().toString()


def test_equal_values_in_another_order_tie_on_the_frontier(spark):
    rows = [(1, v) for v in (0.1, 0.2, 0.3)] + [(2, v) for v in (0.3, 0.2, 0.1)] + [(3, 0.1)] * 3
    points = spark.createDataFrame(rows, "id int, value double").coalesce(1).groupBy("id").agg(relational.exact_mean(F.col("value")).alias("recall"), F.count(F.lit(1)).alias("latency"))
    assert {r.id for r in relational.pareto(points).collect()} == {1, 2}
    odd = spark.createDataFrame([(float("inf"),), (1.0,)], "value double").agg(relational.exact_mean(F.col("value")).alias("m"))
    assert odd.first().m == float("inf")


def plain(text):
    return " ".join(text.lower().split())


def test_containment_reads_few_tables(spark):
    """Texts of one, two, three and more words, either way, squeezed once."""
    rng = random.Random(4)
    words = ["ab", "abc", "b", "Ca", "dd", "é", "longer-word-of-chars"]
    make = lambda n: " \n".join(rng.choice(words) for _ in range(n))
    snippets = [(i, make(rng.randrange(0, 9))) for i in range(60)] + [(90, None), (91, " "), (92, "b"), (93, "zz zz zz")]
    contents = [(str(i), make(rng.randrange(0, 30))) for i in range(80)] + [("n", None), ("e", ""), ("s", "Longer-word-of-chars"), ("t", "ab  longer-word-of-chars")]
    p = spark.createDataFrame(snippets, "passage int, snippet string")
    c = spark.createDataFrame(contents, "chunk_id string, content string")
    wanted = set()
    for i, s in snippets:
        for k, t in contents:
            if s is not None and t is not None and (s := plain(s)) and (s in plain(t) or len(plain(t)) > 15 and plain(t) in s):
                wanted.add((i, k))
    assert {tuple(r) for r in qrels.containment_matches(p, c).collect()} == wanted and len(wanted) > 50
    limit, qrels.BROADCAST = qrels.BROADCAST, 0
    try:
        found = qrels.containment_matches(p, c)
        assert {tuple(r) for r in found.collect()} == wanted
    finally:
        qrels.BROADCAST = limit
    # no later step reads the chunks again
    assert "content#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_phrases_in_common(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(14)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    snippets = [(i, make(rng.randrange(0, 12))) for i in range(40)] + [(90, None), (91, "")]
    contents = [(str(i), make(rng.randrange(0, 25))) for i in range(50)] + [("n", None)]
    p, c = spark.createDataFrame(snippets, "passage int, snippet string"), spark.createDataFrame(contents, "chunk_id string, content string")
    sets = lambda t: set((t or "").split())
    runs = lambda t: {tuple(w[i : i + 4]) for w in [(t or "").split()] for i in range(len(w) - 3)}
    pairs = [(i, k, s, t) for i, s in snippets for k, t in contents]
    matched = qrels.word_matches(p, c)
    assert {tuple(r) for r in matched.collect()} == {(i, k) for i, k, s, t in pairs if len(sets(s) & sets(t)) >= max(3, len(sets(s)) / 2)}
    assert {tuple(r) for r in qrels.phrase_matches(p, c).collect()} == {(i, k) for i, k, s, t in pairs if runs(s) & runs(t)}
    assert "content#" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_blank_document_ids_pair_with_no_chunk_before_the_rules(spark):
    """A passage without a document has all chunks, but they are not listed to resolve it."""
    chunks = spark.createDataFrame([(f"{i}:0", str(i), "one two three four five", 0, 23) for i in range(30)], "chunk_id string, doc_id string, content string, start_char int, end_char int")
    rows = [(1, 1, "", "two three four"), (2, 2, "7", "two three four"), (3, 3, None, "two three four"), (4, 4, "zz", "two three four")]
    passages = spark.createDataFrame(rows, "passage int, query_id int, doc_id string, snippet string").selectExpr("*", "int(null) start_char", "int(null) end_char")
    assert {r.passage for r in qrels._named(passages, chunks).collect()} == {2}
    assert qrels.resolve(passages, chunks, compat=True).groupBy("passage").count().orderBy("passage").collect() == [(1, 30), (2, 3), (3, 30), (4, 30)]
    assert qrels.candidates(passages, chunks).groupBy("passage").count().orderBy("passage").collect() == [(1, 30), (2, 3), (3, 30), (4, 30)]


def test_windows_of_ids_leave_the_worker_in_small_batches(spark):
    class Words:
        """Every character is an id."""

        def __call__(self, text):
            return len(text)

        def spans(self, text, size, overlap):
            return [(i, min(i + size, len(text))) for i in range(0, len(text), size)]

    held, chunking.WINDOWS = chunking.WINDOWS, 3
    try:
        docs = spark.createDataFrame([(1, "abcd efgh" * 5), (2, None), (3, " "), (4, "xy  z")], "doc_id long, content string").coalesce(1)
        made = chunking.chunk(docs, "fixed", size=4, overlap=0, codec=Words())
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, made.collect()))
    finally:
        chunking.WINDOWS = held
    text = "abcd efgh" * 5
    assert [r[4:7] for r in rows if r[0] == 1] == [(len(text[i : i + 4].strip()), i + len(text[i : i + 4]) - len(text[i : i + 4].lstrip()), i + len(text[i : i + 4].rstrip())) for i in range(0, 45, 4)]
    assert [r[:3] for r in rows if r[0] == 4] == [(4, 0, "xy"), (4, 1, "z")] and {r[0] for r in rows} == {1, 4}



def test_ids_cross_as_arrow_lists(spark):
    import public_tokenizers
    from pyspark.util import PythonEvalType

    from millrace.functions import bpe

    made = bpe.encoding(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [("a few words, and é😀",), (None,), ("",), ("more " * 50,)]
    found = spark.createDataFrame(texts, "t string").coalesce(1).select("t", bpe.ids(made)(F.col("t")).alias("ids"))
    assert {r.t: r.ids for r in found.collect()} == {t: None if t is None else made.encode(t) for (t,) in texts}
    # a pandas function would hold a list of Python's numbers for each text of a batch
    assert bpe.ids(made).evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


def test_hash_cells_take_one_shuffle_of_texts(spark):
    encode = embed.provider("mock", dimension=384)
    texts = [(1, "Some words, é😀 more"), (2, None), (3, " "), (4, "aaa aaa b")]
    rows = spark.createDataFrame(texts, "id int, t string")
    cells = embed.shingle_hashes(rows, "id", "t")
    found = {(r.id, r.idx): round(r.value, 9) for r in cells.collect()}
    dense = {r.id: r.v for r in rows.select("id", encode(F.col("t")).alias("v")).collect()}
    assert found == {(i, k): round(x, 9) for i, v in dense.items() for k, x in enumerate(v) if x}
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1


def test_a_search_passes_once_over_rows_of_chunks(spark, monkeypatch):
    """One row a chunk; each task keeps k of a query, ties to the lesser chunk_id, however few sums it holds at once."""
    rng = random.Random(8)
    rows = [(f"c{i:03d}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 12))), i % 2) for i in range(300)] + [(f"t{i:02d}", "zz a", 1) for i in range(40)] + [("n", None, 0)]
    corpus = spark.createDataFrame(rows, "chunk_id string, content string, odd int").repartition(5)
    queries = spark.createDataFrame([(1, 0, "a b zz"), (1, 1, "zz"), (2, 0, "h h c q"), (3, 0, ""), (4, 0, None)], "a int, b int, query string").selectExpr("struct(a, b) AS query_id", "query")
    index = lexical.index(corpus, keep=lambda df: df.localCheckpoint())
    assert index.chunks.count() == 341 and index.postings.where("length > 0").groupBy("chunk_id").count().count() == sum(bool(r[1]) for r in rows)
    for where in (None, F.col("odd") == 1):
        wanted = sorted(map(tuple, lexical.search(queries, corpus, index, 6, where=where, direct=1 << 30).collect()))
        monkeypatch.setattr(lexical, "CELLS", 40)
        assert sorted(map(tuple, lexical.search(queries, corpus, index, 6, where=where).collect())) == wanted and len(wanted) == 18
        monkeypatch.undo()
    passed = lexical.Search(queries, index, 6).passed(6)
    assert 18 <= passed.count() <= 6 * 3 * index.chunks.rdd.getNumPartitions()
    plan = passed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_words_in_python_are_those_of_the_expression(spark):
    from millrace.functions import text

    given = ["", "One, two;three", "caf\u00e9 \u00b2\u00bd \ufb01n\u00a0x\x85y\x1cz", "\u09ad\u09be\u09b7\u09be\u0964 \u2018q\u2019 \u3000w", "a`b~c_d^e|f", "\u212b \u0130stanbul \u03a3\u03a3"]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(F.lower("t").alias("low"), text.bm25_tokens(F.col("t")).alias("a"), text.bm25_tokens(F.col("t"), False).alias("b")).collect()
    assert [text.bm25_words(r.low) for r in rows] == [r.a for r in rows]
    assert [text.bm25_words(r.low, False) for r in rows] == [r.b for r in rows]


def test_merged_chunks_are_made_in_arrow_batches(spark, monkeypatch):
    """Each piece is counted once and dropped once; the chunks are those of a walk that adds up what is held."""

    def walk(pieces, size, overlap):
        chunks, held = [], []
        for piece in pieces:
            n = chunking.count_tokens(piece)
            if held and sum(map(chunking.count_tokens, held)) + n > size:
                chunks.append(" ".join(held))
                while held and (sum(map(chunking.count_tokens, held)) > overlap or sum(map(chunking.count_tokens, held)) + n > size):
                    held.pop(0)
            held.append(piece)
        return chunks + ([" ".join(held)] if held else [])

    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["ab", "c d", "é. ", "\n", "\n\n", " ", " ", "word\u00a0x", "? ", "longer"]) for _ in range(n))
    texts = [(i, make(rng.randrange(0, 90))) for i in range(60)] + [(100, None), (101, " \n"), (102, "x" * 40)]
    docs = spark.createDataFrame(texts, "doc_id int, content string").coalesce(1)
    monkeypatch.setattr(chunking, "WINDOWS", 3)
    for size, overlap in ((1, 0), (6, 0), (9, 4)):
        made = chunking.chunk(docs, "recursive", size=size, overlap=overlap)
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
        wanted = {i: [c for c in map(str.strip, walk(chunking.split_recursively(t, size), size, overlap)) if c] for i, t in texts if t and t.strip()}
        found = {}
        for r in made.orderBy("doc_id", "chunk_index").collect():
            found.setdefault(r.doc_id, []).append(r.content)
            assert (r.token_count, r.char_count, r.end_char) == (chunking.count_tokens(r.content), len(r.content), r.start_char + r.char_count)
        assert found == wanted


def test_no_task_hashes_more_than_its_turn(spark):
    """The chain over all contents is carried on by tasks that read one range each."""
    import hashlib

    from millrace.functions import hashing

    rng = random.Random(5)
    rows = [(None if i % 50 == 0 else f"n{rng.randrange(80):02d}", None if i % 31 == 0 else "é" * rng.randrange(0, 40) + str(rng.randrange(9))) for i in range(300)] + [("n40", "same")] * 100
    docs = spark.createDataFrame(rows, "name string, content string").repartition(3)
    key = lambda r: tuple((x is not None, (x or "").encode()) for x in r)
    wanted = hashlib.sha256("".join(c or "" for _, c in sorted(rows, key=key)).encode()).hexdigest()
    for turn in (1 << 20, 2000, 300):
        found = hashing.dataset_hash(docs, "name", "content", turn=turn)
        assert [r.content_hash for r in found.collect()] == [wanted]
    # the last task reads its own range only
    read = spark.read.parquet(*found.inputFiles()).agg(F.sum(F.octet_length("content"))).first()[0]
    assert read < sum(len((c or "").encode()) for _, c in rows) / 4


def test_hash_embedding_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    from millrace.queries import oracle_sql, queries

    def repeated(**times):
        return " ".join(f"{letter} " * n for letter, n in times.items())

    texts = [None, "", " \t\n", "so", "ﬁne ½ ＡＢＣ e\u0301", "İstanbul ΟΔΟΣ. ẞ K Å", "a\x00b 😀x", "same"]
    # halves of the last place that no double holds: cells of 41, 323, 333 and 203 beside norms of 640 and 3200
    texts += [repeated(a=41, c=638, d=29, e=5, f=3), repeated(a=323, c=551, d=39, e=10, f=7), repeated(a=333, c=546, d=19, e=15, f=3)]
    texts += [repeated(a=203, c=3193, d=59, e=6, f=5)]
    rows = spark.createDataFrame([*enumerate(texts), (7, "same id"), (None, "no id")], "doc_id long, text string")
    rows.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    made = queries()["hash_embedding"](spark, f"file://{tmp_path}")
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, con.execute(oracle_sql()["hash_embedding"]).fetchall()))
