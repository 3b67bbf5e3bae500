import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace import queries
from millrace.functions import bpe
from millrace.operators import chunking, context
from millrace.plans import config, runner

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoding(spark):
    return queries.byte_pairs(spark)


@pytest.fixture(scope="module")
def own():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_ids_are_those_of_the_vocabularys_own_tokenizer(spark, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_md5) for r in queries.bpe_token_counts(spark, SF).collect()}
    for doc_id, made in zip(texts, own.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True):
        if texts[doc_id] is not None:
            assert found[doc_id] == (len(made.ids), hashlib.md5(",".join(map(str, made.ids)).encode()).hexdigest())


ODD = ["", " ", "one", "héllo wörld 😀😀😀 " * 40, "ক খ গ।" * 60, "tabs\tand\nlines\n\n" * 30, None]


def test_windows_rebuild_the_text(encoding):
    for text in filter(None, ODD):
        spans = encoding.spans(text, 7, 0)
        assert "".join(text[a:b] for a, b in spans) == text
        assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_windows_lie_where_they_say(spark, encoding):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, content string")
    rows = chunking.chunk(docs, "fixed", size=16, overlap=4, codec=encoding).collect()
    assert {r.doc_id for r in rows} == {2, 3, 4, 5}
    for r in rows:
        assert ODD[r.doc_id][r.start_char : r.end_char] == r.content and r.content.strip() == r.content and r.token_count == encoding(r.content)
        assert r.token_count <= 17
    with pytest.raises(ValueError):
        chunking.chunk(docs, "fixed", size=4, overlap=4, codec=encoding)


def test_windows_query_counts_every_document(spark, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.bpe_windows(spark, "/root/testdata/sf0.001").collect()
    for doc_id, text in texts.items():
        wanted = [text[a:b].strip() for a, b in encoding.spans(text, 200, 20)] if text and text.strip() else []
        made = sorted((r.chunk_index, r.content_md5) for r in rows if r.doc_id == doc_id)
        assert [m for _, m in made] == [hashlib.md5(w.encode()).hexdigest() for w in wanted if w]


def test_counts_and_budgets(spark, encoding):
    counts = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", bpe.counter(encoding)(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in counts} == {i: None if t is None else len(encoding.encode(t)) for i, t in enumerate(ODD)}
    rows = [("q", r, f"c{r}", f"d{r}", "word " * (90 if r == 2 else 5) + "é" * r, 1.0 / r) for r in range(1, 6)]
    candidates = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, doc_id string, content string, score double")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    packed = {r.query_id: r for r in context.pack(asked, candidates, 100, encoding=encoding).collect()}
    used, chosen = 0, []
    for _, rank, chunk, doc, content, _ in rows:
        text = f"[Source {len(chosen) + 1}] (doc: {doc}, chunk: {chunk})\n{content}\n\n"
        if used + encoding(text) <= 100:
            used, chosen = used + encoding(text), [*chosen, chunk]
    assert packed["q"].used == used and [x.chunk_id for x in packed["q"].chosen] == chosen and "c2" not in chosen and len(chosen) > 1
    assert packed["q"].total_tokens == encoding(packed["q"].text) <= 100
    assert packed["none"].total_tokens == 0


def test_configurations_name_encodings(spark, encoding):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten " * 20)], "doc_id int, content string")
    point = config.Pipeline()
    plain = runner.Corpus(docs).chunks(point).count()
    bpe.register(point.context.encoding_name, encoding)
    try:
        cut = runner.Corpus(docs).chunks(point)
        assert cut.count() != plain and cut.agg(F.max("token_count")).first()[0] <= point.chunking.chunk_size + 1
    finally:
        bpe._NAMED.clear()
