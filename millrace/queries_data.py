"""Queries of sources, stores, text functions, filters and query transforms; see ``queries``."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.operators import dense, embed, lexical, relational, transforms
from millrace.plans import runner, sweep
from millrace.queries import _OWN_PROMPT, _SCORES, _SPACE, _ranked, asked, built, corpus, query, shingle_tables, six, table, vectors
from millrace.sources import export, readers, store
from millrace.storage import fresh_path, materialize

# text and sources

#: What compatibility composition changes, since the data has nothing of the kind.
_COMPAT, _COMPOSED = "ﬁ Ⅻ ｶﾞ ①½", "fi XII ガ 11⁄2"


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g')) AS latin_md5, md5(text) AS utf8_md5 FROM documents")
def encoding_fallback(spark, d):
    latin, utf8 = (readers.decode(F.encode("content", name)) for name in ("ISO-8859-1", "UTF-8"))
    return corpus(spark, d).select("doc_id", F.md5(latin).alias("latin_md5"), F.md5(utf8).alias("utf8_md5"))


@query(f"SELECT doc_id, md5(replace(text, chr(10), chr(10) || chr(10)) || '{_COMPOSED}') AS normal_md5 FROM documents")
def text_normalise(spark, d):
    mixed = F.concat(F.replace("content", F.lit("\n"), F.lit("\r\n\r")), F.lit(_COMPAT))
    return corpus(spark, d).select("doc_id", F.md5(text.normalise(mixed)).alias("normal_md5"))


@query(f"SELECT doc_id, md5(text || '{_COMPOSED} x' || chr(8205) || 'fi') AS view_md5 FROM documents")
def normal_view(spark, d):
    return corpus(spark, d).select("doc_id", F.md5(text.view(F.concat("content", F.lit(f"{_COMPAT} x‍ﬁ")))).alias("view_md5"))


@query(
    f"""WITH m AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || chr(10) || text || chr(10) || '## End' || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' AS body FROM documents)
    SELECT doc_id, md5(regexp_replace(body, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS body_md5, 'note ' || doc_id AS title, len(regexp_extract_all(body, '(?m)^#{{1,6}}[ \\t]+[^\\n]+'))::INTEGER AS headers,
    'Title ' || doc_id AS first_header, 1 AS code_blocks FROM m"""
)
def markdown_parse(spark, d):
    """Documents under a front matter, between two headers, with a fenced block; their own texts hold no headers."""
    name = F.col("doc_id").cast("string")
    whole = F.concat(F.lit("---\ntitle: note "), name, F.lit("\n---\n# Title "), name, F.lit("\n\n"), F.col("content"), F.lit("\n## End\n```\nx = 1\n```"))
    rows = corpus(spark, d).select("doc_id", readers.markdown(whole).alias("m"))
    return rows.select("doc_id", F.md5("m.content").alias("body_md5"), F.col("m.metadata")["title"].alias("title"), F.size("m.headers").alias("headers"), F.get("m.headers", F.lit(0))["title"].alias("first_header"), F.col("m.code_blocks").alias("code_blocks"))


@query(
    f"""SELECT item_id || '.txt' AS filename, row_number() OVER (ORDER BY item_id || '.txt') - 1 AS place, 'text' AS file_type,
    'doc_' || substr(sha256(regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), 1, 16) AS doc_id FROM benchmark"""
)
def folder_documents(spark, d):
    """The passages written as one folder of files, and read as a corpus."""
    path = fresh_path(spark, "folder")
    lines = table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("value"))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # a folder of one small file a passage
    for row in lines.toLocalIterator():
        out = system.create(files.Path(os.path.join(path, row["name"])), True)
        out.write(bytearray((row["value"] or "").encode()))
        out.close()
    return readers.documents(spark, path).select("filename", F.col("place").cast("long").alias("place"), "file_type", "doc_id")


def _question_file(spark, d, legacy: bool) -> str:
    """The passages as a file of questions, each with itself as the gold passage of the document of its number."""
    path = fresh_path(spark, "questions")
    rows = table(spark, d, "benchmark")
    name = F.col("item_id").cast("string")
    cells = [name.alias("id"), F.col("text").alias("question"), F.concat(F.lit("It is "), "text").alias("expected_answer" if legacy else "answer")]
    if legacy:
        # the old format is one list, of a benchmark's size
        whole = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*cells))), ","), F.lit("]"))
        rows.agg(whole.alias("value")).coalesce(1).write.text(path)
    else:
        passage = F.struct(name.alias("doc_id"), F.col("text").alias("text_snippet"), F.lit(3).alias("start_char"), (F.length("text") + 3).alias("end_char"))
        rows.select(F.to_json(F.struct(*cells, F.array(passage).alias("passages"))).alias("value")).coalesce(1).write.text(path)
    return path


@query(
    """SELECT item_id::VARCHAR AS query_id, md5(text) AS query_md5, md5('It is ' || text) AS answer_md5, 'en' AS language, item_id || '#0' AS passage, item_id::VARCHAR AS doc_id,
    md5(text) AS snippet_md5, 3 AS start_char, length(text)::INTEGER + 3 AS end_char FROM benchmark"""
)
def question_file(spark, d):
    found = materialize(readers.questions(spark, _question_file(spark, d, False)), "read")
    gold = readers.passages(found).select("query_id", "passage", "doc_id", F.md5("snippet").alias("snippet_md5"), "start_char", "end_char")
    return found.select("query_id", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"), "language").join(gold, "query_id")


@query("SELECT item_id::VARCHAR AS query_id, md5(text) AS query_md5, md5('It is ' || text) AS answer_md5 FROM benchmark")
def legacy_question_file(spark, d):
    found = readers.legacy_questions(spark, _question_file(spark, d, True))
    return found.select("query_id", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"))


@query(f"WITH {_SCORES} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM {_ranked('sc', 5)}")
def saved_index_topk(spark, d):
    docs, index = built(spark, d)
    path = fresh_path(spark, "index")
    lexical.save(index, path)
    return six(lexical.search(asked(spark, d), docs, lexical.load(spark, path), 5)).select("query_id", "chunk_id", "score", "rank")


def _stored(spark, d) -> store.VectorStore:
    """Vectors with metadata in two generations: those of even number are replaced by their opposites."""
    kept = store.VectorStore(spark, fresh_path(spark, "store"), "vectors")
    rows = vectors(spark, d).select("chunk_id", F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.when(F.col("label") % 2 == 0, F.col("label").cast("string")).alias("label"))
    rows = rows.join(vectors(spark, d).select("chunk_id", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("half"), (F.col("vec_id") % 2).cast("string")).alias("metadata")), "chunk_id")
    kept.upsert(rows)
    even = rows.where("doc_id % 2 = 0")
    kept.upsert(even.withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return kept


_STORED = "vec AS (SELECT vec_id, vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e, embedding::DOUBLE[] AS o, label FROM embeddings)"


def _from_store(spark, d, conditions, metadata_only, distance="cosine"):
    every_20th = vectors(spark, d).where("vec_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return six(_stored(spark, d).search(every_20th, 5, conditions, metadata_only, distance)).select("query_id", "chunk_id", "score", "rank")


def _store_sql(where: str, score: str = "list_cosine_similarity(q.o, c.e)") -> str:
    scored = f"ds AS (SELECT q.chunk_id AS query_id, c.chunk_id, c.label, round({score}, 9) AS score FROM vec q, vec c WHERE q.vec_id % 20 = 0 AND {where})"
    return f"WITH {_STORED}, {scored} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM {_ranked('ds', 5)}"


@query(_store_sql("c.label = 3 AND c.vec_id % 2 = 1"))
def vector_store_filtered(spark, d):
    return _from_store(spark, d, {"label": 3, "half": 1}, metadata_only=True)


@query(_store_sql("c.label IN (3, 4) AND c.label::VARCHAR = '4'"))
def attribute_filtered(spark, d):
    return _from_store(spark, d, {"label": 4}, metadata_only=False)


@query(_store_sql("TRUE", "-list_distance(q.o, c.e)"))
def euclidean_topk(spark, d):
    return _from_store(spark, d, None, False, "euclid")


@query("SELECT count(*) AS n, count(*) AS after_rewrite, TRUE AS there, FALSE AS there_after FROM embeddings")
def vector_store_life(spark, d):
    kept = store.open_store("folder", spark, fresh_path(spark, "store"), "life")
    rows = vectors(spark, d).select("chunk_id", "embedding")
    kept.upsert(rows)
    kept.upsert(rows.where("chunk_id LIKE '%1'"))
    n, there = kept.count(), kept.exists()
    kept.rewrite()
    after = kept.count()
    kept.delete()
    return spark.sql(f"SELECT {n}L AS n, {after}L AS after_rewrite, {there} AS there, {kept.exists()} AS there_after")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id, event_id, value FROM events WHERE user_id % 2 = 0 OR event_type = 'view'")
def published_trace(spark, d):
    """Two runs, one of them written twice and one never published."""
    root, events = fresh_path(spark, "trace"), table(spark, d, "events").select("event_id", "value", "user_id", "event_type")
    cells = lambda df: df.select("event_id", "value")
    store.write_trace(root, "odd", metrics=cells(events.where("user_id % 2 = 1")))
    store.write_trace(root, "odd", metrics=cells(events.where("user_id % 2 = 1 AND event_type = 'view'")))
    store.write_trace(root, "even", metrics=cells(events.where("user_id % 2 = 0")))
    cells(events).write.parquet(f"{root}/metrics/run_id=broken/attempt=none")
    return store.read_trace(spark, root, "metrics").select("run_id", "event_id", "value")


@query(
    """SELECT count(*) AS document_count, sum(strlen(text))::BIGINT AS total_bytes, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY md5(text) HAVING count(*) > 1)) AS repeated,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans FROM documents"""
)
def dataset_version(spark, d):
    docs = corpus(spark, d).withColumn("checksum", F.md5("content"))
    chunks = table(spark, d, "labels").withColumn("chunk_index", F.lit(0))
    totals = store.write_dataset(fresh_path(spark, "dataset"), "d", 1, docs, chunks)
    wrong = store.integrity(docs, chunks)
    counts = [wrong[k].agg(F.count(F.lit(1)).alias(n)) for k, n in (("repeated documents", "repeated"), ("orphan chunks", "orphans"))]
    return totals.select("document_count", "total_bytes").join(counts[0], how="cross").join(counts[1], how="cross")


@query("SELECT event_type AS metric, printf('%.6f', avg(value)) AS mean, printf('%.6f', max(value)) AS most, count(*)::VARCHAR AS n, '' AS nothing FROM events GROUP BY 1")
def csv_cells(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"))
    rows = rows.agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"), F.first(F.lit(None).cast("double")).alias("nothing"))
    return export.fixed_places(rows)


# filters and the relational layer


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def parts_in_list(spark, d):
    wanted = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return relational.among(table(spark, d, "lineitem"), wanted, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS upserted, c_mktsegment AS inserted FROM customer
    UNION ALL SELECT -1, 'new', 'new'"""
)
def upsert_by_key(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    fresh = rows.where("key % 3 = 0").select("key", F.lit("new").alias("value")).unionByName(spark.sql("SELECT -1L AS key, 'new' AS value"))
    one, two = relational.upsert(rows, fresh, "key"), relational.insert_missing(rows, fresh, "key")
    return one.withColumnRenamed("value", "upserted").join(two.withColumnRenamed("value", "inserted"), "key")


@query(
    """WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS supps FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
    SELECT o_orderkey AS query_run_id, coalesce(n, 0)::INTEGER AS subs, md5(array_to_string(coalesce(parts, []), ',')) AS retrieved_md5, md5(array_to_string(coalesce(supps, []), ',')) AS reranked_md5,
    o_custkey AS context, o_orderstatus AS answer, o_totalprice AS price FROM orders LEFT JOIN l ON l.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey"""
)
def evidence_trail_six(spark, d):
    """Orders as query runs, their lines as sub-queries, retrieved and reranked chunks, the rest as context, answer and metrics."""
    orders, lines = table(spark, d, "orders").withColumnRenamed("o_orderkey", "query_run_id"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "query_run_id")
    key = "query_run_id"
    trail = relational.evidence_trail(
        orders.select(key),
        key,
        transformed=lines.select(key, F.col("l_linenumber").alias("sequence_index"), F.col("l_returnflag").alias("sub_query")),
        retrieved=lines.select(key, F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("chunk_id")),
        reranked=lines.where("l_quantity > 25").select(key, F.col("l_linenumber").alias("reranked_rank"), F.col("l_suppkey").alias("chunk_id")),
        context=orders.select(key, F.col("o_custkey").alias("total_tokens")),
        generation=orders.select(key, F.col("o_orderstatus").alias("answer")),
        metrics=orders.select(key, F.lit("price").alias("metric"), F.col("o_totalprice").alias("value")),
    )
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x["chunk_id"].cast("string")), ","))
    return trail.select(
        key,
        F.size("transformed").alias("subs"),
        joined("retrieved").alias("retrieved_md5"),
        joined("reranked").alias("reranked_md5"),
        F.col("context.total_tokens").alias("context"),
        F.col("generation.answer").alias("answer"),
        F.col("metrics")["price"].alias("price"),
    )


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, props->>'$.k' AS k, count(*) AS n, round(epoch(max(ts) - min(ts)), 3) AS seconds FROM events GROUP BY ALL")
def json_and_time(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.get_json_object("props", "$.k").alias("k"), "ts")
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return rows.groupBy("hour", "k").agg(F.count(F.lit(1)).alias("n"), F.round(span, 3).alias("seconds"))


@query("SELECT doc_id, sha256(text || 'fi') AS checksum, 'doc_' || substr(sha256(text || 'fi'), 1, 16) AS name FROM documents")
def composed_checksums(spark, d):
    rows = corpus(spark, d).select("doc_id", hashing.checksum(F.concat("content", F.lit("ﬁ"))).alias("checksum"))
    return rows.withColumn("name", hashing.document_id(F.col("checksum")))


# embeddings and query transforms


@query(f"WITH {shingle_tables('SELECT item_id AS id, text FROM benchmark')} SELECT id AS item_id, idx::INTEGER AS idx, round(value, 6) AS value FROM em")
def provider_embedding(spark, d):
    encode = embed.provider("mock")
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(encode(F.col("text"))).alias("idx", "value"))
    return six(rows.where("value <> 0"))


@query(
    f"""WITH {shingle_tables('SELECT item_id AS id, text FROM benchmark')},
    ds AS (SELECT a.id AS query_id, b.id AS chunk, round(sum(a.value * b.value), 9) AS score FROM em a JOIN em b USING (idx) GROUP BY ALL)
    SELECT query_id, 'd' || chunk AS doc_id, round(score, 6) AS score FROM ds QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC) <= 3"""
)
def dense_retriever(spark, d):
    """The retriever of a dense point over the passages, one chunk each, with themselves as questions."""
    docs = table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("doc_id"), F.col("text").alias("content"))
    point = sweep.baseline({"chunking": {"chunk_size": 10_000}, "embedding": {"provider": "mock"}, "retrieval": {"mode": "dense"}})
    whole = runner.Corpus(docs, keep=lambda df: materialize(df, "dense"))
    found = runner.searcher(whole, point)(asked(spark, d), 3)
    return six(found.join(whole.chunks(point).select("chunk_id", "doc_id"), "chunk_id")).select("query_id", "doc_id", "score")


@query("SELECT item_id AS query_id, 0 AS sequence_index, text AS sub_query FROM benchmark")
def identity_transform(spark, d):
    return transforms.sub_queries(asked(spark, d), "identity").select("query_id", "sequence_index", "sub_query")


_GENERAL = f"regexp_replace('Mock response: ' || substr(text, 1, 60) || '...', '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


@query(f"SELECT item_id AS query_id, 0 AS sequence_index, {_GENERAL} AS sub_query FROM benchmark UNION ALL SELECT item_id, 1, text FROM benchmark")
def step_back_transform(spark, d):
    return transforms.sub_queries(asked(spark, d), "step_back", template=_OWN_PROMPT).select("query_id", "sequence_index", "sub_query")


@query(
    f"""WITH a AS (SELECT item_id, CASE WHEN contains(text, 'the') THEN 'one' || chr(10) || '2. two' || chr(10) || '- one' || chr(10) || text ELSE '' END AS r, text FROM benchmark WHERE NOT contains(text, chr(10)) AND text = trim(text))
    SELECT item_id AS query_id, i::INTEGER AS sequence_index, (CASE WHEN r = '' THEN [text] ELSE ['one', 'two', text] END)[i + 1] AS sub_query FROM a, range(3) t(i) WHERE r <> '' OR i = 0"""
)
def multi_query_transform(spark, d):
    """A model that answers with numbered, repeated and original queries, or with nothing."""
    model = lambda prompt: F.when(prompt.contains("the"), F.concat(F.lit("one\n2. two\n- one\n"), prompt)).otherwise(F.lit(""))
    questions = asked(spark, d).where("NOT contains(query, '\n') AND query = trim(query)")
    return transforms.sub_queries(questions, "multi_query", model, template=_OWN_PROMPT).select("query_id", "sequence_index", "sub_query")


@query("SELECT vec_id, label FROM embeddings WHERE label = 2 AND vec_id % 2 = 0")
def store_conditions(spark, d):
    rows = vectors(spark, d).withColumn("metadata", F.create_map(F.lit("half"), (F.col("vec_id") % 2).cast("string")))
    return rows.where(dense.store_filter({"label": 2, "half": 0}, top=("label",))).select("vec_id", "label")
