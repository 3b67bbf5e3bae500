"""The subpackage's queries by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, near_dedup, packing, pii, quality, secrets, sharding, topk, toxicity, trie, url_filter, whitening
from millrace.llm.common import documents
from millrace.storage import fresh_path, materialize


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = toxicity.remainder(F.col("doc_id")) == 0
    model = toxicity.fit(docs, labels, learn=~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


#: The rules of the URL query's contract; the file beside this module is its own list.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BLOCKED_SITES = Path(__file__).with_name("blocked_sites.txt")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, hidden=url_filter.rules_from(str(BLOCKED_SITES))).select("page_id", "host", "path", "rule", "verdict")


def span_list(spans: str, keep=None) -> Column:
    """``kind:start:end`` of each span that ``keep`` admits, comma-joined."""
    column = F.filter(spans, keep) if keep else F.col(spans)
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    found = materialize(secrets.scan(docs).drop("text"), "secret-spans")
    judged = secrets.judge(found, owner="source", repository="doc_id")
    base = lambda s: s["ord"] < secrets.N_BASE
    counts = [count_kind("spans", k[0]) for k in secrets.KINDS[: secrets.N_BASE]]
    return judged.select(
        "doc_id", *counts, F.sha2(span_list("spans", base), 256).alias("base_sha256"), span_list("spans").alias("spans"), "n_live", "n_copied", "most_owners", "most_repositories"
    )


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))


#: Arrivals of the shard query: more than a tier holds before it is merged.
ARRIVALS = 5


def op9_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in several versions of small shards, are compacted, and are read from the final version with the shard that holds them."""
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"))
    docs = documents(spark, sf_dir)
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    version = store.compact()
    store.vacuum()
    shards = [(s.name.rsplit("/", 1)[1], k, s.rows, s.bytes) for k, s in enumerate(sorted(store.shards(), key=lambda s: (s.born, s.name)))]
    listed = spark.createDataFrame(shards, "file string, shard_id long, shard_rows long, shard_bytes long")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = store.read().select("doc_id", name.alias("file"), F.md5("text").alias("text_md5"))
    return rows.join(listed, "file").select("doc_id", "text_md5", "shard_id", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    counts = [count_kind("pii", k) for k in pii.KINDS[:4]]
    base = F.sha2(span_list("pii", lambda s: s["base"]), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), span_list("pii").alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie.nodes(trie.shared_starts(trie.encode(turns)))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.label(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_source_mixing": op3_source_mixing,
        "op4_exact_topk": op4_exact_topk,
        "op5_url_filter": op5_url_filter,
        "op6_quality_rules": op6_quality_rules,
        "op7_secret_scan": op7_secret_scan,
        "op8_curve_packing": op8_curve_packing,
        "op9_shard_compaction": op9_shard_compaction,
        "op10_pii": op10_pii,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_exact_dedup": op13_exact_dedup,
        "pipeline": pipeline,
    }


_STOP = ", ".join(f"'{x}'" for s in quality.STOP_WORDS for x in (s, s.capitalize()))

_OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 7)) AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), p AS (
  SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS step FROM g WHERE c > 1
), rep AS (SELECT r, sum(step)::BIGINT AS n FROM p GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20
       AND word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2.5 AND 12
       AND n_symbols::DOUBLE / nullif(n_words, 0) <= 0.1
       AND n_stop::DOUBLE / nullif(n_words, 0) >= 0.02
       AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) <= 0.4
       AND n_stutter::DOUBLE / nullif(n_words, 0) <= 0.3
       AND n_words::DOUBLE / nullif(n_lines, 0) >= 1.5 AS kept
FROM b
"""


_OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / (1.0 / (1.0 + 4.0 * (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(size, 1)::DOUBLE)) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), c AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c
), g AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * max(level) OVER ()) AS target FROM l
), e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM g
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - (e.epochs * e.source_size)::DOUBLE AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, md5(k.t) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND ahead::DOUBLE + size::DOUBLE / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

_OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_RULES = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
_SITES = ", ".join(f"'{r}'" for r, _ in url_filter.rules_from(str(BLOCKED_SITES)))

_OP5 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_RULES}) AS t(rule, verdict)
), f AS (
  SELECT page_id, max_by(rule, length(rule) * 1000 + length(h)) AS rule, max_by(verdict, length(rule) * 1000 + length(h)) AS verdict
  FROM h, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), b AS (
  SELECT DISTINCT page_id FROM h, (SELECT unnest([{_SITES}]) AS site)
  WHERE (host || '/' = site OR ends_with(host || '/', '.' || site)) AND starts_with(path, '/')
)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN f USING (page_id) LEFT JOIN b USING (page_id)
"""


_OP12 = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS l FROM t GROUP BY c
), crc AS (
  SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda k: ascii(k)::BIGINT)),
    lambda a, k: list_reduce(list_prepend(xor(a, k), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM own
), b AS (
  SELECT k.c, list_concat(coalesce(o.l[1:k.h], []), k.l[k.h + 1:]) AS l FROM crc k LEFT JOIN own o ON o.c = k.c - k.c % 20
), p AS (
  SELECT c, d, l[1:d] AS path, d = len(l) AS ended, CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM b)
), n AS (
  SELECT d, path, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(CASE WHEN ended THEN c END::VARCHAR, ',' ORDER BY c), '')) AS ends
  FROM p GROUP BY d, path
), k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL
), u AS (
  SELECT x.path[1:x.a] AS path, x.a AS d, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum(x.saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) x LEFT JOIN k ON k.d = x.d AND k.path = x.path GROUP BY ALL
)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
       u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.path = n.path LEFT JOIN k ON k.d = n.d AND k.path = n.path
LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.path = n.path[1:n.d - 1]
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": _OP3, "op4_exact_topk": _OP4, "op5_url_filter": _OP5, "op6_quality_rules": _OP6, "op12_conversation_trie": _OP12, "op13_exact_dedup": _OP13}
