"""Queries of gold passages, answer metrics, paired tests, sweeps and whole runs; see ``queries``."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from millrace.functions.special import EXACT_UP_TO
from millrace.operators import chunking, metrics, qrels, relational, rerank, stats, transforms
from millrace.plans import config, runner, runs, sweep
from millrace.queries import _PAIRS, _SPACE, _entailed, _two_runs, asked, bm25_scores, bm25_tables, corpus, gold, query, ranked_metrics_sql, six, table, turns
from millrace.sources import export
from millrace.storage import fresh_path, materialize

# gold passages


def _gold(spark, d):
    """The passages; one in three knows its place, one in three its document, the rest nothing."""
    docs = corpus(spark, d)
    found = qrels.containment_matches(gold(spark, d), docs).groupBy("passage").agg(F.min("chunk_id").alias("doc_id"))
    rows = gold(spark, d).join(found, "passage").join(docs.select(F.col("chunk_id").alias("doc_id"), "content"), "doc_id")
    at = F.expr("locate(snippet, content)") - 1
    third = F.col("passage") % 3
    placed = (third == 0) & (at >= 0)
    return rows.select(
        "passage",
        F.col("passage").alias("query_id"),
        F.when(third == 2, F.lit("")).otherwise(F.col("doc_id")).alias("doc_id"),
        "snippet",
        F.when(placed, at).alias("start_char"),
        F.when(placed, at + F.length("snippet")).alias("end_char"),
    )


def _pieces(spark, d):
    made = chunking.fixed_windows(corpus(spark, d), 400, 50).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))
    return made.withColumn("doc_id", F.col("doc_id").cast("string"))


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[{_SPACE}]+', ' ', 'g'))"


def _words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def _grams(x: str) -> str:
    return f"list_transform(range(1, len(string_split({x}, ' ')) - 2), lambda i: array_to_string(string_split({x}, ' ')[i:i + 3], ' '))"


_GOLD = f"""w AS (
  SELECT doc_id, s AS start_char, regexp_replace(substr(text, s + 1, 400), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS content
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 350)) AS s FROM documents) WHERE (s = 0 OR s - 350 + 400 < length(text))
), c AS MATERIALIZED (SELECT *, doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1) AS chunk_id, {_squeezed('content')} AS sq, {_grams(_squeezed('content'))} AS cg, {_words('content')} AS cw FROM w WHERE content <> ''),
p0 AS MATERIALIZED (SELECT item_id AS passage, text AS snippet, {_squeezed('text')} AS s, {_grams(_squeezed('text'))} AS pg, {_words('text')} AS pw FROM benchmark),
t0 AS MATERIALIZED (SELECT doc_id, text, {_squeezed('text')} AS t FROM documents),
f AS (SELECT passage, min(doc_id::VARCHAR) AS doc FROM p0, t0 WHERE (s <> '' AND contains(t, s)) OR (length(t) > 15 AND contains(s, t)) GROUP BY 1),
g AS MATERIALIZED (SELECT passage, snippet, s, pg, pw, doc, strpos(text, snippet) - 1 AS a FROM f JOIN p0 USING (passage) JOIN t0 ON t0.doc_id::VARCHAR = doc)"""
_RULES = """((s <> '' AND contains(sq, s)) OR (length(sq) > 15 AND contains(s, sq)) OR list_has_any(pg, cg) OR len(list_intersect(pw, cw)) >= greatest(3, 0.5 * len(pw)))"""


@query(
    f"""WITH {_GOLD}, spans AS (SELECT passage, chunk_id FROM g JOIN c ON c.doc_id::VARCHAR = doc WHERE passage % 3 = 0 AND a >= 0
      AND least(a + length(snippet), start_char + length(content)) - greatest(a, start_char) > 0),
    texts AS (SELECT passage, chunk_id FROM g JOIN c ON c.doc_id::VARCHAR = doc WHERE (passage % 3 = 1 OR (passage % 3 = 0 AND a < 0)) AND {_RULES})
    SELECT DISTINCT passage AS query_id, passage, chunk_id FROM (SELECT * FROM spans UNION ALL SELECT * FROM texts)"""
)
def qrels_resolved(spark, d):
    return qrels.resolve(materialize(_gold(spark, d), "gold"), materialize(_pieces(spark, d), "pieces"))


@query(
    f"""WITH {_GOLD}, q AS (SELECT passage, CASE WHEN passage % 3 = 2 THEN 'zz' ELSE doc END AS doc FROM g),
    hit AS (SELECT passage, c.doc_id || ':' AS k, chunk_id FROM q JOIN c ON c.doc_id::VARCHAR = doc OR contains(chunk_id, doc))
    SELECT passage, count(*) AS n FROM (SELECT passage, chunk_id FROM hit UNION ALL SELECT passage, chunk_id FROM q, c WHERE passage NOT IN (SELECT passage FROM hit)) GROUP BY 1"""
)
def qrels_candidates(spark, d):
    """How many chunks the identifiers leave for each passage; those that name nothing known keep all."""
    named = _gold(spark, d).withColumn("doc_id", F.when(F.col("doc_id") == "", F.lit("zz")).otherwise(F.col("doc_id")))
    return qrels.candidates(materialize(named, "named"), materialize(_pieces(spark, d), "pieces")).groupBy("passage").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_GOLD}, m AS (SELECT passage, c.doc_id FROM g JOIN c ON {_RULES} WHERE passage % 3 = 2)
    SELECT passage, count(DISTINCT doc_id) AS documents FROM m GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"""
)
def qrels_ambiguous(spark, d):
    passages, pieces = materialize(_gold(spark, d), "gold"), materialize(_pieces(spark, d), "pieces")
    return qrels.ambiguous(qrels.resolve(passages, pieces, compat=True), passages, pieces)


@query("SELECT item_id AS passage, 'x' || item_id AS doc_id FROM benchmark WHERE item_id % 4 = 3")
def unknown_gold_documents(spark, d):
    """A passage names its document by id, by file name, by a part of that, or wrongly."""
    name, kind = F.col("passage").cast("string"), F.col("passage") % 4
    wanted = F.when(kind == 0, F.concat(F.lit("doc-"), name)).when(kind == 1, F.concat(F.lit("doc-"), name, F.lit(".txt"))).when(kind == 2, F.concat(F.lit("c-"), name, F.lit(".tx"))).otherwise(F.concat(F.lit("x"), name))
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    return qrels.unknown_documents(gold(spark, d).withColumn("doc_id", wanted), docs).select("passage", "doc_id")


# answers

_CITED = f"""t AS (SELECT a.conv_id * 1000 + a.turn AS query_id, replace(a.text, '.', ' [' || (a.turn % 3) || '].') AS answer, coalesce(u.text, '') AS context FROM conversations a
LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'),
s AS (SELECT query_id, context, unnest(x) AS sentence, unnest(range(len(x))) AS claim FROM (SELECT query_id, context, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?।॥])[{_SPACE}]+', '\\1' || chr(31), 'g'), chr(31)),
  lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x <> '') AS x FROM t)),
e AS (SELECT query_id, claim, context, regexp_replace(sentence, '(?i)\\[(?:Source\\s+)?([0-9]+)\\]', '', 'g') AS bare, unnest(list_concat(regexp_extract_all(sentence, '(?i)\\[(?:Source\\s+)?([0-9]+)\\]', 1), CASE WHEN regexp_matches(sentence, '(?i)\\[(?:Source\\s+)?([0-9]+)\\]') THEN [] ELSE [NULL] END))::INTEGER AS cited FROM s),
j AS (SELECT query_id, claim, cited, cited = 1 AND {_entailed('bare')} AS ok FROM e),
k AS (SELECT query_id, claim, count(cited) AS made, count(*) FILTER (ok) AS good FROM j GROUP BY ALL),
m AS (SELECT query_id, sum(made) AS citations, sum(good) AS valid, count(*) AS claims, count(*) FILTER (good > 0) AS cited FROM k GROUP BY 1)"""


@query(
    f"""WITH {_CITED} SELECT query_id, coalesce(citations, 0)::BIGINT AS citations, coalesce(valid, 0)::BIGINT AS valid, coalesce(claims, 0)::BIGINT AS claims, coalesce(cited, 0)::BIGINT AS cited,
    round(coalesce(valid / nullif(citations, 0)::DOUBLE, 0), 6) AS citation_precision, round(coalesce(cited / nullif(claims, 0)::DOUBLE, 0), 6) AS citation_recall FROM t LEFT JOIN m USING (query_id)"""
)
def citation_scores(spark, d):
    """Answers cite a source after each sentence; source 1 is the turn before, no other exists."""
    rows = turns(spark, d).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    mark = F.concat(F.lit(" ["), (F.col("turn") % 3).cast("string"), F.lit("]."))
    answers = rows.withColumn("answer", F.replace("answer", F.lit("."), mark))
    sources = rows.select("query_id", F.lit(1).alias("source_index"), F.col("context").alias("content"))
    return six(metrics.citation_metrics(answers, sources))


@query("SELECT conv_id, turn, contains(lower(text), 'the') AS supported FROM conversations WHERE role = 'assistant'")
def judged_by_model(spark, d):
    """A model as the judge of entailment; it answers YES where the statement holds a certain word."""
    model = lambda prompt: F.when(F.lower(F.substring_index(prompt, "Statement: ", -1)).rlike("(?s)the.*answer:"), F.lit(" Yes.")).otherwise(F.lit("no"))
    judged = metrics.judge("llm", model=model)
    return turns(spark, d).select("conv_id", "turn", judged(F.lit("nothing"), F.col("answer")).alias("supported"))


@query(
    f"""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 = 0),
    s AS (SELECT q.vec_id AS query_id, greatest(0, list_cosine_similarity(q.e, c.embedding::DOUBLE[])) AS x FROM q JOIN embeddings c ON c.vec_id IN (q.vec_id + 1, q.vec_id + 2, q.vec_id + 3))
    SELECT query_id, round(avg(x), 6) AS answer_relevance FROM s GROUP BY 1"""
)
def answer_relevance(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked_ = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    made = rows.where("vec_id % 10 BETWEEN 1 AND 3").select((F.col("vec_id") - F.col("vec_id") % 10).alias("query_id"), "embedding")
    made = made.groupBy("query_id").agg(F.collect_list("embedding").alias("question_vectors"))
    return six(metrics.answer_relevance(asked_.join(made, "query_id")))


@query(
    """WITH l AS (SELECT user_id AS query_id, count(*) * 2.0 AS total, CASE WHEN user_id % 2 = 0 THEN max(value) END AS rerank FROM events GROUP BY 1)
    SELECT query_id, 'total_latency_ms' AS metric, total::DOUBLE AS value FROM l UNION ALL SELECT query_id, 'reranking_latency_ms', rerank FROM l WHERE rerank IS NOT NULL"""
)
def latency_rows(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"))
    rows = rows.agg((F.count(F.lit(1)) * 2.0).alias("total_latency_ms"), F.max("value").alias("top"))
    none = F.lit(None).cast("double")
    return metrics.latency_metrics(rows.select("query_id", "total_latency_ms", none.alias("retrieval_latency_ms"), F.when(F.col("query_id") % 2 == 0, F.col("top")).alias("reranking_latency_ms"), none.alias("generation_latency_ms")))


# paired tests

_STEPS = 2000
#: Rank sums from 0 to that of all ranks of the longest exact test.
_SUMS = EXACT_UP_TO * (EXACT_UP_TO + 1) // 2 + 1


def _simpson(f, upper: str) -> str:
    """The integral of ``f`` (SQL of a variable's SQL) from 0 to ``upper``."""
    weight = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    x = f"(({upper}) * i / {_STEPS}.0::DOUBLE)"
    return f"(list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * {f(x)})) * ({upper}) / {3 * _STEPS}.0::DOUBLE)"


def _tail(t: str, df: str) -> str:
    """Two-tailed probability of Student's t, by the angle whose tangent is t over the root of df."""
    scale = f"exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt(pi())"
    return f"(1 - 2 * {scale} * {_simpson(lambda x: f'pow(cos({x}), {df} - 1)', f'atan(abs({t}) / sqrt({df}::DOUBLE))')})"


_TESTED = f"""{_PAIRS},
b AS MATERIALIZED (SELECT metric, count(*) AS n, count(*) - 1 AS nu, avg(a) AS mean_a, avg(b) AS mean_b, avg(difference) AS md, stddev_samp(difference) AS sd FROM pr GROUP BY 1),
z AS (SELECT metric, difference, round(abs(difference), 12) AS size FROM pr WHERE abs(difference) > 1e-12),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY size) + (count(*) OVER (PARTITION BY metric, size) - 1) / 2.0 AS place, count(*) OVER (PARTITION BY metric, size)::DOUBLE AS t FROM z),
v AS MATERIALIZED (SELECT metric, count(*)::DOUBLE AS k, count(DISTINCT size) AS levels, least(coalesce(sum(place) FILTER (difference > 0), 0), coalesce(sum(place) FILTER (difference < 0), 0))::DOUBLE AS w, sum(t * t - 1) AS ex FROM r GROUP BY 1),
bis AS (SELECT metric, nu, 0.0::DOUBLE AS lo, 16.0::DOUBLE AS hi, 0 AS step FROM b UNION ALL
  SELECT metric, nu, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, step + 1 FROM (SELECT *, {_tail('mid', 'nu')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE step < 45))),
crit AS (SELECT metric, hi AS t FROM bis WHERE step = 45),
ts AS MATERIALIZED (SELECT b.*, md / (sd / sqrt(n)) AS t_statistic, {_tail('md / (sd / sqrt(n))', 'nu')} AS p_value, md - crit.t * sd / sqrt(n) AS low, md + crit.t * sd / sqrt(n) AS high, w,
  k, CASE WHEN k <= {EXACT_UP_TO} AND levels = k THEN 'exact' ELSE 'asymptotic' END AS wilcoxon_method, greatest(0, abs(w - k * (k + 1) / 4) - 0.5) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - ex / 48) AS zs FROM b JOIN crit USING (metric) JOIN v USING (metric)),
wy AS (SELECT 0 AS n, list_transform(range(0, {_SUMS}), lambda i: CASE WHEN i = 0 THEN 1 ELSE 0 END::BIGINT) AS ways UNION ALL
  SELECT n + 1, list_transform(range(0, {_SUMS}), lambda i: ways[i + 1] + CASE WHEN i > n THEN ways[i - n] ELSE 0 END) FROM wy WHERE n < {EXACT_UP_TO}),
wp AS MATERIALIZED (SELECT ts.*, CASE WHEN wilcoxon_method = 'exact' THEN least(1, 2 * list_sum(ways[1:floor(w)::BIGINT + 1]) / pow(2, k))
  ELSE 1 - 2 / sqrt(2 * pi()) * {_simpson(lambda x: f'exp(-{x} * {x} / 2)', 'zs')} END AS wilcoxon_p FROM ts LEFT JOIN wy ON wy.n = ts.k),
hm AS (SELECT *, least(1, max(p_value * (m - r + 1)) OVER (ORDER BY p_value, metric ROWS UNBOUNDED PRECEDING)) AS adjusted_p FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, metric) AS r FROM wp))"""


@query(
    f"""WITH RECURSIVE {_TESTED} SELECT metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(md, 6) AS mean_difference, round(sd, 6) AS std_difference, nu AS t_df,
    round(t_statistic, 6) AS t_statistic, round(md / sd, 6) AS cohens_dz, round(low, 6) AS ci95_lower, round(high, 6) AS ci95_upper, round(p_value, 6) AS p_value, w AS wilcoxon_statistic,
    round(wilcoxon_p, 6) AS wilcoxon_p, wilcoxon_method, round(adjusted_p, 6) AS adjusted_p, 'holm' AS adjustment,
    CASE WHEN adjusted_p < 0.001 THEN '***' WHEN adjusted_p < 0.01 THEN '**' WHEN adjusted_p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM hm"""
)
def paired_tests(spark, d):
    return six(stats.compare(*_two_runs(spark, d), unit="user_id"))


@query(
    f"""WITH RECURSIVE {_TESTED} SELECT metric, round(mean_a, 6) AS mean_run_a, round(mean_b, 6) AS mean_run_b, round(md, 6) AS mean_difference, round(low, 6) AS ci95_lower, round(p_value, 6) AS raw_p_value,
    round(wilcoxon_p, 6) AS wilcoxon_pvalue, 'none' AS adjustment_method, n AS n_paired FROM hm"""
)
def summary_table(spark, d):
    rows = export.summary_rows(stats.compare(*_two_runs(spark, d), correction="none", unit="user_id"))
    return six(rows).select("metric", "mean_run_a", "mean_run_b", "mean_difference", "ci95_lower", "raw_p_value", "wilcoxon_pvalue", "adjustment_method", "n_paired")


@query(f"WITH {_PAIRS} SELECT metric, user_id AS query_id, round(a, 6) AS score_run_a, round(b, 6) AS score_run_b, round(difference, 6) AS difference FROM pr")
def raw_pairs(spark, d):
    a, b = _two_runs(spark, d)
    return six(export.raw_pairs(stats.paired(a, b, "user_id"), "user_id"))


def _attenuated(x: str, y: str) -> str:
    """Penalties of dense (view against the type) and hybrid (purchase against the type) runs."""
    return f"(SELECT avg(a.v - b.v) AS p FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = '{x}' GROUP BY 1) a JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = '{y}' GROUP BY 1) b USING (user_id))"


def _one_run(spark, d, kind):
    rows = table(spark, d, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("value"))
    return rows.select(F.lit("recall@5").alias("metric"), "user_id", "value")


@query(
    f"""SELECT 'recall@5' AS metric, round_even(x.p, 6) AS dense, round_even(y.p, 6) AS hybrid, round(round_even(x.p, 6) - round_even(y.p, 6), 6) AS attenuation,
    CASE WHEN round_even(x.p, 6) - round_even(y.p, 6) > 0 THEN 'Attenuated' ELSE 'Not attenuated' END AS verdict FROM {_attenuated('view', 'click')} x, {_attenuated('purchase', 'signup')} y"""
)
def hybrid_attenuation(spark, d):
    dense, hybrid = (stats.transfer(_one_run(spark, d, a), _one_run(spark, d, b), "user_id") for a, b in (("view", "click"), ("purchase", "signup")))
    return six(stats.attenuation(dense, hybrid))


@query(
    """SELECT h, penalty, p, (CASE WHEN penalty > 0 AND p < 0.05 THEN 'SUPPORTED' WHEN h = 'H2' THEN 'NOT SUPPORTED (Gain)' ELSE 'NOT SUPPORTED (Worse)' END) || ', ' ||
    CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END AS verdict FROM (SELECT 'H' || (event_id % 4 + 1) AS h, value - 25 AS penalty, (event_id % 128) / 1000.0::DOUBLE AS p FROM events)"""
)
def hypothesis_verdicts(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("H"), (F.col("event_id") % 4 + 1).cast("string")).alias("h"), (F.col("value") - 25).alias("penalty"), ((F.col("event_id") % 128) / 1000.0).alias("p"))
    return rows.withColumn("verdict", stats.hypothesis_verdict(F.col("h"), F.col("penalty"), F.col("p")))


@query(
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id % 7 <> 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id % 5 <> 0)
    SELECT 'common' AS part, user_id FROM a JOIN b USING (user_id) UNION ALL SELECT 'only_a', user_id FROM a WHERE user_id NOT IN (FROM b) UNION ALL SELECT 'only_b', user_id FROM b WHERE user_id NOT IN (FROM a)"""
)
def aligned_units(spark, d):
    events = table(spark, d, "events")
    a, b = events.where("event_type = 'view' AND user_id % 7 <> 0"), events.where("event_type = 'click' AND user_id % 5 <> 0")
    same = {"dataset_version": 1, "content_hash": "x", "k": 5}
    parts = stats.align(same, same | {"dataset_version": 2}, a, b, partial=True, unit="user_id")
    rows = [df.select(F.lit(name).alias("part"), "user_id") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# sweeps

_COMPONENTS = {
    "chunking": {"chunk_size": [200, 400, 800], "chunk_overlap": 20},
    "retrieval": {"mode": ["dense", "bm25", "hybrid"], "top_k": [5, 10]},
    "reranker": {"enabled": [False, True], "strategy": "mock", "top_n": 5},
}
_GRID = """g AS (SELECT (a * 12 + b * 4 + c * 2 + e)::BIGINT AS index, [200, 400, 800][a + 1]::INTEGER AS chunk_size, ['dense', 'bm25', 'hybrid'][b + 1] AS mode, [5, 10][c + 1]::INTEGER AS top_k, e = 1 AS enabled
    FROM range(3) x(a), range(3) y(b), range(2) z(c), range(2) w(e))"""


def _plan(spark):
    plan = config.Experiment("s", "docs", "1", components=_COMPONENTS)
    rows = sweep.dry_run(plan, "v1", 40, "bench")
    return spark.createDataFrame(
        [(r["index"], r["config_hash"], r["cache_hash"], json.dumps(r["difference"], sort_keys=True, separators=(",", ":")), r["topology"], "; ".join(r["warnings"]), r["queries"]) for r in rows],
        "index long, config_hash string, cache_hash string, difference string, topology string, warnings string, queries long",
    )


@query(f"WITH {_GRID} SELECT index, chunk_size, mode, top_k, enabled FROM g")
def sweep_points(spark, d):
    rows = [(i, p.chunking.chunk_size, p.retrieval.mode, p.retrieval.top_k, p.reranker.enabled) for i, p in enumerate(sweep.expand(_COMPONENTS))]
    return spark.createDataFrame(rows, "index long, chunk_size int, mode string, top_k int, enabled boolean")


@query(
    f"""WITH {_GRID} SELECT index, mode || CASE WHEN enabled THEN '_reranked' ELSE '' END AS topology, '' AS warnings, 40::BIGINT AS queries,
    '{{' || array_to_string(list_filter([CASE WHEN chunk_size <> 200 THEN '"chunking.chunk_size":' || chunk_size END, CASE WHEN enabled THEN '"reranker.enabled":true' END,
      CASE WHEN mode <> 'dense' THEN '"retrieval.mode":"' || mode || '"' END, CASE WHEN top_k <> 5 THEN '"retrieval.top_k":' || top_k END], lambda x: x IS NOT NULL), ',') || '}}' AS difference,
    36::BIGINT AS distinct_configs FROM g"""
)
def sweep_dry_run(spark, d):
    plan = _plan(spark)
    n = plan.agg(F.count_distinct("config_hash", "cache_hash").alias("distinct_configs"))
    return plan.select("index", "topology", "warnings", "queries", "difference").join(n, how="cross")


@query(f"WITH {_GRID} SELECT index, sha256(string_agg('{{\"i\":' || index || '}}', '' ORDER BY index) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING)) AS chain FROM g")
def sweep_order(spark, d):
    """The points of a plan stay in the order of the grid: a hash over all indices so far."""
    plan = relational.page(_plan(spark), "index", limit=1000)
    from pyspark.sql import Window

    so_far = F.collect_list(F.concat(F.lit('{"i":'), F.col("index").cast("string"), F.lit("}"))).over(Window.partitionBy(F.lit(0)).orderBy("index"))
    return plan.select("index", F.sha2(F.array_join(so_far, ""), 256).alias("chain"))


@query(
    f"""WITH {_GRID}, p AS (SELECT a.index AS one, b.index AS two, a, b FROM g a, g b WHERE a.index < 6 AND b.index = 35 - a.index)
    SELECT one, two, (a.chunk_size <> b.chunk_size)::INTEGER + (a.mode <> b.mode)::INTEGER + (a.top_k <> b.top_k)::INTEGER + (a.enabled <> b.enabled)::INTEGER AS fields,
    CASE WHEN a.chunk_size <> b.chunk_size THEN a.chunk_size || '>' || b.chunk_size END AS size_change FROM p"""
)
def sweep_differences(spark, d):
    points = sweep.expand(_COMPONENTS)
    rows = []
    for i in range(6):
        found = sweep.pairwise_difference(points[i], points[35 - i])
        rows.append((i, 35 - i, len(found), next((f"{a}>{b}" for c, n, a, b in found if n == "chunk_size"), None)))
    return spark.createDataFrame(rows, "one long, two long, fields int, size_change string")


@query(
    """SELECT * FROM (VALUES ('total', '54'), ('size', 'HEAVY'), ('samples', '10'), ('last sample', '200 dense 5 0 c'), ('errors', 'chunking.chunk_overlap must be at least 0 and less than chunk_size; reranker.top_n must not exceed retrieval.top_k'),
    ('warnings', 'multi_query with fewer than two queries expands nothing'), ('skipped', '2'), ('yaml points', '36')) t(name, value)"""
)
def sweep_checks(spark, d):
    """Preview, validation and the written form of sweeps."""
    import yaml

    shown = sweep.preview({"size": [200, 400, 800], "mode": ["dense", "bm25", "hybrid"], "k": [5, 10], "r": [0], "x": ["a", "b", "c"]})
    odd = {"chunking": {"chunk_size": [10, 100], "chunk_overlap": 50}, "reranker": {"enabled": True, "top_n": [3, 50]}, "query_transform": {"strategy": "multi_query", "num_queries": 1}}
    start = sweep.baseline(odd)
    every = [config.with_values(start, {("chunking", "chunk_size"): s, ("reranker", "top_n"): n}) for s in (10, 100) for n in (3, 50)]
    wrong, warned = sweep.validate(every)
    loaded = config.experiment(yaml.safe_load(sweep.to_yaml("n", "d", "1", _COMPONENTS)))
    rows = {
        "total": shown["total"],
        "size": shown["size"],
        "samples": len(shown["samples"]),
        "last sample": " ".join(map(str, shown["samples"][2].values())),
        "errors": "; ".join(wrong),
        "warnings": "; ".join(warned),
        "skipped": len(every) - len(sweep.expand({"chunking": {"chunk_size": [10, 100], "chunk_overlap": 50}}, skip_invalid=True)) - 1,
        "yaml points": len(sweep.expand(loaded.components)),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


_SIGNED = "'dataset_id:d|dataset_version:' || o_orderpriority || '|content_hash:|benchmark_hash:|query_set_hash:|chunking:|embedding_provider:|embedding_model:|reranker:|top_k:' || k || '|metric_version:|protocol_version:|seed:42'"


@query(f"SELECT o_orderpriority AS version, k, sha256({_SIGNED}) AS signature FROM (SELECT DISTINCT o_orderpriority, unnest([5, 10]) AS k FROM orders)")
def control_signatures(spark, d):
    versions = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset_version")).distinct()
    runs_ = versions.withColumn("top_k", F.explode(F.array(F.lit(5), F.lit(10))))
    signed = sweep.signatures(runs_, dataset_id="d", seed=42)
    return signed.select(F.col("dataset_version").alias("version"), F.col("top_k").alias("k"), "signature")


@query(
    f"""WITH {_GRID} SELECT index, mode || CASE WHEN enabled THEN '_reranked' ELSE '' END AS topology, '' AS warnings, 40::BIGINT AS queries,
    '{{' || array_to_string(list_filter([CASE WHEN chunk_size <> 200 THEN '"chunking.chunk_size":' || chunk_size END, CASE WHEN enabled THEN '"reranker.enabled":true' END,
      CASE WHEN mode <> 'dense' THEN '"retrieval.mode":"' || mode || '"' END, CASE WHEN top_k <> 5 THEN '"retrieval.top_k":' || top_k END], lambda x: x IS NOT NULL), ',') || '}}' AS difference,
    36::BIGINT AS distinct_configs FROM g"""
)
def sweep_dry_run(spark, d):
    plan = _plan(spark)
    n = plan.agg(F.count_distinct("config_hash", "cache_hash").alias("distinct_configs"))
    return plan.select("index", "topology", "warnings", "queries", "difference").join(n, how="cross")


@query(f"WITH {_GRID} SELECT index, sha256(string_agg('{{\"i\":' || index || '}}', '' ORDER BY index) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING)) AS chain FROM g")
def sweep_order(spark, d):
    """The points of a plan stay in the order of the grid: a hash over all indices so far."""
    plan = relational.page(_plan(spark), "index", limit=1000)
    from pyspark.sql import Window

    so_far = F.collect_list(F.concat(F.lit('{"i":'), F.col("index").cast("string"), F.lit("}"))).over(Window.partitionBy(F.lit(0)).orderBy("index"))
    return plan.select("index", F.sha2(F.array_join(so_far, ""), 256).alias("chain"))


@query(
    f"""WITH {_GRID}, p AS (SELECT a.index AS one, b.index AS two, a, b FROM g a, g b WHERE a.index < 6 AND b.index = 35 - a.index)
    SELECT one, two, (a.chunk_size <> b.chunk_size)::INTEGER + (a.mode <> b.mode)::INTEGER + (a.top_k <> b.top_k)::INTEGER + (a.enabled <> b.enabled)::INTEGER AS fields,
    CASE WHEN a.chunk_size <> b.chunk_size THEN a.chunk_size || '>' || b.chunk_size END AS size_change FROM p"""
)
def sweep_differences(spark, d):
    points = sweep.expand(_COMPONENTS)
    rows = []
    for i in range(6):
        found = sweep.pairwise_difference(points[i], points[35 - i])
        rows.append((i, 35 - i, len(found), next((f"{a}>{b}" for c, n, a, b in found if n == "chunk_size"), None)))
    return spark.createDataFrame(rows, "one long, two long, fields int, size_change string")


@query(
    """SELECT * FROM (VALUES ('total', '54'), ('size', 'HEAVY'), ('samples', '10'), ('last sample', '200 dense 5 0 c'), ('errors', 'chunking.chunk_overlap must be at least 0 and less than chunk_size; reranker.top_n must not exceed retrieval.top_k'),
    ('warnings', 'multi_query with fewer than two queries expands nothing'), ('skipped', '2'), ('yaml points', '36')) t(name, value)"""
)
def sweep_checks(spark, d):
    """Preview, validation and the written form of sweeps."""
    import yaml

    shown = sweep.preview({"size": [200, 400, 800], "mode": ["dense", "bm25", "hybrid"], "k": [5, 10], "r": [0], "x": ["a", "b", "c"]})
    odd = {"chunking": {"chunk_size": [10, 100], "chunk_overlap": 50}, "reranker": {"enabled": True, "top_n": [3, 50]}, "query_transform": {"strategy": "multi_query", "num_queries": 1}}
    start = sweep.baseline(odd)
    every = [config.with_values(start, {("chunking", "chunk_size"): s, ("reranker", "top_n"): n}) for s in (10, 100) for n in (3, 50)]
    wrong, warned = sweep.validate(every)
    loaded = config.experiment(yaml.safe_load(sweep.to_yaml("n", "d", "1", _COMPONENTS)))
    rows = {
        "total": shown["total"],
        "size": shown["size"],
        "samples": len(shown["samples"]),
        "last sample": " ".join(map(str, shown["samples"][2].values())),
        "errors": "; ".join(wrong),
        "warnings": "; ".join(warned),
        "skipped": len(every) - len(sweep.expand({"chunking": {"chunk_size": [10, 100], "chunk_overlap": 50}}, skip_invalid=True)) - 1,
        "yaml points": len(sweep.expand(loaded.components)),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


_SIGNED = "'dataset_id:d|dataset_version:' || o_orderpriority || '|content_hash:|benchmark_hash:|query_set_hash:|chunking:|embedding_provider:|embedding_model:|reranker:|top_k:' || k || '|metric_version:|protocol_version:|seed:42'"


@query(f"SELECT o_orderpriority AS version, k, sha256({_SIGNED}) AS signature FROM (SELECT DISTINCT o_orderpriority, unnest([5, 10]) AS k FROM orders)")
def control_signatures(spark, d):
    versions = [r[0] for r in table(spark, d, "orders").select("o_orderpriority").distinct().collect()]
    rows = [(v, k, sweep.signature({"dataset_id": "d", "dataset_version": v, "top_k": k, "seed": 42})["signature_hash"]) for v in versions for k in (5, 10)]
    return spark.createDataFrame(rows, "version string, k int, signature string")


@query(
    f"""WITH {_GRID} SELECT index, mode || CASE WHEN enabled THEN '_reranked' ELSE '' END AS topology FROM g UNION ALL SELECT -1, 'bm25_reranked'"""
)
def topologies(spark, d):
    points = [(i, rerank.topology(p.retrieval.mode, p.reranker.enabled)) for i, p in enumerate(sweep.expand(_COMPONENTS))]
    return spark.createDataFrame([*points, (-1, rerank.topology(" Sparse", True))], "index long, topology string")


# whole runs

_SWEPT = {"chunking": {"chunk_size": [120, 300], "chunk_overlap": 0}, "retrieval": {"mode": "bm25", "top_k": 5}, "evaluation": {"metrics": ["recall", "mrr", "ndcg"], "k_values": [1, 5]}}


def _swept_sql(size: int) -> str:
    chunks = f"""SELECT 'd' || item_id || ':' || (row_number() OVER (PARTITION BY item_id ORDER BY s) - 1) AS chunk_id, x AS text FROM (
      SELECT item_id, s, regexp_replace(substr(text, s + 1, {size}), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS x FROM (SELECT item_id, text, unnest(range(0, length(text), {size})) AS s FROM benchmark)) WHERE x <> ''"""
    return f"""SELECT * FROM (WITH {bm25_tables(chunks)}, {bm25_scores('SELECT item_id AS query_id, text FROM benchmark')},
    top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5),
    rel AS (SELECT item_id AS query_id, chunk_id, 1 AS gain FROM benchmark JOIN ch ON split_part(chunk_id, ':', 1) = 'd' || item_id), qs AS (SELECT item_id AS query_id, unnest([1, 5]) AS k FROM benchmark)
    {ranked_metrics_sql()})"""


_SWEEP_SQL = (
    "SELECT chunk_size, metric, round(avg(value), 4) AS mean, count(*) AS n FROM (UNPIVOT ("
    + " UNION ALL ".join(f"SELECT {s} AS chunk_size, query_id, k, recall, mrr, ndcg FROM ({_swept_sql(s)})" for s in (120, 300))
    + ") ON recall, mrr, ndcg INTO NAME m VALUE value) u, LATERAL (SELECT m || '@' || k AS metric) GROUP BY ALL"
)


def _sweep(spark, d, **options):
    """A sweep of two points over the passages as documents, run end to end: each passage should find its own chunks."""
    docs = table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("doc_id"), F.col("text").alias("content"))
    passages = asked(spark, d).select(
        F.col("query_id").alias("passage"), "query_id", F.concat(F.lit("d"), F.col("query_id").cast("string")).alias("doc_id"), F.col("query").alias("snippet"), F.lit(0).alias("start_char"), F.length("query").alias("end_char")
    )
    # equal scores go to the lesser chunk_id, so the ids that SQL can make stand in for hashes
    whole = runner.Corpus(docs, keep=lambda df: materialize(df, "sweep"))
    points = sweep.expand(_SWEPT)
    for point in points:
        made = chunking.chunk(docs, "fixed", size=point.chunking.chunk_size, overlap=0)
        whole.made[runner.chunk_key(point)] = materialize(made.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index")), "sweep")
    results = runner.run_matrix(spark, config.Experiment("sweep", "passages", "1", components=_SWEPT), whole, asked(spark, d), passages, **options)
    if bad := [r.error for r in results if r.status != "COMPLETED"]:
        raise RuntimeError("; ".join(bad))
    return points, results


@query(_SWEEP_SQL)
def experiment_sweep(spark, d):
    points, results = _sweep(spark, d)
    rows = [(p.chunking.chunk_size, m, round(v, 4), r.completed) for p, r in zip(points, results, strict=True) for m, v in r.means.items() if m.split("@")[0] in ("recall", "mrr", "ndcg")]
    return spark.createDataFrame(rows, "chunk_size int, metric string, mean double, n long")


@query(_SWEEP_SQL)
def shared_runs(spark, d):
    """The same sweep, both points at once, read back from the table of runs that another sweep would share."""
    stored = runs.RunTable(spark, fresh_path(spark, "runs"))
    points, results = _sweep(spark, d, runs=stored, concurrent=2)
    sizes = spark.createDataFrame([(r.cache_hash, p.chunking.chunk_size) for p, r in zip(points, results, strict=True)], "cache_hash string, chunk_size int")
    done = relational.cached_runs(stored.table()).join(sizes, "cache_hash")
    rows = done.select("chunk_size", F.explode("means").alias("metric", "mean"), F.col("completed").cast("long").alias("n"))
    return rows.where(F.split("metric", "@")[0].isin("recall", "mrr", "ndcg")).select("chunk_size", "metric", F.round("mean", 4).alias("mean"), "n")


@query("SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN query_id % 5 = 0 THEN 'the model gave no answer' END AS error, query_id % 5 <> 0 AS measured FROM (SELECT item_id AS query_id FROM benchmark)")
def run_with_failures(spark, d):
    """One run whose model is silent for some questions: they fail, the others are measured."""
    docs = table(spark, d, "benchmark").select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("doc_id"), F.col("text").alias("content"))
    questions = asked(spark, d)
    silent = [f"Question: {r['query']}" for r in questions.where("query_id % 5 = 0").collect()]
    model = transforms.canned()
    answer = lambda prompt: F.when(F.exists(F.array(*map(F.lit, silent)), lambda q: prompt.contains(q)), F.lit(None).cast("string")).otherwise(model(prompt))
    passages = questions.select(F.col("query_id").alias("passage"), "query_id", F.concat(F.lit("d"), F.col("query_id").cast("string")).alias("doc_id"), F.col("query").alias("snippet"), F.lit(0).alias("start_char"), F.lit(5).alias("end_char"))
    point = sweep.baseline({"chunking": {"chunk_size": 500, "chunk_overlap": 0}, "retrieval": {"mode": "bm25", "top_k": 3}, "evaluation": {"metrics": ["recall"], "k_values": [3]}, "context": {"token_budget": 4000}})
    stages = runner.run_stages(runner.Corpus(docs), questions, passages, point, answer)
    measured = stages["metrics"].select("query_id").distinct().withColumn("m", F.lit(True))
    return stages["query_runs"].join(measured, "query_id", "left").select("query_id", "status", "error", F.coalesce("m", F.lit(False)).alias("measured"))
