"""Running experiments: a point's stages as set-at-a-time plans over all queries, a sweep as a loop over points.

A run's stages are DataFrames that the caller may write as traces; nothing is collected but statuses and the few
summary rows.  Points that share chunks share one lexical index.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import wraps

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.functions.hashing import cache_hash, canonical
from millrace.operators import chunking, context, dense, embed, fusion, lexical, metrics, qrels, rerank, stats, transforms
from millrace.plans.config import CHOICES, Experiment, Pipeline
from millrace.plans.runs import RunTable
from millrace.plans.sweep import expand
from millrace.storage import materialize


def chunk_key(point: Pipeline) -> tuple[str, str]:
    """The name of a point's chunks among what a corpus has made."""
    return "chunks", canonical([asdict(point.chunking), point.context.encoding_name])


def _alone(make):
    """A method that points running side by side call one after another, so that they share what it makes."""

    @wraps(make)
    def run(self, point: Pipeline):
        with self.lock:
            return make(self, point)

    return run


@dataclass
class Corpus:
    """Documents (doc_id, content), or chunks already cut (chunk_id, doc_id, content); caches indexes by chunking and model."""

    documents: DataFrame
    version: str = ""
    keep: Callable[[DataFrame], DataFrame] = field(default=lambda df: materialize(df, "run"))
    made: dict = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    @_alone
    def chunks(self, point: Pipeline) -> DataFrame:
        c = point.chunking
        key = chunk_key(point)
        if key not in self.made:
            options = {"size": c.chunk_size, "overlap": c.chunk_overlap}
            if c.strategy == "semantic":
                options = {"threshold": c.similarity_threshold, "most": c.chunk_size}
            known = bpe.named(point.context.encoding_name)
            if known:
                options |= {"codec": known} if c.strategy == "fixed" else {"tokens": known}
            cut = chunking.chunk(self.documents, c.strategy, **options)
            self.made[key] = self.keep(chunking.with_ids(cut))
        return self.made[key]

    @_alone
    def index(self, point: Pipeline) -> lexical.Index:
        key = ("index", canonical([asdict(point.chunking), point.context.encoding_name]))
        if key not in self.made:
            self.made[key] = lexical.index(self.chunks(point), keep=self.keep)
        return self.made[key]

    @_alone
    def vectors(self, point: Pipeline) -> DataFrame:
        key = ("vectors", canonical([asdict(point.chunking), asdict(point.embedding), point.context.encoding_name]))
        if key not in self.made:
            encode = _encoder(point)
            self.made[key] = self.keep(self.chunks(point).withColumn("embedding", encode(F.col("content"))).select("chunk_id", "embedding"))
        return self.made[key]


def _encoder(point: Pipeline):
    e = point.embedding
    return embed.provider(e.provider, model_name=e.model_name, dimension=e.dimension, batch_size=e.batch_size)


#: From (queries, k) to rankings.
Retriever = Callable[[DataFrame, int], DataFrame]
_RETRIEVERS: dict[str, Callable[[Corpus, Pipeline], Retriever]] = {}


def register_retriever(*names: str):
    """Add a retrieval mode: a function from a corpus and a point to its retriever."""

    def add(factory):
        _RETRIEVERS.update(dict.fromkeys(names, factory))
        CHOICES[("retrieval", "mode")] = tuple(dict.fromkeys([*CHOICES[("retrieval", "mode")], *names]))
        return factory

    return add


@register_retriever("bm25")
def lexical_retriever(corpus: Corpus, point: Pipeline) -> Retriever:
    return lambda queries, k: lexical.search(queries, corpus.chunks(point), corpus.index(point), k)


@register_retriever("dense")
def dense_retriever(corpus: Corpus, point: Pipeline) -> Retriever:
    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = queries.withColumn("embedding", _encoder(point)(F.col("query")))
        return dense.search(asked.select("query_id", "embedding"), corpus.vectors(point), k)

    return search


@register_retriever("hybrid")
def hybrid_retriever(corpus: Corpus, point: Pipeline) -> Retriever:
    both = dense_retriever(corpus, point), lexical_retriever(corpus, point)
    r = point.retrieval

    def search(queries: DataFrame, k: int) -> DataFrame:
        n = fusion.candidates(k)
        return fusion.hybrid(*(one(queries, n) for one in both), k, r.hybrid_fusion, r.rrf_k, r.dense_weight)

    return search


def searcher(corpus: Corpus, point: Pipeline) -> Retriever:
    """The retriever of a point."""
    return _RETRIEVERS[point.retrieval.mode](corpus, point)


class _Clock:
    """Wall-clock milliseconds of stages.  A batch engine runs a stage for all queries at once, so each is given an equal share."""

    def __init__(self):
        self.spent: dict[str, float] = {}

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        out = make()
        self.spent[name] = self.spent.get(name, 0.0) + (time.monotonic() - began) * 1000
        return out

    def durations(self, queries: DataFrame, n: int) -> DataFrame:
        share = {k: v / max(n, 1) for k, v in self.spent.items()} | {"total": sum(self.spent.values()) / max(n, 1)}
        names = ("total", "retrieval", "reranking", "generation")
        return queries.select("query_id", *(F.lit(share.get(k)).cast("double").alias(f"{k}_latency_ms") for k in names))


def run_stages(
    corpus: Corpus,
    queries: DataFrame,
    passages: DataFrame,
    point: Pipeline,
    model: transforms.Model | None = None,
    compat: bool = False,
    reranker=None,
    judge: metrics.Judge | None = None,
) -> dict[str, DataFrame]:
    """Every stage of a point: transformed, retrieved, reranked, context, generation, query_runs, metrics (long), summary.

    ``queries`` has query_id and query; ``passages`` as ``sources.readers.passages`` gives them.  A query whose context
    breaks its budget, or to which the model gives no answer, is FAILED in ``query_runs`` with the reason; its metrics
    are left out and the others go on.
    """
    model = model or transforms.canned()
    keep, chunks, clock = corpus.keep, corpus.chunks(point), _Clock()
    gold = keep(qrels.resolve(passages, chunks, compat))
    t = point.query_transform
    subs = keep(transforms.sub_queries(queries.select("query_id", "query"), t.strategy, model, t.num_queries, t.include_original, t.prompt_template))
    depth = max(point.retrieval.top_k, fusion.FIRST) if point.reranker.enabled else point.retrieval.top_k
    retrieved = clock("retrieval", lambda: keep(transforms.retrieve(subs, searcher(corpus, point), depth, point.retrieval.rrf_k)))
    final, out = retrieved, {"transformed": subs, "retrieved": retrieved}
    if point.reranker.enabled:
        texts = retrieved.join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
        name, top = point.reranker.strategy, point.reranker.top_n
        if reranker is not None:
            ranked = rerank.by_model(texts, top, reranker)
        elif name == "flashrank":
            ranked = rerank.by_model(texts, top, rerank.flashrank(point.reranker.model_name))
        elif name == "cross_encoder":
            ranked = rerank.by_model(texts, top, rerank.cross_encoder(point.reranker.model_name), descending_ids=True)
        else:
            ranked = rerank.by_overlap(texts, top)
        final = out["reranked"] = clock("reranking", lambda: keep(ranked.drop("query", "content")))
    candidates = final.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    c, known = point.context, bpe.named(point.context.encoding_name)
    packed = out["context"] = clock("packing", lambda: keep(context.pack(queries, candidates, c.token_budget, c.reorder_strategy, encoding=known)))
    answered = out["generation"] = clock("generation", lambda: keep(context.generate(packed.select("query_id", "text"), queries, model, encoding=known)))
    answers = answered.select("query_id", F.col("answer").isNull().alias("silent"))
    wrong = F.coalesce(context.over_budget(F.col("total_tokens"), c.token_budget), F.when(F.col("silent"), F.lit("the model gave no answer")))
    runs = packed.select("query_id", "total_tokens").join(answers, "query_id").select("query_id", wrong.alias("error"))
    runs = out["query_runs"] = keep(runs.withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")))
    good = runs.where("status = 'SUCCESS'").select("query_id")
    fine = queries.join(good, "query_id", "left_semi")
    measured = _metrics(fine, candidates, gold, passages, answered.join(good, "query_id", "left_semi"), packed, point, model, judge)
    measured = measured.unionByName(metrics.latency_metrics(clock.durations(fine, runs.count())))
    out["metrics"] = keep(measured)
    out["summary"] = stats.summary(out["metrics"], "metric")
    return out


def _metrics(queries, ranked, gold, passages, answered, packed, point: Pipeline, model, judge) -> DataFrame:
    ks, wanted = list(point.evaluation.k_values), set(point.evaluation.metrics)
    ids = queries.select("query_id")
    documents = passages.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "").select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    parts = [metrics.long_form(metrics.document_recall(ids, ranked, documents, ks), ["doc_recall"])]
    if names := [m for m in ("recall", "precision", "mrr", "ndcg", "hit") if m in wanted]:
        parts.append(metrics.long_form(metrics.ranking_metrics(ids, ranked, gold.select("query_id", "chunk_id"), ks), names))
    if "faithfulness" in wanted:
        judged = metrics.faithfulness(answered.select("query_id", "answer", F.col("text").alias("context")), judged=judge)
        parts.append(metrics.long_form(judged, ["faithfulness", "hallucination_rate"], by_k=False))
    if "citations" in wanted:
        sources = packed.select("query_id", F.explode("sources").alias("s")).select("query_id", "s.source_index", "s.chunk_id")
        sources = sources.join(ranked.select("query_id", "chunk_id", "content"), ["query_id", "chunk_id"])
        found = metrics.citation_metrics(answered.select("query_id", "answer"), sources, judged=judge or metrics.entails)
        parts.append(metrics.long_form(found, ["citation_precision", "citation_recall"], by_k=False))
    # a lexical run loads no embedding model for this alone
    if "answer_relevance" in wanted and (point.retrieval.mode != "bm25" or point.embedding.provider == "mock"):
        asked = answered.select("query_id", "query", "answer")
        parts.append(metrics.long_form(metrics.relevance(asked, model, _encoder(point)), ["answer_relevance"], by_k=False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Result:
    """What became of one point."""

    index: int
    config_hash: str
    cache_hash: str
    status: str
    cached: bool
    seconds: float
    means: dict
    error: str = ""
    queries: int = 0
    completed: int = 0
    failed: int = 0


def run_matrix(
    spark: SparkSession,
    experiment: Experiment,
    corpus: Corpus,
    queries: DataFrame,
    passages: DataFrame,
    benchmark: str = "",
    known: dict[str, dict] | None = None,
    skip_invalid: bool = False,
    save: Callable[[str, dict[str, DataFrame]], None] | None = None,
    model: transforms.Model | None = None,
    runs: RunTable | None = None,
    bypass_cache: bool = False,
    concurrent: int = 1,
    **options,
) -> list[Result]:
    """Run every point of a sweep; up to ``concurrent`` at a time, each in a scheduler pool of its own.

    A cache hash that ``known`` or ``runs`` holds is not run again, unless ``bypass_cache`` asks for it; points of one
    hash share the first one's run, and a point that another sweep has claimed in ``runs`` is waited for.  A point that
    fails leaves the others alone, as a query that fails leaves its run PARTIAL.  Results are in the order of the
    points; ``options`` go to ``run_stages``.
    """
    known = dict(known or {})
    points = list(enumerate(expand(experiment.components, skip_invalid)))
    keys = {i: cache_hash(experiment.dataset_id, corpus.version, asdict(point), benchmark) for i, point in points}

    def cached(i: int, point: Pipeline, means: dict) -> Result:
        return Result(i, point.hash(), keys[i], "COMPLETED", True, 0.0, means)

    def execute(i: int, point: Pipeline) -> Result:
        key, began = keys[i], time.monotonic()
        try:
            stages = run_stages(corpus, queries, passages, point, model, **options)
            means = {r["metric"]: r["mean"] for r in stages["summary"].select("metric", "mean").collect()}
            counts = stats.run_status(stages["query_runs"].withColumn("run_id", F.lit(key))).first()
            if save:
                save(key, stages)
        except Exception as error:  # one point's failure is that point's status
            return Result(i, point.hash(), key, "FAILED", False, time.monotonic() - began, {}, f"{type(error).__name__}: {error}"[:500])
        n, done, failed, status = (counts[c] for c in ("queries", "completed", "failed", "status")) if counts else (0, 0, 0, "COMPLETED")
        error = "" if status == "COMPLETED" else f"{failed} of {n} queries failed"
        return Result(i, point.hash(), key, status, False, time.monotonic() - began, means, error, n, done, failed)

    def one(i: int, point: Pipeline) -> Result:
        if concurrent > 1:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"point-{i % concurrent}")
        key = keys[i]
        if key in known and not bypass_cache:
            return cached(i, point, known[key])
        if runs is None:
            return execute(i, point)
        while (attempt := runs.claim(key, again=bypass_cache)) is None:
            last = runs.wait(key)
            if last.status == "COMPLETED" and not bypass_cache:
                return cached(i, point, last.record["means"])
        made = execute(i, point)
        runs.finish(key, attempt, made.status, made.means, made.error, made.queries, made.completed, made.failed)
        return made

    # the first point of each hash runs; the others take its result if it is complete, else they run in their turn
    leaders: dict[str, int] = {}
    for i, _ in points:
        leaders.setdefault(keys[i], i)
    first = [(i, point) for i, point in points if leaders[keys[i]] == i]
    if concurrent > 1:
        with ThreadPoolExecutor(concurrent) as pool:
            results = dict(zip((i for i, _ in first), pool.map(inheritable_thread_target(lambda p: one(*p)), first), strict=True))
    else:
        results = {i: one(i, point) for i, point in first}
    for i, point in points:
        if i not in results:
            leader = results[leaders[keys[i]]]
            results[i] = cached(i, point, leader.means) if leader.status == "COMPLETED" else one(i, point)
    return [results[i] for i, _ in points]


def matrix_verdict(results: list[Result]) -> str:
    """COMPLETED if all are, FAILED if none is, else PARTIAL."""
    states = {r.status for r in results}
    return "COMPLETED" if states <= {"COMPLETED"} else "FAILED" if states == {"FAILED"} else "PARTIAL"
