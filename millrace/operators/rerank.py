"""Rerankers: rankings with texts in, rankings out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import fields
from millrace.operators.lexical import best_first, rank_within


def overlap(query: Column, content: Column) -> Column:
    """Common words of query and content over one more than the query's words, on sets of lower-case words."""
    q, c = (F.array_distinct(fields(F.lower(t))) for t in (query, content))
    return F.size(F.array_intersect(q, c)) / (F.size(q) + F.lit(1.0))


def rerank(ranked: DataFrame, score: Column, k: int | None, descending_ids: bool = False) -> DataFrame:
    """Order each query's candidates by a new score; keeps the first rank and score as ``original_rank`` and ``original_score``."""
    renamed = ranked.withColumnRenamed("rank", "original_rank").withColumnRenamed("score", "original_score")
    order = (F.col("score").desc(), F.col("chunk_id").desc()) if descending_ids else best_first()
    return rank_within(renamed.withColumn("score", score), k, *order)


def by_overlap(ranked: DataFrame, k: int | None, fixed: dict[str, float] | None = None) -> DataFrame:
    """``ranked`` has ``query`` and ``content``; ``fixed`` gives some chunks their scores."""
    score = overlap(F.col("query"), F.col("content"))
    if fixed:
        table = F.create_map(*(F.lit(x) for pair in fixed.items() for x in pair))
        score = F.coalesce(F.try_element_at(table, F.col("chunk_id").cast("string")), score)
    return rerank(ranked, score, k)


def by_model(ranked: DataFrame, k: int | None, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], descending_ids: bool = False) -> DataFrame:
    """Score (query, content) pairs by a model that each worker loads once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for queries, contents in batches:
            yield pd.Series(score(list(zip(queries, contents, strict=True))), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return rerank(ranked, F.pandas_udf(run, "double")("query", "content"), k, descending_ids)


def flashrank(model: str):
    """Loader of an ONNX cross encoder (optional package)."""

    def load():
        from flashrank import Ranker, RerankRequest

        ranker = Ranker(model_name=model)

        def score(pairs):
            # one request for each query of the batch
            places: dict[str, list[int]] = {}
            for i, (query, _) in enumerate(pairs):
                places.setdefault(query, []).append(i)
            out = [0.0] * len(pairs)
            for query, mine in places.items():
                for found in ranker.rerank(RerankRequest(query=query, passages=[{"id": i, "text": pairs[i][1]} for i in mine])):
                    out[found["id"]] = float(found["score"])
            return out

        return score

    return load


def cross_encoder(model: str):
    """Loader of a cross encoder (optional package); its ties go to the greater chunk_id."""

    def load():
        from sentence_transformers import CrossEncoder

        encoder = CrossEncoder(model)
        return lambda pairs: [float(s) for s in encoder.predict(pairs)]

    return load


def topology(mode: str, reranked: bool) -> str:
    """Name of a retrieval topology."""
    base = {"dense": "dense", "bm25": "bm25", "sparse": "bm25", "hybrid": "hybrid"}
    try:
        return base[mode.lower().strip()] + ("_reranked" if reranked else "")
    except KeyError:
        raise ValueError(f"unknown retrieval mode {mode!r}") from None
