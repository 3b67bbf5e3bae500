"""Fusion of rankings: reciprocal ranks, and min-max normalised scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lexical import PLACES, best_first, rank_within

FIRST = 20


def candidates(k: int) -> int:
    """How many candidates each channel gives before fusion."""
    return max(2 * k, FIRST)


def reciprocal_rank(rankings: DataFrame, k: int | None, constant: int = 60) -> DataFrame:
    """Sum of ``1 / (constant + rank)`` over all lists; a chunk that a list names twice counts twice."""
    if constant < 0:
        raise ValueError("the rank constant must not be negative")
    total = F.round(F.sum(1.0 / (constant + F.col("rank"))), PLACES)
    return rank_within(rankings.groupBy("query_id", "chunk_id").agg(total.alias("score")), k, *best_first())


def scaled(ranking: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Scores brought to 0..1 within each query; where all are equal, 1 if they are positive and 0 if not."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    span = high - low
    level = F.when(high > 0, 1.0).otherwise(0.0)
    return ranking.withColumn("scaled", F.when(span <= epsilon, level).otherwise((F.col("score") - low) / (span + epsilon)))


def normalised_scores(dense: DataFrame, lexical: DataFrame, k: int | None, alpha: float = 0.7, epsilon: float = 1e-9) -> DataFrame:
    """``alpha`` times the dense score and the rest of the lexical one; a channel that lacks a chunk gives it 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    one = scaled(dense, epsilon).groupBy("query_id", "chunk_id").agg(F.max("scaled").alias("d"))
    two = scaled(lexical, epsilon).groupBy("query_id", "chunk_id").agg(F.max("scaled").alias("s"))
    both = one.join(two, ["query_id", "chunk_id"], "full_outer")
    zero = F.lit(0.0)
    total = F.round(alpha * F.coalesce("d", zero) + (1 - alpha) * F.coalesce("s", zero), PLACES)
    return rank_within(both.select("query_id", "chunk_id", total.alias("score")), k, *best_first())


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, fusion: str = "rrf", constant: int = 60, alpha: float = 0.7) -> DataFrame:
    """Fuse two channels, each of which gave ``candidates(k)`` chunks."""
    if fusion == "rrf":
        return reciprocal_rank(dense.select("query_id", "chunk_id", "rank").unionByName(lexical.select("query_id", "chunk_id", "rank")), k, constant)
    if fusion == "rsn":
        return normalised_scores(dense, lexical, k, alpha)
    raise ValueError(f"unknown fusion {fusion!r}")
