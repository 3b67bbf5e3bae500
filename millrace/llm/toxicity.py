"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the set of words of a text is trained from confirmed
toxic documents and unlabelled text.  With class prior ``p``, the risk is
``p * P(loss+) + max(0, U(loss-) - p * P(loss-))``: what the unlabelled text
says about the negative class is corrected by the positives in it, and where
that estimate falls below zero the step goes the other way, so the model
can't win by overfitting.  ``p`` is given, or the share of toxic documents
among those that have a label; labelled negatives serve for nothing else.

Training is over a bounded sample: at most ``positives`` toxic and
``unlabelled`` other documents, chosen by a hash of doc_id.  Their words are
hashed and counted on the executors; the driver gets the chosen vocabulary
(at most ``vocabulary`` hashes) and, of each sampled document, only the
numbers of its vocabulary words at two bytes each.  So what is sent either way
is bounded by the parameters, whatever the length of the texts.  Scoring reads
every whole text once, without a shuffle.

Defined results: null and empty texts get the score of no words, below 0.5 at
a prior below a half; without any positive, or with nothing unlabelled, every
score is 0; an empty table gives an empty one.  Repeated rows are scored
alike.  Words of equal strength enter the vocabulary by their hashes.  Labels of a doc_id given twice count as toxic if one is.  A null
doc_id is held out and learns nothing.  A text of any length is read whole,
one at a time.  Columns of the inputs may have any names; in the output of
``score`` a column of the input that is named like the score gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import discard, materialize

POSITIVES, UNLABELLED, VOCABULARY = 4000, 12000, 20_000
#: Numbers of vocabulary words travel as two bytes.
_MOST_WORDS = 1 << 16
EPOCHS, RATE, DECAY, SHRINK = 150, 0.1, 1e-4, 2e-4
#: A word enters the vocabulary if so many documents have it and its shares differ by so many standard errors.
LEAST_DOCS, STRENGTH = 5, 4
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 1 << 18


class Words:
    """The sorted 64-bit hashes of a text's distinct words; the cache of words is bounded."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for word in words.difference(known):
            known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        out.sort()
        return out


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights, the bias and the class prior."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, words: np.ndarray) -> float:
        if self.prior == 0:
            return 0.0
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            margin = self.bias + float(self.weights[at[self.words[at] == words]].sum())
        else:
            margin = self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


class _Sparse:
    """Rows of column indices with ones."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.columns = len(rows), columns

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], minlength=self.n)

    def gathered(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, per_row[self.row], minlength=self.columns)


@dataclass(frozen=True)
class Risk:
    """The non-negative risk of a positive and an unlabelled table at a class prior, with logistic loss."""

    positive: _Sparse
    unlabelled: _Sparse
    prior: float

    def negative(self, weights: np.ndarray, bias: float) -> float:
        """``U(loss-) - p * P(loss-)``: what the samples say about the negatives; overfitting takes it below zero."""
        mp, mu = self.positive.times(weights) + bias, self.unlabelled.times(weights) + bias
        return float(np.logaddexp(0, mu).mean() - self.prior * np.logaddexp(0, mp).mean())

    def __call__(self, weights: np.ndarray, bias: float) -> float:
        mp = self.positive.times(weights) + bias
        return float(self.prior * np.logaddexp(0, -mp).mean()) + max(0.0, self.negative(weights, bias))

    def step(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The direction to go against, by weights and then bias: the risk's gradient, or where the negative part is below zero that part's ascent."""
        mp, mu = self.positive.times(weights) + bias, self.unlabelled.times(weights) + bias
        gp_pos = -self.prior * _sigmoid(-mp) / self.positive.n
        gp_neg, gu_neg = -self.prior * _sigmoid(mp) / self.positive.n, _sigmoid(mu) / self.unlabelled.n
        gp, gu = (gp_pos + gp_neg, gu_neg) if self.negative(weights, bias) >= 0 else (-gp_neg, -gu_neg)
        return np.append(self.positive.gathered(gp) + self.unlabelled.gathered(gu), gp.sum() + gu.sum())


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> Model:
    """Fit the weights of ``words`` by Adam on the non-negative risk, shrinking small weights to zero.

    The documents are arrays of places in ``words``.  The bias starts at the prior's log odds.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    risk = Risk(_Sparse(positive, len(words)), _Sparse(unlabelled, len(words)), prior)
    start = min(max(prior, 1e-6), 1 - 1e-6)
    weights, bias = np.zeros(len(words)), float(np.log(start / (1 - start)))
    moment, square = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, epochs + 1):
        gradient = risk.step(weights, bias) + np.append(DECAY * weights, 0.0)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - RATE * SHRINK * 10)
    used = weights != 0
    return Model(words[used], weights[used], bias, prior)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; an absent id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        data = [words(t.as_py()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(data, pa.list_(pa.int64()))], names=["positive", "words"])


def _placed(words: np.ndarray):
    """Of each document the places of its words in the sorted ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for row in batch.column("words"):
                own = np.array(row.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                at = np.searchsorted(words, own)
                at = at[at < len(words)]
                own = own[: len(at)]
                data.append(at[words[at] == own].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(data, pa.binary())], names=["positive", "places"])

    return run


def vocabulary_of(sample: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """The words whose share of documents differs most between the two samples (positive, words), in standard errors; sorted hashes."""
    n1, n2 = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n1 or not n2:
        return np.zeros(0, np.uint64)
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count_if("positive").alias("a"), F.count(F.lit(1)).alias("both")).where(F.col("both") >= LEAST_DOCS)
    share = F.col("both") / F.lit(float(n1 + n2))
    gap = F.col("a") / F.lit(float(n1)) - (F.col("both") - F.col("a")) / F.lit(float(n2))
    strength = F.abs(gap) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n2) + F.lit(1e-12))
    best = counts.select("word", strength.alias("strength")).where(F.col("strength") > STRENGTH).orderBy(F.desc("strength"), "word").limit(size)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], dtype=np.int64).view(np.uint64))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    vocabulary: int = VOCABULARY,
    prior: float | None = None,
) -> Model:
    """Train on the rows of ``docs`` that ``learn`` (a condition on doc_id) admits.

    The samples are the first ids by a hash, found from ids alone; only their texts are read for training.
    """
    if not 0 < vocabulary <= _MOST_WORDS:
        raise ValueError(f"the vocabulary must hold 1 to {_MOST_WORDS} words")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), learn.alias("learn"))
    ids = rows.where("learn AND id IS NOT NULL").select("id").distinct()
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic")).where("toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).join(ids, "id", "left_semi")
    positive = known.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(True).alias("positive"))
    if prior is None:
        total, toxic_total = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
        prior = toxic_total / total if total else 0.0
    others = ids.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled).select("id", F.lit(False).alias("positive"))
    # both samples have a bound given by parameters, so they may be broadcast
    chosen = rows.join(F.broadcast(positive.union(others)), "id").select("positive", "text")
    sample = materialize(chosen.mapInArrow(_hashed, "positive boolean, words array<bigint>"), "toxicity-sample")
    words = vocabulary_of(sample, vocabulary)
    found = sample.mapInArrow(_placed(words), "positive boolean, places binary").collect()
    discard(docs.sparkSession, sample)
    # the order of rows from executors varies; sums of floats should not
    arrays = [(p, np.frombuffer(w, "<u2").astype(np.int64)) for p, w in sorted((r["positive"], bytes(r["places"])) for r in found)]
    return train(words, [a for p, a in arrays if p], [a for p, a in arrays if not p], prior)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic, in place of a column of that name."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in batches:
            yield pd.Series([model.score(words(t)) for t in texts], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(output, F.pandas_udf(run, "double")(F.col(text)))
