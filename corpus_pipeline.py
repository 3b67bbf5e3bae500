"""The corpus pipeline: quality rules, near-duplicate removal, secret scans, mixing, packing.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and
returns a DataFrame; between stages the result is written as Parquet and read
again.  All stages but the last return the columns of ``documents``.

Defined results: a document with a null or empty text has no words, so the
quality rules reject it.  Near duplicates leave the row of least doc_id, a
null doc_id last, and of rows that agree in every column one.  Where ids are
equal, the hash of the row decides.  Texts of any length are
read whole.  An empty table gives an empty result of the last stage's columns.
Other columns pass every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_dedup, packing, quality, secrets
from millrace.llm.common import documents
from millrace.llm.queries import vocabulary
from millrace.storage import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of live secrets are replaced; every document stays."""
    return secrets.redact_live(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences."""
    return packing.pack(docs, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", source_mixing),
    ("packing", curve_packing),
]

#: SQL can't express edit alignment along MinHash buckets, nor byte-pair tokenization; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; a stage's table goes when the next one is written."""
    docs, written = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(spark, written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
