"""Registering a dataset: a folder of files and a file of questions become the tables that experiments read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import dataset_hash
from millrace.operators import chunking, qrels
from millrace.sources import readers, store
from millrace.storage import materialize


@dataclass(frozen=True)
class Dataset:
    """A registered version: its tables and the hash of its contents."""

    documents: DataFrame
    chunks: DataFrame
    queries: DataFrame
    passages: DataFrame
    relevant: DataFrame
    totals: DataFrame
    content_hash: str


def register(spark: SparkSession, root: str, dataset_id: str, version: int, folder: str, questions: str, strategy: str = "fixed", compat: bool = False, **options) -> Dataset:
    """Read, check, cut and resolve; writes the version's tables below ``root`` once and returns them.

    Questions whose passages name documents that the folder lacks, and passages without a document whose matches lie
    in several, are errors.
    """
    documents = materialize(readers.documents(spark, folder), "dataset")
    queries = materialize(readers.questions(spark, questions), "questions")
    passages = readers.passages(queries)
    by_name = documents.select("doc_id", "filename", F.regexp_replace("filename", "\\.[^.]*$", "").alias("stem"))
    named = passages.where(F.coalesce("doc_id", F.lit("")) != "")
    if lost := [r["doc_id"] for r in qrels.unknown_documents(named, documents).select("doc_id").distinct().limit(20).collect()]:
        raise ValueError(f"passages name unknown documents: {', '.join(lost)}")
    # a passage may name its document by id, file name or stem
    names = by_name.select("doc_id", F.explode(F.array_distinct(F.array("doc_id", "filename", "stem"))).alias("name")).dropDuplicates(["name"])
    passages = passages.withColumnRenamed("doc_id", "named").join(names, F.col("named") == F.col("name"), "left")
    passages = materialize(passages.select("passage", "query_id", F.coalesce("doc_id", "named").alias("doc_id"), "snippet", "start_char", "end_char"), "passages")
    chunks = materialize(chunking.with_ids(chunking.chunk(documents.dropDuplicates(["doc_id"]), strategy, **options)), "chunks")
    relevant = materialize(qrels.resolve(passages, chunks, compat), "relevant")
    if compat and not qrels.ambiguous(relevant, passages, chunks).isEmpty():
        raise ValueError("passages without a document match several")
    totals = store.write_dataset(root, dataset_id, version, documents, chunks)
    base = f"{root}/{dataset_id}/v{version:06d}"
    for name, table in (("queries", queries), ("passages", passages), ("relevant", relevant)):
        table.write.mode("errorifexists").parquet(f"{base}/{name}")
    tables = {n: spark.read.parquet(f"{base}/{n}") for n in ("documents", "chunks", "queries", "passages", "relevant")}
    return Dataset(**tables, totals=totals, content_hash=dataset_hash(tables["documents"], "filename", "content").first()[0])
