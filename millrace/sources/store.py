"""Tables of a warehouse folder: chunks and vectors with upsert, run traces, dataset versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dense, relational

TRACES = ("query_runs", "transformed", "retrieved", "reranked", "context", "generation", "metrics")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


class VectorStore:
    """A collection of chunks with vectors: create, upsert, search, count, exists, delete.

    An upsert writes a new generation of files and the newest row of a chunk_id counts, so an upsert never rewrites
    the table; ``rewrite`` folds the generations into one.  Of two writers at once, and of rows of one id in one batch,
    an order of their own decides, the same for every reader.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"
        self._file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return _exists(self.spark, self.path)

    def _generation(self) -> int:
        if not self.exists():
            return 0
        return (self.spark.read.parquet(self.path).agg(F.max("generation")).first()[0] or 0) + 1

    def upsert(self, chunks: DataFrame) -> None:
        """Add chunks (chunk_id, embedding, and what else they carry), replacing those of equal id."""
        rows = chunks.withColumns({"generation": F.lit(self._generation()), "batch": F.lit(uuid.uuid4().hex)})
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        order = [F.col("generation").desc(), F.col("batch").desc(), F.xxhash64("embedding")]
        return relational.latest(rows, "chunk_id", *order).drop("generation", "batch")

    def rewrite(self) -> None:
        """Fold the generations; the old files go only when the new ones stand in their place."""
        fresh, old = (f"{self.path}.{uuid.uuid4().hex}" for _ in range(2))
        self.table().withColumns({"generation": F.lit(0), "batch": F.lit("")}).write.parquet(fresh)
        self._files.rename(self._file(self.path), self._file(old))
        self._files.rename(self._file(fresh), self._file(self.path))
        self._files.delete(self._file(old), True)

    def search(self, queries: DataFrame, k: int, conditions: dict | None = None, metadata_only: bool = False, distance: str = "cosine") -> DataFrame:
        """Nearest chunks; conditions hold before scoring."""
        rows = self.table()
        if conditions:
            test = dense.store_filter(conditions) if metadata_only else dense.attribute_filter(conditions, rows.columns)
            rows = rows.where(test)
        return dense.search(queries, rows, k, distance=distance)

    def count(self) -> int:
        return self.table().count() if self.exists() else 0

    def delete(self) -> None:
        self._files.delete(self._file(self.path), True)


_STORES: dict[str, type] = {"folder": VectorStore, "memory": VectorStore}


def register_store(*names: str):
    """Add a kind of vector store: a class with the methods of ``VectorStore``."""

    def add(kind: type) -> type:
        _STORES.update(dict.fromkeys(names, kind))
        return kind

    return add


def open_store(kind: str, spark: SparkSession, root: str, name: str):
    """A collection of a registered kind of store."""
    try:
        return _STORES[kind.lower().strip()](spark, root, name)
    except KeyError:
        raise ValueError(f"unknown store {kind!r}; known: {sorted(_STORES)}") from None


def write_trace(root: str, run_id: str, **tables: DataFrame) -> None:
    """Write a run's tables as a new attempt, then publish it; the attempt published last is the run.

    Readers take only published attempts, so neither a run that broke off nor one that is being written again is seen
    half-written.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/{name}/run_id={run_id}/attempt={attempt}")
    marker = spark.range(1).select(F.lit(attempt).alias("published"), F.current_timestamp().alias("published_at"))
    marker.coalesce(1).write.mode("append").parquet(f"{root}/published/run_id={run_id}")


def read_trace(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A trace table of the published runs."""
    text = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
    before = {k: spark.conf.get(k) for k in text}
    try:
        for k, v in text.items():
            spark.conf.set(k, v)
        published, rows = (spark.read.parquet(f"{root}/{x}") for x in ("published", name))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    last = relational.latest(published, "run_id", F.col("published_at").desc(), F.col("published").desc())
    last = last.select("run_id", F.col("published").alias("attempt"))
    return rows.join(last, ["run_id", "attempt"], "left_semi").drop("attempt")


def write_dataset(root: str, dataset_id: str, version: int, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Write a version's documents and chunks once; a version is immutable.  Returns its totals."""
    base = f"{root}/{dataset_id}/v{version:06d}"
    documents.write.mode("errorifexists").parquet(f"{base}/documents")
    chunks.write.mode("errorifexists").parquet(f"{base}/chunks")
    totals = relational.document_totals(documents.sparkSession.read.parquet(f"{base}/documents"))
    totals.coalesce(1).write.mode("errorifexists").parquet(f"{base}/totals")
    return documents.sparkSession.read.parquet(f"{base}/totals")


def integrity(documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Rows that break a rule: repeated contents, repeated chunk places, chunks without a document."""
    return {
        "repeated documents": relational.repeated(documents, "checksum"),
        "repeated chunks": relational.repeated(chunks, "doc_id", "chunk_index"),
        "orphan chunks": relational.orphans(chunks, documents, "doc_id"),
    }
