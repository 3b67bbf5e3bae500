"""Identities: every id is a hash of content, so equal inputs have equal ids."""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import nfkc, strip
from millrace.storage import fresh_path

#: Bytes of contents that one task feeds to a hash before another carries on.
TURN = 1 << 28
#: Bytes of OpenSSL's SHA256_CTX: eight words, two of length, a block and two numbers.
_STATE = 112


def checksum(content: Column) -> Column:
    return F.sha2(nfkc(content), 256)


def document_id(content_checksum: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(content_checksum, 1, 16))


def chunk_id(doc_id: Column, index: Column, content: Column, compose: bool = True) -> Column:
    body = strip(content)
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), index.cast("string"), nfkc(body) if compose else body), 256)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = hashlib.sha256()
    for batch in batches:
        for content in batch.column(0):
            whole.update((content.as_py() or "").encode())
    yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()])], names=["content_hash"])


@lru_cache(maxsize=1)
def _openssl() -> ctypes.CDLL | None:
    """The library behind hashlib, whose SHA-256 keeps its state in plain bytes; none where Python has another."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        found.SHA256_Init.argtypes = [ctypes.c_void_p]
        found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (ImportError, AttributeError, OSError):
        return None
    return found


def _carried(state: bytes, last: bool):
    """Feed a task's contents to the hash that ``state`` (empty: none yet) stands for; gives the new state, or the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, context = _openssl(), ctypes.create_string_buffer(state, _STATE)
        if not state:
            library.SHA256_Init(context)
        for batch in batches:
            for content in batch.column(0):
                data = (content.as_py() or "").encode()
                library.SHA256_Update(context, data, len(data))
        if not last:
            yield pa.RecordBatch.from_arrays([pa.array([context.raw], pa.binary())], names=["state"])
            return
        digest = ctypes.create_string_buffer(32)
        library.SHA256_Final(digest, context)
        yield pa.RecordBatch.from_arrays([pa.array([digest.raw.hex()])], names=["content_hash"])

    return run


def dataset_hash(docs: DataFrame, name: str, content: str, turn: int = TURN) -> DataFrame:
    """One row: SHA-256 of the documents' contents joined in order of their names, then of the contents; a null content is empty.

    The definition is one chain over all contents.  Contents of more than ``turn`` bytes are dealt to ranges of the
    order of about so many, and one task after another sorts a range and carries the hash's state on, so that none
    reads more than a range.
    """
    rows, spark = docs.select(F.col(content).alias("content"), F.col(name).alias("name")), docs.sparkSession
    held = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if held <= turn or _openssl() is None:
        ordered = rows.repartition(1).sortWithinPartitions("name", "content")
        return ordered.select("content").mapInArrow(_chained, "content_hash string")
    # rows that agree in both are dealt by their number, since their order changes nothing
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(int(held // turn) + 1, "name", "content", "row")
    path = fresh_path(spark, "hash-turns")
    dealt.drop("row").withColumn("turn", F.spark_partition_id()).write.partitionBy("turn").parquet(path)
    turns = [r[0] for r in spark.read.parquet(path).select("turn").distinct().orderBy("turn").collect()]

    def ordered(number: int) -> DataFrame:
        return spark.read.schema(rows.schema).parquet(f"{path}/turn={number}").coalesce(1).sortWithinPartitions("name", "content").select("content")

    state = b""
    for number in turns[:-1]:
        state = bytes(ordered(number).mapInArrow(_carried(state, False), "state binary").first()[0])
    return ordered(turns[-1]).mapInArrow(_carried(state, True), "content_hash string")


def query_set_hash(query_id: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_set(query_id)), ","), 256)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(value: Any, ascii_only: bool = False) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def config_hash(config: dict) -> str:
    return sha256_text(canonical(config))


def cache_hash(dataset_id: str, version_hash: str, config: dict, benchmark: str = "") -> str:
    """A run's cache identity; the benchmark takes part, so that new questions don't meet old results."""
    key = f"{dataset_id}@{version_hash}:{config_hash(config)}"
    return sha256_text(f"{key}:{benchmark}" if benchmark else key)


def benchmark_hash(queries: list[dict]) -> str:
    """Hash of the queries by query_id, with the white space of snippets squeezed."""

    def tidy(query: dict) -> dict:
        passages = [p | {"text_snippet": " ".join((p.get("text_snippet") or "").split())} for p in query.get("ground_truth_passages", [])]
        return query | {"ground_truth_passages": passages}

    return sha256_text(canonical([tidy(q) for q in sorted(queries, key=lambda q: q["query_id"])], ascii_only=True))


def collection_name(prefix: str, dataset: str, chunking: dict, model: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_]+", "_", dataset)
    return f"{prefix}_{clean}_{sha256_text(canonical(chunking))[:8]}_{sha256_text(model)[:8]}"


def point_id(chunk: str) -> str:
    """A vector store's id of a chunk."""
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, chunk))
