"""Chunkers: a document to its chunks.

Windows of characters are expressions.  All other chunkers run per document in Arrow batches; those of merged pieces
and of ids hold at most ``WINDOWS`` chunks.  A document is one value, documents are independent, nothing is shuffled.
A chunk has chunk_index, content, token_count, char_count, start_char, end_char and strategy.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import chunk_id
from millrace.functions.text import SENTENCE_ENDS, let, strip, token_estimate

#: Chunks that a Python worker holds.
WINDOWS = 512
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_CHUNK = "struct<chunk_index:int,content:string,token_count:int,char_count:int,start_char:int,end_char:int>"


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")


def count_tokens(text: str) -> int:
    """The estimate of ``token_estimate`` for a Python string."""
    return max(1, math.ceil(len(text.split()) * 1.3)) if text else 0


def locate(content: str, chunks: list[str]) -> list[tuple[int, int]]:
    """Where chunks lie, by their first 30 characters, searching on from the middle of the one before."""
    out, at = [], 0
    for chunk in chunks:
        head = chunk[:30]
        start = content.find(head, at)
        if start < 0:
            start = max(content.find(head), -1)
            start = at if start < 0 else start
        out.append((start, start + len(chunk)))
        at = max(0, start + len(chunk) // 2)
    return out


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows over ``length`` units: the first, and each that begins before the last window reached the end."""
    step = size - overlap


    def starts(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))

    return let(length, starts)


def fixed_windows(docs: DataFrame, size: int, overlap: int, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """Windows of ``size`` characters; blank windows take no index.  Offsets are those of the windows."""
    check(size, overlap)
    text = F.col(content)
    windows = F.transform(
        window_starts(F.length(text), size, overlap),
        lambda s: F.struct(s.alias("start_char"), strip(F.substring(text, s + 1, F.lit(size))).alias("content")),
    )
    kept = F.filter(windows, lambda w: w["content"] != "")
    whole = docs.where(F.length(strip(text)) > 0)
    rows = whole.select(F.col(doc_id).alias("doc_id"), F.posexplode(kept).alias("chunk_index", "chunk"))
    body = F.col("chunk.content")
    return rows.select(
        "doc_id",
        "chunk_index",
        body.alias("content"),
        token_estimate(body).alias("token_count"),
        F.length(body).alias("char_count"),
        F.col("chunk.start_char").alias("start_char"),
        (F.col("chunk.start_char") + F.length(body)).alias("end_char"),
        F.lit("fixed").alias("strategy"),
    )


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS, tokens: Callable[[str], int] = count_tokens) -> list[str]:
    """Pieces by the first separator that occurs, and by later ones where a piece is too long; separators are lost."""
    if tokens(text) <= size:
        return [text] if text else []
    for place, separator in enumerate(separators):
        if separator in text:
            pieces = text.split(separator) if separator else list(text)
            return [p for piece in pieces if piece for p in split_recursively(piece, size, separators[place + 1 :], tokens)]
    return [text]


def merge(pieces: list[str], size: int, overlap: int, tokens: Callable[[str], int] = count_tokens) -> list[str]:
    """Join pieces by spaces up to ``size`` tokens; a chunk begins with the longest run of last pieces within the overlap."""
    chunks: list[str] = []
    counts = [tokens(p) for p in pieces]
    first = total = 0  # the pieces held are those from ``first`` on
    for i, n in enumerate(counts):
        if first < i and total + n > size:
            chunks.append(" ".join(pieces[first:i]))
            while first < i and (total > overlap or total + n > size):
                total -= counts[first]
                first += 1
        total += n
    if pieces:
        chunks.append(" ".join(pieces[first:]))
    return chunks


def recursive(text: str, size: int, overlap: int, tokens: Callable[[str], int] = count_tokens) -> list[str]:
    return merge(split_recursively(text, size, tokens=tokens), size, overlap, tokens)


_AFTER_SENTENCE = re.compile(f"(?<=[{SENTENCE_ENDS}])\\s+")
_AFTER_UNIT = re.compile("(?<=[.!?।])\\s+")


def by_sentence(text: str, size: int, overlap: int, tokens: Callable[[str], int] = count_tokens) -> list[str]:
    """Whole sentences up to ``size`` tokens; a sentence longer than that stays whole."""
    return merge([s for s in map(str.strip, _AFTER_SENTENCE.split(text)) if s], size, overlap, tokens)


def gram_counts(text: str) -> Counter:
    t = " ".join(text.lower().split())
    return Counter(t[i : i + 3] for i in range(len(t) - 2)) if len(t) >= 3 else Counter([t] if t else [])


def count_cosine(a: Counter, b: Counter) -> float:
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def vector_cosine(a, b) -> float:
    norm = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


def semantic(
    text: str,
    threshold: float = 0.82,
    least: int = 50,
    most: int = 512,
    tokens: Callable[[str], int] = count_tokens,
    embed: Callable[[list[str]], list] | None = None,
) -> list[str]:
    """Sentences in a row, cut where neighbours are unlike and the chunk is long enough, or where it would grow too long.

    Likeness is that of character trigrams, or of ``embed``'s vectors.
    """
    units = [u for u in map(str.strip, _AFTER_UNIT.split(text)) if u]
    if not units:
        return []
    marks, like = (list(embed(units)), vector_cosine) if embed else ([gram_counts(u) for u in units], count_cosine)
    chunks, held, total = [], [units[0]], tokens(units[0])
    for i in range(1, len(units)):
        n = tokens(units[i])
        if (like(marks[i - 1], marks[i]) < threshold and total >= least) or total + n > most:
            chunks.append(" ".join(held))
            held, total = [], 0
        held.append(units[i])
        total += n
    return [*chunks, " ".join(held)]


def token_windows(text: str, size: int, overlap: int, codec, tokens: Callable[[str], int] = count_tokens) -> list[str]:
    """Windows of ``size`` ids by a codec with ``encode`` and ``decode``; the last one reaches the end."""
    ids = codec.encode(text)
    starts = [s for s in range(0, max(len(ids), 1), size - overlap) if s == 0 or s - (size - overlap) + size < len(ids)]
    return [codec.decode(ids[s : s + size]) for s in starts]


#: From a text to its chunks, with the strategy's options and ``tokens``, the counter of tokens.
Method = Callable[..., list[str]]
_METHODS: dict[str, Method] = {"fixed": token_windows, "recursive": recursive, "sentence": by_sentence, "semantic": semantic}


def register(*names: str):
    """Add a chunking strategy."""

    def add(method: Method) -> Method:
        _METHODS.update(dict.fromkeys(names, method))
        return method

    return add


def strategies() -> tuple[str, ...]:
    return tuple(_METHODS)


def chunk(docs: DataFrame, strategy: str, doc_id: str = "doc_id", content: str = "content", tokens: Callable[[str], int] = count_tokens, **options) -> DataFrame:
    """Chunks of every document by a strategy; blank and null documents have none.

    ``fixed`` takes size and overlap in ids of its ``codec``, or in characters without one; the others count by ``tokens``.
    A codec that knows ``spans`` (as ``bpe.Encoding``) makes windows of whole characters at their exact places.
    """
    name = strategy.lower().strip()
    if name == "fixed" and "codec" not in options:
        return fixed_windows(docs, options["size"], options["overlap"], doc_id, content)
    if name not in _METHODS:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    if "size" in options:
        check(options["size"], options.get("overlap", 0))
    if name == "fixed" and hasattr(options["codec"], "spans"):
        check(options["size"], options["overlap"])
        return _id_windows(docs, doc_id, content, **options)
    method = _METHODS[name]
    if tokens is count_tokens and method in (recursive, by_sentence) and set(options) == {"size", "overlap"}:
        return _merged_chunks(docs, name, doc_id, content, **options)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                whole = method(text, tokens=tokens, **options) if text and text.strip() else []
                made = [c.strip() for c in whole if c.strip()]
                places = locate(text, made) if made else []
                out.append(
                    [
                        dict(chunk_index=i, content=c, token_count=tokens(c), char_count=len(c), start_char=a, end_char=b)
                        for i, (c, (a, b)) in enumerate(zip(made, places, strict=True))
                    ]
                )
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    made = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.pandas_udf(run, f"array<{_CHUNK}>")(F.col(content))).alias("chunk"))
    return made.select("doc_id", "chunk.*", F.lit(name).alias("strategy"))


def _rows(docs: DataFrame, doc_id: str, content: str, name: str, rows: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The chunks that ``rows`` makes of every text, in Arrow batches of at most ``WINDOWS``."""
    names = ["chunk_index", "content", "token_count", "char_count", "start_char", "end_char"]
    key = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            held: list[tuple] = []
            at: list[int] = []

            def packed() -> pa.RecordBatch:
                columns = zip(*held, strict=True) if held else [()] * len(types)
                made = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=["doc_id", *names])

            for place, text in enumerate(batch.column(1)):
                for row in rows(text.as_py() or ""):
                    held.append(row)
                    at.append(place)
                    if len(held) == WINDOWS:
                        yield packed()
                        held, at = [], []
            yield packed()

    schema = f"doc_id {key}, chunk_index int, content string, token_count int, char_count int, start_char int, end_char int"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content")).mapInArrow(run, schema).withColumn("strategy", F.lit(name))


def _id_windows(docs: DataFrame, doc_id: str, content: str, size: int, overlap: int, codec) -> DataFrame:
    """Windows of ids as spans of the text; outer white space goes, and blank windows take no index."""

    def rows(text: str) -> Iterator[tuple]:
        i = 0
        for a, b in codec.spans(text, size, overlap) if text.strip() else []:
            body = text[a:b].strip()
            if body:
                start = a + len(text[a:b]) - len(text[a:b].lstrip())
                yield i, body, codec(body), len(body), start, start + len(body)
                i += 1

    return _rows(docs, doc_id, content, "fixed", rows)


def _merged_chunks(docs: DataFrame, name: str, doc_id: str, content: str, size: int, overlap: int) -> DataFrame:
    """Chunks of sentences or of recursively split pieces."""
    method = by_sentence if name == "sentence" else recursive

    def rows(text: str) -> Iterator[tuple]:
        made = [c for c in map(str.strip, method(text, size, overlap)) if c] if text.strip() else []
        for i, (body, (a, b)) in enumerate(zip(made, locate(text, made), strict=True)):
            yield i, body, count_tokens(body), len(body), a, b

    return _rows(docs, doc_id, content, name, rows)


def with_ids(chunks: DataFrame, compose: bool = True) -> DataFrame:
    """Chunks with their content-derived ids."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content"), compose))
