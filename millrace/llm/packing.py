"""Packing along a space-filling curve.

Each document is tokenized and ends with id 0.  Its hashed vector (token counts
under a fixed random projection, as a mean) has ``DIMS`` dimensions; the cell
it falls in has a Hilbert key.  Documents are sorted along the curve and cut
into ranges of about ``RANGE`` tokens, and each range is packed as one stream:
sequences of ``LENGTH`` tokens cut wherever they are full, so neighbours share
sequences.  What is left at a range's end is cut into sequences of powers of
two, which need no padding.

Ranges are computed, not sampled.  The curve is divided into ``1 << CELL_BITS``
cells; the tokens in each, a table of bounded size, are summed along the curve
and cut at multiples of ``RANGE``.  A cell with more tokens than a range
(copies have equal keys) is dealt to several by a hash of doc_id and ids, and
rows that agree in both are counted first and dealt by their number.  So the
pieces follow from the documents alone: not from the run, the partitions of
the input or the cluster.  A range is a stream, of which a task holds one
batch of documents.

Defined results: a null text is empty, an empty text is the single id 0, and a
very long text is cut into as many sequences as it needs; repeated rows are
packed one after another, each with pieces of its own.  A doc_id may be null
and of any type.  An empty table gives an empty result.  Only doc_id and text
are read, so other columns may have any names.  Documents of equal key follow
doc_id, then a checksum of their ids.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize

LENGTH = 1024
END = 0
DIMS, BITS = 3, 10
SEED = 20
#: Tokens of a range, and the leading bits of a key that tell its cell.
RANGE = 1 << 21
CELL_BITS = 18
#: Ranges share tasks beyond so many.
MOST_TASKS = 20_000

_SPECIAL = "<|endoftext|>"
#: Text for which the rank file's pattern and the tokenizer's agree on letters, digits and white space.
_ODD = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞₠-₿]")

_GAP = re.compile(r"\s\s")
#: How the pattern ends: a run of white space leaves its last character to what follows.
_RUNS = r"\s+(?!\S)|\s+"
#: Characters of a text whose ids may be a list of Python's numbers first, which is faster.
LONG = 1 << 20


def odd(text: str) -> bool:
    """Whether ``_ODD`` finds anything; most texts are settled by their highest code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes) or (codes.max() < 0x250 and not ((codes >= 0x1C) & (codes < 0x20)).any()):
        return False
    return _ODD.search(text) is not None


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of integer coordinates below ``2**bits`` (Skilling's transposition)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Tokenizer:
    """Ids of the JSON vocabulary; the rank file of the same vocabulary serves ordinary text faster, with equal ids.

    Without two white spaces in a row the pattern needs no look-ahead, which makes it a plain automaton.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary = vocabulary
        self.full = None
        self.ranks = None
        self.made = {}
        if ranks and os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

    def _whole(self, text: str) -> np.ndarray:
        if self.full is None:
            from tokenizers import Tokenizer as Full

            self.full = Full.from_file(self.vocabulary)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def fast(self, plain: bool):
        """The encoding by ranks, made when it is first needed."""
        if plain not in self.made:
            import public_tokenizers
            import tiktoken

            pattern = public_tokenizers.PATTERN
            if plain and pattern.endswith(_RUNS):
                pattern = pattern.removesuffix(_RUNS) + r"\s"
            self.made[plain] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.made[plain]

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or _SPECIAL in text or odd(text):
            return self._whole(text)
        encoding = self.fast(_GAP.search(text) is None)
        if len(text) > LONG:
            return encoding.encode_to_numpy(text)
        return np.frombuffer(array("I", encoding.encode_ordinary(text)), dtype=np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str, ranks: str | None) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(vocabulary, ranks)


@lru_cache(maxsize=2)
def _projection(rows: int, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((rows, dims)).astype(np.float32)


def mean_vector(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A document's hashed vector: the mean of its tokens' projections."""
    return _projection(1 << 16, dims).take(ids & 0xFFFF, axis=0).mean(axis=0) if len(ids) else np.zeros(dims)


def curve_keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each vector's cell; squashing keeps the cells of usual vectors of like size."""
    cells = ((np.tanh(2 * vectors) + 1) / 2 * (1 << bits)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def _encode(vocabulary: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary, ranks)
        for batch in batches:
            ids, keys = [], []
            out_ids = batch.column(0)
            at = 0
            held = 0
            for text in batch.column(1):
                found = np.append(tokenizer.ids(text.as_py() or ""), np.uint32(END))
                keys.append(mean_vector(found))
                ids.append(found.astype("<u2" if len(found) == 0 or found.max() < 1 << 16 else "<u4"))
                held += ids[-1].nbytes
                if held > 1 << 23:
                    yield _rows(out_ids.slice(at, len(ids)), keys, ids)
                    at, ids, keys, held = at + len(ids), [], [], 0
            if ids:
                yield _rows(out_ids.slice(at, len(ids)), keys, ids)

    return run


def _rows(doc_ids: pa.Array, keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    data = [x.tobytes() for x in ids]
    columns = {
        "doc_id": doc_ids,
        "curve": pa.array(curve_keys(np.stack(keys)), pa.int64()),
        "tokens": pa.array([len(x) for x in ids], pa.int64()),
        "mark": pa.array([zlib.crc32(x) for x in data], pa.int64()),
        "width": pa.array([x.itemsize for x in ids], pa.int32()),
        "ids": pa.array(data, pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_ENCODED = "curve long, tokens long, mark long, width int, ids binary"
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(offset: int, n: int, last: bool, length: int) -> list[int]:
    """Lengths of a stream's final sequences: what is left as descending powers of two (``last`` only)."""
    left = (offset + n) % length if last else 0
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class _Stream:
    """One range's stream: pieces are final once it is known where the last, partly filled sequence begins."""

    def __init__(self, number: int, length: int):
        self.first, self.length = number << 32, length
        self.out: list[tuple] = []
        self.tail: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the sequence that is still open
        self.filled, self.number = 0, 0

    def close(self, size: int) -> None:
        """Emit the open sequence's first ``size`` ids as one sequence; the rest stays open."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.tail:
            take = min(len(ids), size - offset)
            if take:
                crc = zlib.crc32(np.ascontiguousarray(ids[:take], dtype="<u4").tobytes())
                self.out.append((doc_id, start, take, crc, total, self.first + self.number, offset))
                offset += take
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
        self.tail, self.filled, self.number = rest, self.filled - size, self.number + 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            take = min(total - at, self.length - self.filled)
            self.tail.append((doc_id, at, ids[at : at + take], total))
            at, self.filled = at + take, self.filled + take
            if self.filled == self.length:
                self.close(self.length)

    def finish(self) -> None:
        for size in cuts(0, self.filled, True, self.length):
            self.close(size)


def _lay(length: int):
    """Lay the ranges of a task one after another; a row stands for ``copies`` equal documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, kind = None, pa.int64()

        def drain(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(x.split()[0] for x in _PIECES.split(", "))])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for number, doc_id, copies, width, data in zip(*(batch.column(x) for x in ("range", "doc_id", "copies", "width", "ids")), strict=True):
                if stream is None or stream.first >> 32 != number.as_py():
                    if stream is not None:
                        stream.finish()
                        if stream.out:
                            yield drain(stream.out)
                    stream = _Stream(number.as_py(), length)
                ids, doc = np.frombuffer(data.as_py(), dtype=f"<u{width.as_py()}"), doc_id.as_py()
                for _ in range(copies.as_py()):
                    stream.add(doc, ids)
                    if len(stream.out) >= 20_000:
                        yield drain(stream.out)
        if stream is not None:
            stream.finish()
            if stream.out:
                yield drain(stream.out)

    return run


def encode(docs: DataFrame, vocabulary: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, Hilbert key, number of ids, checksum, width of an id in bytes, and the ids of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(vocabulary, ranks), f"doc_id {kind}, {_ENCODED}")


_SAME = ("curve", "doc_id", "mark", "tokens")


def _spares(ids: DataFrame, range_tokens: int) -> tuple[DataFrame, DataFrame]:
    """The rows without those that, counted with their equals, fill a range alone; and those, as rows of ``copies`` and ``part``."""
    counts = ids.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("alike"))
    heavy = counts.where((F.col("alike") > 1) & (F.col("alike") * F.col("tokens") > range_tokens))
    # few rows, or none; written so that the joins below know its size and leave the ids where they are
    heavy = materialize(heavy.select(*(F.col(c).alias(f"h_{c}") for c in _SAME)), "packing-heavy")
    same = F.lit(True)
    for c in _SAME:
        same &= F.col(c).eqNullSafe(F.col(f"h_{c}"))
    rest = ids.join(heavy, same, "left_anti")
    # equal rows hold equal ids but for equal checksums of unequal ids, which are kept apart here
    several = ids.join(heavy, same, "left_semi").groupBy(*_SAME, "width", "ids").agg(F.count(F.lit(1)).alias("alike"))
    each = F.greatest(F.lit(1), F.floor(F.lit(range_tokens) / F.col("tokens"))).cast("long")
    several = several.withColumn("each", each).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / F.col("each")))))
    left = F.least(F.col("each"), F.col("alike") - F.col("part") * F.col("each"))
    return rest.withColumns({"copies": F.lit(1).cast("long"), "part": F.lit(0).cast("long")}), several.withColumn("copies", left).drop("alike", "each")


def ranged(ids: DataFrame, range_tokens: int = RANGE) -> DataFrame:
    """The encoded rows with ``copies`` and the number of their ``range``; ranges ascend along the curve."""
    one, several = _spares(ids, range_tokens)
    rows = one.unionByName(several).withColumn("cell", F.shiftright("curve", DIMS * BITS - CELL_BITS))
    small = ids.select("curve", "tokens").withColumn("cell", F.shiftright("curve", DIMS * BITS - CELL_BITS))
    cells = small.groupBy("cell").agg(F.sum("tokens").alias("held"))
    # at most 1 << CELL_BITS rows, so one task sums them and every task may have them
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.col("held") / range_tokens)
    large = F.col("held") > range_tokens
    cells = cells.withColumn("ahead", F.coalesce(F.sum(F.when(~large, F.col("held")).otherwise(0)).over(before), F.lit(0)))
    cells = cells.withColumn("large", F.coalesce(F.sum(F.when(large, parts + 1).otherwise(0)).over(before), F.lit(0)))
    # small cells fill ranges together; a large cell has ranges of its own, and the small ones after it begin another
    cells = cells.select("cell", (F.floor(F.col("ahead") / range_tokens) + F.col("large") + F.when(large, 1).otherwise(0)).alias("base"), F.when(large, parts).otherwise(1).alias("parts"))
    spread = F.pmod(F.xxhash64("doc_id", "mark", "part"), F.col("parts"))
    return rows.join(F.broadcast(cells), "cell").withColumn("range", (F.col("base") + spread).cast("long")).drop("cell", "base", "parts", "part")


def pack(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, length: int = LENGTH, range_tokens: int = RANGE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are written once, so that finding the ranges doesn't tokenize again.
    """
    spark = docs.sparkSession
    ids = materialize(encode(docs, vocabulary, ranks, doc_id, text), "packing-ids")
    total = ids.agg(F.sum("tokens")).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_tokens + 1))
    along = ranged(ids, range_tokens).repartition(tasks, "range").sortWithinPartitions("range", *_SAME)
    kind = ids.schema["doc_id"].dataType.simpleString()
    return along.select("range", "doc_id", "copies", "width", "ids").mapInArrow(_lay(length), f"doc_id {kind}, {_PIECES}")
