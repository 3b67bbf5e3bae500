"""Byte-pair tokens by a vocabulary of ranks: counts, ids, and windows of ids that map back to exact spans of characters.

An ``Encoding`` names a file of ranks (a token in base 64 and its rank a line) and the pattern that splits texts before
pairs are merged.  It travels to the executors by name; each worker reads the file once.  Encodings registered under a
name serve configurations (``context.encoding_name``); a name that isn't registered means the estimate of 1.3 tokens a
word.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import token_estimate


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str):
    import tiktoken

    local = SparkFiles.get(os.path.basename(path))
    with open(local if os.path.exists(local) else path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Encoding:
    """Ids of texts; called with a text, it gives the number of its tokens (none for an empty one)."""

    path: str
    pattern: str

    def __call__(self, text: str) -> int:
        return len(self.encode(text))

    def encode(self, text: str) -> list[int]:
        return _loaded(self.path, self.pattern).encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return _loaded(self.path, self.pattern).decode(ids)

    def spans(self, text: str, size: int, overlap: int) -> list[tuple[int, int]]:
        """Spans of characters of windows of ``size`` ids; one that ends inside a character leaves it to the next.

        Without overlap the spans rebuild the text.
        """
        ids = self.encode(text)
        at = [*_loaded(self.path, self.pattern).decode_with_offsets(ids)[1], len(text)] if ids else [0]
        step, n = size - overlap, len(ids)
        starts = [s for s in range(0, n, step) if s == 0 or s - step + size < n]
        return [(at[s], at[min(s + size, n)]) for s in starts]


def encoding(spark: SparkSession, path: str, pattern: str) -> Encoding:
    """The encoding of a file of ranks, which is sent to the executors."""
    spark.sparkContext.addFile(path)
    return Encoding(path, pattern)


_NAMED: dict[str, Encoding] = {}


def register(name: str, made: Encoding) -> Encoding:
    """Let configurations name an encoding."""
    _NAMED[name] = made
    return made


def named(name: str | None) -> Encoding | None:
    """The encoding registered under a name."""
    return _NAMED.get(name or "")


def counter(made: Encoding | None) -> Callable[[Column], Column]:
    """From a text to its number of tokens; the estimate without an encoding.  A null text has no number."""
    if made is None:
        return token_estimate

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else made(t)).astype("Int32")

    return count


def ids(made: Encoding) -> Callable[[Column], Column]:
    """From a text to the list of its ids; a null text has none."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # packed at once, as lists of Python's numbers take nine times the memory
            found, ends, missing = array("i"), array("i", [0]), []
            for text in texts:
                known = text.as_py()
                missing.append(known is None)
                found.extend(made.encode(known) if known is not None else ())
                ends.append(len(found))
            values, offsets = (pa.array(np.frombuffer(x, np.int32)) for x in (found, ends))
            yield pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing, pa.bool_()))

    return encode
