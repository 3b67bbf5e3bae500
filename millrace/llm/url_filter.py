"""URL filters over a sorted digest array.

Every rule is a string ``host/path`` with a verdict.  The 64-bit xxhashes of
all rules are one sorted array in a file of its own; the rows beside it say
where a rule's string lies, how long it is and what it decides, and a third
file holds the strings.  Executors get the files through ``addFile`` (each
fetches its own copy from the shared folder, also one that joins after another
was lost) and memory-map them: pages of the files that a probe touches are
read, and all workers of a machine share them.  Every candidate string of a
batch of URLs is hashed, found by vectorised binary search in the mapped
array, and compared with the full string, so that two strings of equal digest
never stand in for each other.

Rules come as pairs, as a file of lines (``rules_from``) or as a table (rule,
verdict).  A table of more than ``most_bytes`` becomes several rule sets, dealt
by the rules' digests; each is built by itself, so the driver holds one, and
executors map them all.  As many pairs are an error.

A URL's candidates are its host's suffixes at label borders, each with the
prefixes of its path, of lengths that occur in the rule set.  So a host of any
number of labels has as many candidates as the rules have lengths.  The longest rule
wins, the longer host among equals.  A URL that no rule fits has the verdict
of ``default``.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path and fits no rule.  A very long URL is judged whole.  Repeated rows
are judged alike; an empty table gives an empty one.  An empty rule set gives
every URL the default.  Where one string is given twice, the last verdict
counts.  Columns of the input named host, path, rule or verdict give way to
the results; all others stay, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import spare
from millrace.storage import fresh_path, write_bytes

VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: (host/path, verdict) pairs.
Rules = Iterable[tuple[str, str]]
_ROW = np.dtype([("offset", "<u8"), ("length", "<u4"), ("verdict", "<u4")])
#: The files of a rule set: digests, rows, strings, and the lengths of paths and of hosts that occur.
_PARTS = (".key", ".row", ".txt", ".len", ".hst")
MOST_BYTES = 1 << 30


def rules_of(table: DataFrame, rule: str = "rule", verdict: str = "verdict") -> Iterator[tuple[str, str]]:
    """The rules of a table, a partition at a time; where one is given twice with different verdicts, block counts."""
    rows = table.groupBy(F.col(rule).alias("r")).agg(F.max(verdict).alias("v")).where("r IS NOT NULL AND v IS NOT NULL")
    return ((row["r"], row["v"]) for row in rows.toLocalIterator())


def rules_from(path: str) -> Iterator[tuple[str, str]]:
    """The rules of a file with lines of verdict and rule; blank lines and those that begin with # say nothing."""
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            verdict, _, rule = line.strip().partition(" ")
            if rule and not verdict.startswith("#"):
                yield rule.strip(), verdict


def build(rules: Rules) -> tuple[bytes, ...]:
    """The contents of a rule set's files in the order of ``_PARTS``; the digests ascend and the rows follow them."""
    table: dict[bytes, int] = {}
    for rule, verdict in rules:
        if "/" not in rule:
            raise ValueError(f"a rule is host/path, not {rule!r}")
        table[rule.encode()] = VERDICTS.index(verdict)
    digests = np.fromiter(map(xxhash.xxh64_intdigest, table), dtype="<u8", count=len(table))
    rows = np.zeros(len(table), dtype=_ROW)
    rows["length"] = np.fromiter(map(len, table), dtype="<u4", count=len(table))
    rows["offset"] = np.cumsum(rows["length"].astype(np.uint64)) - rows["length"]
    rows["verdict"] = np.fromiter(table.values(), dtype="<u4", count=len(table))
    order = np.argsort(digests, kind="stable")
    # lengths of paths, in characters, decide which prefixes of a URL are looked up
    paths = sorted({len(r.decode().partition("/")[2]) + 1 for r in table})
    hosts = sorted({len(r.decode().partition("/")[0]) for r in table})
    lengths = (np.array(x, dtype="<u4").tobytes() for x in (paths, hosts))
    return digests[order].tobytes(), rows[order].tobytes(), b"".join(table), *lengths


class Digests:
    """The memory-mapped files of a rule set and their probe."""

    def __init__(self, stem: str):
        kinds = ("<u8", _ROW, np.uint8, "<u4", "<u4")
        # an empty file can't be mapped
        mapped = [np.memmap(stem + p, dtype=k, mode="r") if os.path.getsize(stem + p) else np.zeros(0, k) for p, k in zip(_PARTS, kinds, strict=True)]
        self.digests, self.rows, self.text, paths, hosts = mapped
        self.lengths, self.hosts = paths.tolist(), hosts.tolist()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        first = np.searchsorted(self.digests, wanted, "left")
        met = np.nonzero(first < len(self.digests))[0]
        met = met[self.digests[first[met]] == wanted[met]]
        for k in met:
            row = int(first[k])
            while row < len(self.digests) and self.digests[row] == wanted[k]:
                at, n = int(self.rows["offset"][row]), int(self.rows["length"][row])
                if self.text[at : at + n].tobytes() == keys[k]:
                    out[k] = row
                    break
                row += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """For each URL the longest rule that fits it, with its verdict."""
        keys: dict[bytes, int] = {}
        mine: list[list[tuple[int, int, int]]] = []
        for host, path in zip(hosts, paths, strict=True):
            found = []
            for m in self.hosts:
                # a suffix that no rule could have, or that begins inside a label
                if not 0 < m <= len(host) or (m < len(host) and host[-m - 1] != "."):
                    continue
                for n in self.lengths:
                    if n <= len(path):
                        key = f"{host[-m:]}{path[:n]}"
                        found.append((len(key), m, keys.setdefault(key.encode(), len(keys))))
            mine.append(found)
        rows = self.probe(names := list(keys))
        out = []
        for found in mine:
            best = max((f for f in found if rows[f[2]] >= 0), default=None)
            out.append(best and (names[best[2]].decode(), VERDICTS[self.rows["verdict"][rows[best[2]]]]))
        return out


@lru_cache(maxsize=256)
def _opened(name: str) -> Digests:
    return Digests(SparkFiles.get(name + _PARTS[0]).removesuffix(_PARTS[0]))


def publish(spark: SparkSession, rules: Rules | DataFrame, most_bytes: int = MOST_BYTES) -> list[str]:
    """Give the executors the files of a rule set; returns the names that ``_opened`` takes.

    A table of rules of more than ``most_bytes`` is cut by the rules' digests, and one part after another is built.
    """
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 24), F.lit(0))).first()[0]
        parts = -(-size // most_bytes) or 1
        dealt = F.pmod(F.xxhash64("rule"), F.lit(parts))
        return [_send(spark, build(rules_of(rules.where(dealt == part)))) for part in range(parts)]
    files = build(rules)
    if (size := sum(map(len, files))) > most_bytes:
        raise ValueError(f"the rules take {size} bytes, more than {most_bytes}; give them as a table")
    return [_send(spark, files)]


def _send(spark: SparkSession, files: tuple[bytes, ...]) -> str:
    stem = fresh_path(spark, "digests")
    for end, data in zip(_PARTS, files, strict=True):
        spark.sparkContext.addFile(write_bytes(spark, stem + end, data))
    return os.path.basename(stem)


def _longest(found: tuple) -> tuple[str, str] | None:
    """Of the rules that parts of one set have found, the one that counts."""
    return max((f for f in found if f), key=lambda f: (len(f[0]), f[0].index("/")), default=None)


def judge(pages: DataFrame, rules: Rules | DataFrame, default: str = "allow", url: str = "url", hidden: Rules | DataFrame = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are reported in ``rule``.  ``hidden`` is the operator's own list
    (such as a published block list): where no reported rule fits, it gives the
    verdict and ``rule`` stays null.
    """
    spark = pages.sparkSession
    names = [publish(spark, part, most_bytes) for part in (rules, hidden)]

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            hosts, paths = list(hosts), list(paths)
            first, second = ([_longest(f) for f in zip(*(_opened(n).judge(hosts, paths) for n in part), strict=True)] for part in names)
            verdicts = [a[1] if a else b[1] if b else default for a, b in zip(first, second, strict=True)]
            yield pd.DataFrame({"rule": pd.Series([a[0] if a else None for a in first], dtype=object), "verdict": verdicts})

    found = spare(pages, "found__")
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(found, look_up("host", "path"))
    return out.withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.col(f"{found}.verdict")}).drop(found)
