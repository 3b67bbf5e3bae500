import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, skew, trie

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie of (conv_id, turn, role, text) rows by a table of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * words
    return sorted(
        (
            min(m),
            len(path),
            min(members[path[:-1]]) if path else None,
            len(m),
            children[path],
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


def found(rows, **options):
    return sorted(tuple(r) for r in trie.nodes(trie.shared_starts(trie.encode(rows)), **options).select(*trie.RESULT).collect())


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_conversation_trie(spark, SF).select(*trie.RESULT).collect()) == brute(rows)


def made(n=160):
    """Common starts of several depths, copies, one long conversation, nulls and ties."""
    rows = []
    for c in range(n):
        start = ["hello there"] * 3 if c % 3 else ["hello there", f"case {c % 2}"]
        own = [*start, *(f"turn {c % 5} {k}" for k in range(c % 4)), *([f"only {c}"] if c % 7 == 0 else [])]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(own)]
    rows += [(500, k, "user", f"step {k}") for k in range(90)]
    rows += [(501, None, None, None), (501, 0, "user", None), (501, 0, "assistant", "tie"), (501, 0, "assistant", "tie"), (502, 1, None, "")]
    rows += [(None, 0, "user", "nobody"), (-7, 0, "user", "hello there"), (777, 0, "user", "x" * 200_000), (798, 3, "user", " \t ")]
    return rows


@pytest.mark.parametrize("local,share", [(1, 512), (8, 4), (40, 512), (100_000, 512)])
def test_rounds_against_brute_force(spark, monkeypatch, local, share):
    monkeypatch.setattr(skew, "SHARE", share)
    rows = made()
    table = spark.createDataFrame(rows, KIND).repartition(5).withColumns({"ids": F.lit(1), "conv": F.lit("x"), "next": F.lit(2), "key": F.lit(3)})
    assert found(table, local=local) == brute(rows)


def test_long_lists_of_ends_are_chained(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 64)
    rows = [(c * 4, 0, "user", "same") for c in range(25_000)]
    got = found(spark.createDataFrame(rows, KIND))
    assert got == brute(rows)


def test_one_hot_start_goes_through_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 16)
    rows = [(c * 20, k, "user", t) for c in range(300) for k, t in enumerate(["hi", "hi", f"branch {c % 3}", f"own {c}", "bye"])]
    assert found(spark.createDataFrame(rows, KIND), local=8) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark.createDataFrame([], KIND)) == []
    # 21 keeps nothing of its own one turn where h > 0, and has no base
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    assert found(spark.createDataFrame(rows, KIND)) == brute(rows)
