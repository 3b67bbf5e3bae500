import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, queries, skew

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[ \\t-\\r]+", " ", text or "")].append(doc_id)
    out = []
    for content, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), stays, hashlib.sha256(content.encode()).hexdigest()))
            stays = False
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in exact_dedup.label(docs, **options).collect()), key=repr)


CASES = [
    (1, "a b"),
    (2, "a\t\n b"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "\x0b\x0c"),
    (7, "a b"),
    (8, " a b"),
    (9, "A b"),
    (9, "A b"),
    (9, "A b"),
    (None, "a b"),
    (None, "lone"),
    (None, "lone"),
    (10, "x" * 3_000_000),
    (11, "x" * 3_000_000),
    (12, "x" * 2_999_999 + "y"),
]


def test_cases(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").withColumns({"row": F.lit(1), "DIGEST": F.lit("z"), "salt": F.lit(0), "keep_id": F.lit(1)})
    assert found(docs) == brute(CASES)


@pytest.mark.parametrize("share", [2, 512])
def test_weak_digests_are_told_apart_by_content(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "SHARE", share)
    rows = [(i, "same" if i % 3 == 0 else f"other {i % 7}") for i in range(200)] + CASES[:14]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(docs, digest=lambda c: F.lit("all"))
    assert [r[:4] for r in got] == sorted((r[:4] for r in brute(rows)), key=repr)


def test_hot_groups_meet_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 8)
    rows = [(i, "hot  text" if i % 2 else f"text {i % 50}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert found(docs) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([tuple(r) for r in docs])
