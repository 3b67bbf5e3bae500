"""Near duplicates, mixing, search, packing and sharding against brute force and on odd rows."""

import collections
import json
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.llm import graph, mixing, near_dedup, packing, sharding, skew, topk
from millrace.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, source string"


# near duplicates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    random.seed(1)
    for _ in range(4000):
        a = [random.randint(0, 3) for _ in range(random.randint(0, 14))]
        b = list(a)
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choice([[], [9], [1, 2]])
        most, true = random.randint(0, 8), edit_distance(a, b)
        got = near_dedup.distance_within(np.array(a, np.uint32), np.array(b, np.uint32), most)
        assert got == true if true <= most else got > most, (a, b, most)


def near_texts():
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = []
    for group in range(6):
        base = [word() for _ in range(random.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(25 if group == 0 else 2):
            copy = list(base)
            for _ in range(2):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} {' '.join(word() for _ in range(n))}" for n in (3, 5, 14, 16, 18, 40, 41, 42, 90, 95, 100)]
    texts += [texts[0], texts[0], None, "", "", "  ", "one two", "one two.", "Alone."]
    return texts


def naive_classes(texts):
    words = near_dedup.Words()
    w = [words(t or "") for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(w[i]), len(w[j]))
            same = (texts[i] or "") == (texts[j] or "")
            if same or (longer and len(set(near_dedup.kmers(w[i])) & set(near_dedup.kmers(w[j]))) and edit_distance(w[i].tolist(), w[j].tolist()) <= near_dedup.allowed(longer)):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(least.get(top(i), i), i)
    return [least[top(i)] for i in range(len(texts))]


@pytest.mark.parametrize("block, share", [(near_dedup.BLOCK, skew.SHARE), (4, 3)])
def test_classes_match_brute_force(spark, monkeypatch, block, share):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(skew, "SHARE", share)
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.label(df).collect()}
    assert [got[i] for i in range(len(texts))] == naive_classes(texts)


def test_small_tables_are_few_files_at_many_partitions(spark, monkeypatch):
    texts, files = near_texts(), {}
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)

    def counted(table, tag):
        out = storage.materialize(table, tag)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(graph, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.class_id for r in near_dedup.label(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[i] for i in range(len(texts))] == naive_classes(texts)
    small = ["buckets", "members", "texts", "pairs", "links", "split", "hopeful", "classes"]
    assert all(files[f"near-{tag}"] <= 1 for tag in small) and files["edges"] <= 1, files


@pytest.mark.parametrize("spaced, low, high", [(True, 0, 0), (False, 0.6, 0.76)])
def test_recall_at_the_limit_of_similarity_is_as_the_readme_says(spaced, low, high):
    rng, met = np.random.default_rng(8), 0
    for _ in range(500):
        base = rng.integers(1, 1 << 62, 100, dtype=np.uint64)
        copy = base.copy()
        at = np.arange(4, 100, 5) if spaced else rng.choice(100, 20, replace=False)
        copy[at] = rng.integers(1, 1 << 62, 20, dtype=np.uint64)
        met += len(np.intersect1d(*(near_dedup.order_minhash(near_dedup.kmers(x)) for x in (base, copy)))) > 0
    assert low * 500 <= met <= high * 500


def test_keep_one_keeps_a_row_of_each_class(spark):
    texts = near_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], None), (None, "only here", None), (None, "only here", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit(7))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(naive_classes(texts))) and ids.count(None) == 1
    assert near_dedup.keep_one(df.limit(0)).count() == 0 and near_dedup.label(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [skew.SHARE, 2])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "SHARE", share)
    monkeypatch.setattr(graph, "FEW", 0 if share == 2 else graph.FEW)
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in root if top(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few, most", [(graph.FEW, 800), (100, 900)])
def test_small_components_take_few_tasks_of_many_partitions(spark, monkeypatch, few, most):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i % 2, 10 + i // 2) for i in range(600)] + [(1000 + i, 1001 + i) for i in range(8)]
    given = spark.createDataFrame(edges, "a long, b long")
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    sc.setJobGroup(f"components-{few}", "counted")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = graph.components(given)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(f"components-{few}") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert {(r.node, r.root) for r in found.collect()} == {(1, 0)} | {(10 + i, 0) for i in range(300)} | {(1001 + i, 1000) for i in range(8)}
    assert 0 < tasks < most, tasks


def test_edges_after_some_rounds_have_the_same_components(spark):
    given = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(i, i + 1) for i in range(100, 110)], "a long, b long")
    some = graph.components(given, rounds=1)
    assert some.groupBy("node").agg(F.min("root").alias("root")).select("root").distinct().count() > 2
    found = graph.components(some.select(F.col("node").alias("a"), F.col("root").alias("b")))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 111)}


def test_hot_keys_are_dealt_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 10)
    rows = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, i) for i in range(9)] + [(3, 0)], "k int, x int")
    hot = skew.Hot(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n")
    salts = {r.k: r.n for r in hot.salt(rows, F.col("x")).groupBy("k").agg(F.count_distinct("salt").alias("n")).collect()}
    assert salts[1] > 90 and salts[2] == salts[3] == 1
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, y string")
    got = sorted((r.k, r.x, r.y) for r in hot.join(rows, table, F.col("x")).collect())
    assert got == sorted([(1, i, "a") for i in range(1000)] + [(2, i, "b") for i in range(9)])


def test_very_long_texts_are_aligned_whole(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(30_000)}" for _ in range(100_000)]
    near, far = list(base), list(base)
    for at in rng.sample(range(len(base)), 6000):
        near[at] = "changed"
    far[10_000:45_000] = [f"v{i}" for i in range(35_000)]
    df = spark.createDataFrame([(i, " ".join(t), "s") for i, t in enumerate((base, near, far))], SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("key", "text_key", "bucket", "class_id", "class_docs", "salt")})
    assert {r.doc_id: r.class_id for r in near_dedup.label(more).collect()} == {0: 0, 1: 0, 2: 2}


def test_query_finds_the_classes_of_a_brute_force(spark):
    from millrace.llm.queries import op2_near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    words, texts = near_dedup.Words(), {r.doc_id: r.text or "" for r in docs}
    kept = {i: words(t) for i, t in texts.items()}
    with_kmer = collections.defaultdict(list)
    for i, w in kept.items():
        for k in set(near_dedup.kmers(w).tolist()):
            with_kmer[k].append(i)
    pairs = {(a, b) for ids in with_kmer.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    numbers = {i: (w >> np.uint64(16)).astype(np.uint32) for i, w in kept.items()}
    same = collections.defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    pairs |= {(ids[0], other) for ids in same.values() for other in ids[1:]}
    for a, b in pairs:
        if texts[a] == texts[b] or near_dedup.similar(numbers[a], numbers[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.doc_id: r.class_id for r in op2_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: top(i) for i in texts} and len(set(got.values())) < len(got)


# mixing


def test_targets_reshare_what_a_full_source_cannot_hold(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, None: 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = {r.source: r for r in mixing.targets(df).collect()}
    assert [rows[s].weight for s in ("a", "b", "c", None)] == [1, 2, 3, 1]
    assert [rows[s].target for s in ("a", "c", None)] == [30, 60, 15]
    assert rows["b"].target == pytest.approx(1035 - 105)


def mixing_rows():
    random.seed(6)
    rows = []
    for i in range(600):
        source = random.choice(["x"] * 6 + ["y", "z", None])
        rows.append((i, " ".join("w" for _ in range(random.randint(0, 40))), source))
    return rows + rows[:5] + [(None, None, None), (None, "a b", "x"), (9999, "long " * 30_000, "y")]


def test_mix_meets_its_targets(spark):
    df = spark.createDataFrame(mixing_rows(), SCHEMA)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in rows))
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6
        assert {r.copies for r in rs if r.size} <= {rs[0].epochs, rs[0].epochs + 1}
    key = lambda r: tuple(map(str, r))
    for other in (mixing.mix(df.repartition(7)), mixing.mix(df, per_block=9), mixing.mix(df.repartition(3), per_block=1)):
        assert sorted(map(key, rows)) == sorted(map(key, other.collect()))


def test_no_block_holds_much_more_than_its_rows(spark):
    rows = [(i, 3, 1.0, "m") for i in range(3000)] + [(None, 3, 1.0, "same")] * 4000 + [(None, 3, 0.2, "alike")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, size long, w double, text_md5 string")
    key = -F.ln(mixing.uniform(1, F.col("doc_id"), F.col("text_md5"))) / F.col("w")
    df = df.withColumns({"key": key, "source": F.lit("s"), "rows": F.lit(len(rows)), "row": F.monotonically_increasing_id()})
    blocks = mixing._blocks(df, 250).groupBy("source", "bin", "sub", "part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()
    assert sum(r.n for r in blocks) == len(rows) and max(r.n for r in blocks) <= 2 * 250
    blocks.sort(key=lambda r: (r.bin, r["sub"], r.part))
    assert all(x.z <= y.a for x, y in zip(blocks, blocks[1:], strict=False))


def test_mixed_documents_come_as_often_as_taken(spark):
    df = spark.createDataFrame(mixing_rows(), SCHEMA).withColumn("size", F.lit("clash"))
    mixed = mixing.mix(df)
    expected = {(r.doc_id, r.source, r.text_md5): r.n for r in mixed.groupBy("doc_id", "source", "text_md5").agg(F.sum("copies").alias("n")).collect() if r.n}
    out = mixing.apply(df)
    got = {(r.doc_id, r.source, r.m): r.n for r in out.groupBy("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out.columns == df.columns and got == expected
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply(df.limit(0)).count() == 0


def test_better_documents_come_earlier(spark):
    rows = [(i, ("word### " if i % 2 else "word ") * 10, "a") for i in range(2000)]
    rows += [(10_000 + i, "w " * 10, "b") for i in range(200)]
    taken = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.avg("copies").alias("c")).collect()
    share = {r[0]: r.c for r in taken}
    assert share[0] > share[1]


# search


def brute_top(rows, k):
    ints = {}
    for i, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = (vec_id, [math.floor(256 * Fraction(x)) for x in v])
    out = []
    for q, qv in ints.values():
        if q % 50:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(qv, v, strict=True)), 1 - (1 << 63)), (1 << 63) - 1), i) for i, v in ints.values() if i != q and len(v) == len(qv))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_top_k_matches_brute_force(spark, shards):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(60)]  # one common vector
    rows += [(500, None), (550, []), (600, [float("nan")] * 6), (601, [None] * 6), (None, [1.0] * 6), (650, [1.0, 2.0]), (651, [3.0, 4.0]), (700, [1e5] * 6), (701, [1e30] * 6), (702, [1e7, -1e7, 1e300, 0.0, 0.0, -1e300]), (750, [1e9, 1e9, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, shards=shards).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_top(rows, 5)


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    for size in (1.0, 1e4, 1e6, 2.0**28, 1e12, 1e30, 1e305):
        q, c = rng.normal(size=(5, 4)) * size, rng.normal(size=(6, 4)) * size
        q[0], c[0] = [size, 1.0, -size, 0.0], [size, 2.0, size, 0.0]  # large terms that cancel
        got = topk.products(q, c, 256)
        whole = lambda row: [math.floor(256 * Fraction(x)) for x in row.tolist()]
        for i in range(5):
            for j in range(6):
                true = sum(a * b for a, b in zip(whole(q[i]), whole(c[j]), strict=True))
                assert got[i, j] == min(max(true, 1 - (1 << 63)), (1 << 63) - 1), (size, i, j)


def test_top_k_reads_only_its_columns(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    more = df.withColumns({c: F.lit("x") for c in ("id", "v", "query_id", "rank", "score", "dim", "n", "shard")})
    found = topk.top_k(more, more.where("vec_id = 0"), 2)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]


# packing


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("length", [16, 1024])
def test_packing_loses_and_pads_nothing(spark, length):
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "Straße über 東京 🙂", "a<|endoftext|>b", "x\u2003y\x1cz", "word " * 3000, "copy", "copy", "\n\n  tabs\t"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, "hello world", "s"), (None, "no id", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = packing.pack(df, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"), length, range_tokens=500).collect()
    full = Tokenizer.from_file(vocabulary())
    expected, got = collections.Counter(), collections.Counter()
    for doc_id, text, _ in rows:
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        expected[(doc_id, len(ids))] += len(ids)
    sequences = collections.defaultdict(list)
    for p in pieces:
        text = dict((r[0], r[1]) for r in rows)[p.doc_id]
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        got[(p.doc_id, p.doc_tokens)] += p.length
        sequences[p.sequence_id].append(p)
    assert got == expected
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        total = sum(p.length for p in parts)
        assert total <= length and total & (total - 1) == 0
    assert packing.pack(df.limit(0), vocabulary()).count() == 0


def test_pieces_depend_on_the_documents_alone(spark):
    random.seed(9)
    rows = [(i, random.choice(["some copied text " * 9, "other words " * random.randint(1, 40)]), "s") for i in range(300)]
    rows += [(None, "a row given many times", "s")] * 200 + [(7, None, None)] * 3 + [(8, "long text " * 4000, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = lambda some, **o: sorted(map(str, packing.pack(some, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"), **o).collect()))
    first = pieces(df, range_tokens=400)
    assert first == pieces(df, range_tokens=400) == pieces(df.repartition(1), range_tokens=400) == pieces(df.repartition(13), range_tokens=400)
    more = df.withColumns({c: F.lit("x") for c in ("curve", "ids", "range", "copies", "cell", "start", "tokens")})
    assert first == pieces(more, range_tokens=400)
    names = packing.pack(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), vocabulary())
    assert dict(names.dtypes)["doc_id"] == "string" and names.agg(F.sum("length")).first()[0] == packing.pack(df, vocabulary()).agg(F.sum("length")).first()[0]


def test_ranges_are_bounded_even_where_one_key_holds_everything(spark):
    rows = [(i, 5, 10, i, 2, b"") for i in range(3000)] + [(None, 5, 10, 1, 2, b"")] * 2000 + [(i, i << 14, 10, i, 2, b"") for i in range(500)]
    df = spark.createDataFrame(rows, f"doc_id long, {packing._ENCODED}")
    sizes = packing.ranged(df, 1000).groupBy("range").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()
    assert sum(r.n for r in sizes) == 55_000 and max(r.n for r in sizes) < 4000 and len(sizes) > 40


def test_packing_query_holds_every_id(spark):
    from tokenizers import Tokenizer

    from millrace.llm.queries import op8_curve_packing

    full, held = Tokenizer.from_file(vocabulary()), collections.defaultdict(list)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op8_curve_packing(spark, "/root/testdata/sf0.001").collect():
        held[r.doc_id].append(r)
    assert held.keys() == texts.keys()
    for doc_id, parts in held.items():
        ids = full.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]] and sum(r.length for r in parts) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts)


def test_fast_and_full_ids_agree():
    one = packing.Tokenizer(vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))
    other = packing.Tokenizer(vocabulary(), None)
    random.seed(8)
    letters = "ab é\u0301ßʼ'sdll ’“”…—\u00a0\u2003\x85\x1c\x1f\t\r\n09٣²½$€<|endoftext|>漢🙂"
    for _ in range(300):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        assert one.ids(text).tolist() == other.ids(text).tolist(), repr(text)


def test_ids_without_runs_of_white_space_need_no_look_ahead(monkeypatch):
    one = packing.Tokenizer(vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))
    other = packing.Tokenizer(vocabulary(), None)
    random.seed(9)
    parts = ["we're", "x'll", " ", "\n", "\t", "\u00a0", "12", "(a)", "\u2003", "\u00e9t\u00e9", "..."]
    for long in (packing.LONG, 8):
        monkeypatch.setattr(packing, "LONG", long)
        for n in range(300):
            words = [random.choice(parts) for _ in range(random.randint(0, 9))]
            if n % 2:
                words = [w for i, w in enumerate(words) if w.strip() or i and words[i - 1].strip()]
            text = "".join(words)
            assert one.ids(text).tolist() == other.ids(text).tolist(), repr(text)
    assert set(one.made) == {True, False}
    assert "?!" not in one.made[True]._pat_str and "?!" in one.made[False]._pat_str


# sharding


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=200_000, run=3, rows=50)
    whole = [(i, random.choice([None, "", "t" * (i % 90)]), "s") for i in range(900)] + [(1, "again", None), (1, "again", None)]
    df = spark.createDataFrame(whole, SCHEMA)
    for part in range(3):
        assert store.append(df.where(F.coalesce("doc_id", F.lit(0)) % 3 == part).coalesce(2)) == part + 1
    before = store.shards()
    version = store.compact()
    after = store.shards()
    assert version > 3 and len(after) < len(before) and not sharding.plan(after, 200_000, 3)
    for v in (3, version):
        assert sorted(map(str, store.read(v).collect())) == sorted(map(str, df.collect()))
    assert store.append(df.limit(0)) == version + 1
    assert store.vacuum() > 0 and store.read().count() == len(whole)
    with pytest.raises(ValueError):
        store.append(df.withColumn("more", F.lit(1)))


def test_shard_query_merges_arrivals_of_several_versions(spark, monkeypatch):
    from millrace.llm import queries

    options, make = [], sharding.ShardStore
    monkeypatch.setattr(sharding, "ShardStore", lambda *a, **b: options.append(b) or make(*a, **b))
    rows = queries.op9_shard_compaction(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.md5("text").alias("m")).collect()
    assert sorted((r.doc_id, r.text_md5) for r in rows) == sorted((r.doc_id, r.m) for r in docs)
    assert options == [{}] and {r.version for r in rows} == {queries.ARRIVALS + 1} and max(r.shard_rows for r in rows) > len(docs) / 2


def test_two_writers_and_leftovers(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one, two = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    df = spark.range(10)
    one.append(df)
    with pytest.raises(sharding.Conflict):
        two._commit(two.manifest(0), df.schema.json(), [])
    df.write.parquet(f"{root}/shards-lost")  # an append that died before its commit
    assert two.append(df) == 2 and two.read().count() == 20
    two.vacuum()
    assert not (tmp_path / "s" / "shards-lost").exists() and two.read().count() == 20
    assert json.loads((tmp_path / "s" / "manifest-00000002.json").read_text())["version"] == 2


def test_commits_write_what_they_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 6)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20, run=50)
    df = spark.createDataFrame([(0, "x" * 5_000_000, "clash"), (None, None, None)], "part long, shards string, manifest string")
    for k in range(9):
        store.append(df.withColumn("part", F.lit(k).cast("long")).coalesce(1))
        parts = store.manifest()["parts"]
        assert len(parts) <= 7 and sum(map(len, parts.values())) == k + 1
    assert store.read().count() == 18 and store.compact() == 9
    store.run = 2
    before, version = store.manifest(9)["parts"], store.compact()
    assert store.read(version).count() == 18 == store.read(9).count() and store.manifest(9)["parts"] == before
    assert store.read().agg(F.sum(F.length("shards"))).first()[0] == 9 * 5_000_000
    store.vacuum()
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("part-")]) == len(store.manifest()["parts"])


def test_compaction_raises_if_others_always_come_first(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", run=2)
    for _ in range(2):
        store.append(spark.range(5).coalesce(1))

    def lose(*_):
        raise sharding.Conflict("lost")

    monkeypatch.setattr(store, "_commit", lose)
    with pytest.raises(sharding.Conflict):
        store.compact(attempts=2)


def test_plan_groups_similar_sizes():
    shard = lambda n, size, born=1: sharding.Shard(str(n), size, 1, born)
    small, large = [shard(i, 100 + i) for i in range(6)], [shard(10 + i, 5000) for i in range(2)]
    merges = sharding.plan(small + large + [shard(99, 90_000)], target=100_000, run=4)
    assert [[s.name for s in m] for m in merges] == [[str(i) for i in range(6)]]
    assert sharding.plan([], 100) == []
