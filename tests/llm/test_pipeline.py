"""The pipeline's stages against what they may and may not change."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from millrace.llm import mixing, near_dedup, quality, secrets
from millrace.storage import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(12)
    words = ["".join(random.choice("aeioubcdfg") for _ in range(random.randint(3, 7))) for _ in range(4000)]
    stop = "the of and to in a is it".split()
    text = lambda n: " ".join(random.choice(stop if random.random() < 0.3 else words) for _ in range(n))
    clean = [text(random.randint(30, 90)) for _ in range(60)]
    copies = [clean[0], clean[1].replace(" the ", " a ", 1), clean[2] + " end"]
    junk = ["", None, "too short", "x### y*** " * 30, "same line of the text\n" * 30]
    leaks = [text(30) + " token=Zq81mmXb72kLp900 " + text(10)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate([*clean, *copies, *junk, *leaks])]
    return spark.createDataFrame(rows, SCHEMA), len(clean), len(copies), len(junk)


def test_stages(spark, corpus):
    docs, n_clean, n_copies, n_junk = corpus
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality rules", "near-duplicate removal", "secret scans", "mixing sources", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = materialize(stage(spark, docs, ""), "test-stage")
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in out[name].collect())
    leak = n_clean + n_copies + n_junk
    assert ids("quality rules") == [*range(n_clean + n_copies), leak]
    assert ids("near-duplicate removal") == [*range(n_clean), leak] == ids("secret scans")
    before = {r.doc_id: r.text for r in out["near-duplicate removal"].collect()}
    after = {r.doc_id: r.text for r in out["secret scans"].collect()}
    assert {i for i in before if before[i] != after[i]} == {leak} and "token=[secret] " in after[leak]
    mixed = mixing.mix(out["secret scans"])
    assert out["mixing sources"].count() == sum(r.copies for r in mixed.collect())
    assert {r.doc_id for r in out["packing"].collect()} == set(ids("mixing sources"))


def test_run_applies_every_stage(spark, corpus, tmp_path):
    docs = corpus[0]
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}")
    kept = {r.doc_id for r in near_dedup.keep_one(quality.keep_clean(docs)).collect()}
    assert {r.doc_id for r in packed.collect()} <= kept


def test_pipeline_matches_a_brute_force(spark):
    """Every document of sf0.001, stage by stage: SQL for rules and mixing, loops for classes, verdicts and tokens."""
    import duckdb
    from tokenizers import Tokenizer

    from millrace.llm.queries import oracle_sql, vocabulary

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{path}/documents.parquet'")
    kept = con.execute(f"SELECT d.* FROM documents d JOIN ({oracle_sql()['op6_quality_rules']}) q USING (doc_id) WHERE kept ORDER BY doc_id").df()
    words = near_dedup.Words()
    hashes, root = [words(t) for t in kept.text], list(range(len(kept)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(hashes):
        for j in range(i):
            b = hashes[j]
            if kept.text[i] == kept.text[j] or near_dedup.similar((a >> 16).astype("u4"), (b >> 16).astype("u4")):
                one, two = sorted((top(i), top(j)))
                root[two] = one
    kept = kept[[top(i) == i for i in range(len(kept))]].reset_index(drop=True)
    spans = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(kept)).collect()}
    holders = {}
    for doc_id, source in zip(kept.doc_id, kept.source, strict=True):
        for s in spans[doc_id]:
            holders.setdefault(secret_hash(s.value), set()).add((source, doc_id))
    copied = {v for v, h in holders.items() if len({o for o, _ in h}) >= 3 or len(h) >= 100}

    def clean(doc_id, text):
        live = {s.value for s in spans[doc_id] if len(s.value) >= 8 and len(set(s.value)) >= 6 and secret_hash(s.value) not in copied}
        for value in sorted(live, key=lambda v: (len(v), v), reverse=True):
            text = text.replace(value, "[secret]")
        return text

    kept["text"] = [clean(i, t) for i, t in zip(kept.doc_id, kept.text, strict=True)]
    con.execute("DROP TABLE documents")
    con.execute("CREATE TABLE documents AS SELECT * FROM kept")
    copies = {i: t // n for i, n, t in con.execute(f"SELECT doc_id, size, taken FROM ({oracle_sql()['op3_source_mixing']})").fetchall() if n}
    full = Tokenizer.from_file(vocabulary())
    expected = {i: copies[i] * (len(full.encode(t, add_special_tokens=False).ids) + 1) for i, t in zip(kept.doc_id, kept.text, strict=True) if copies.get(i)}
    got = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == expected


def secret_hash(value):
    return hashlib.sha256(re.sub(r"\s|\\[nr]", "", value).encode()).hexdigest()


def test_stages_of_an_empty_table(spark, corpus):
    docs = corpus[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "test-empty")
        assert docs.count() == 0
