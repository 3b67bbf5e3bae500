import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, special, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [
        ("FastAPI & Python 3.12!", ["fastapi", "python", "3", "12"]),
        ("fastapi_router.py", ["fastapi", "router", "py"]),
        ("", []),
        ("আমি। ভাত—খাই", ["আমি", "ভাত", "খাই"]),
        ("ﬁne １２", ["fine", "12"]),
    ],
)
def test_bm25_tokens(spark, given, tokens):
    expected = [unicodedata.normalize("NFKC", t) for t in tokens]
    assert one(spark, text.bm25_tokens(F.col("t")), t=given) == expected


def test_bengali_tokens_keep_dashes_and_drop_stop_words(spark):
    assert one(spark, text.bengali_tokens(F.col("t"), compose=False), t="ক—খ। গ") == ["ক—খ", "গ"]
    assert one(spark, text.bengali_tokens(F.col("t"), drop_stopwords=True, compose=False), t="এবং ঘর এবং বই") == ["ঘর", "বই"]


def test_view_keeps_joiners(spark):
    assert one(spark, text.view(F.col("t")), t="ﬁ‍x‌ﬂ") == "fi‍x‌fl"


def test_word_runs_split_at_marks(spark):
    assert one(spark, text.word_runs(F.col("t")), t="আর্কটিক a_b C3") == ["আর", "কট", "ক", "a_b", "c3"]


def test_sentences(spark):
    assert one(spark, text.clean_sentences(F.col("t")), t="One. Two!  তিন। ") == ["One.", "Two!", "তিন।"]


@pytest.mark.parametrize(("given", "n"), [("", 0), (" ", 1), ("a", 2), ("a b c", 4), ("a b c d e f g h i j", 13)])
def test_token_estimate(spark, given, n):
    assert one(spark, text.token_estimate(F.col("t")), t=given) == n


def test_trigrams(spark):
    assert one(spark, text.trigrams(F.col("t")), t=" Ab  cd ") == ["ab ", "b c", " cd"]
    assert one(spark, text.trigrams(F.col("t")), t="Ab") == ["ab"]


def test_t_distribution():
    assert special.t_two_tailed(2.228138837856, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.t_two_tailed(0, 10) == 1
    assert special.t_two_tailed(1, 0) != special.t_two_tailed(1, 0)
    for df, value in ((10, 2.228139), (30, 2.042272), (1000, 1.962339)):
        assert special.t_critical(df) == pytest.approx(value, abs=1e-6)


def test_wilcoxon():
    assert special.wilcoxon([0.0, 0.0]) == (0.0, 1.0, "degenerate")
    assert special.wilcoxon([0.1, 0.2, 0.3, 0.4, 0.5]) == (0.0, 0.0625, "exact")
    w, p, method = special.wilcoxon([float(i) for i in range(1, 26)])
    assert (w, method) == (0.0, "asymptotic") and p < 0.001


def test_ids_are_hashes_of_content(spark):
    a = one(spark, hashing.chunk_id(F.lit("d"), F.lit(0), F.col("t")), t=" x ")
    assert a == hashing.sha256_text("d:0:x")
    assert hashing.benchmark_hash([{"query_id": "b"}, {"query_id": "a"}]) == hashing.benchmark_hash([{"query_id": "a"}, {"query_id": "b"}])
    assert hashing.cache_hash("d", "v", {"a": 1}, "x") != hashing.cache_hash("d", "v", {"a": 1}, "y")
