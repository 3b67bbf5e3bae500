"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` turns a text into counts, ``compile_rules`` turns rows of
(measure, low, high) into conditions, and ``judge`` applies both.
Everything is built-in functions; no shuffle, no Python on the executors.

Defined results: a null text has no words and counts zero everywhere, so the
base rule rejects it; an empty text likewise.  Ratios over nothing are 0.  A
value at a bound passes.  No rule bounds the length of a text from above.  An
empty table gives an empty one.
Repeated rows are judged one by one.  Columns of the input are kept unless
they bear the name of a new one.  Equal windows and
words are found by 64-bit hashes within one text, so cost grows with the
length of the text, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, spare, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent words of English, French, Spanish and German.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in a is that for it was on with as be by this are at from or an "
            "le la les de des du et en un une que qui dans pour par sur est avec au pas "
            "el y los del se las con no su al lo "
            "der die und den von zu das mit sich auf für ist im dem nicht ein eine als"
        ).split()
    )
)

#: (name, measure, least, most); None leaves a side open.  A document passes if every row holds.
RULES = (
    ("length", "n_words", 20, None),
    ("word length", "chars_per_word", 2.5, 12.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop words", "stop_ratio", 0.02, None),
    ("repeated lines", "dup_line_ratio", None, 0.4),
    ("stuttering words", "stutter_ratio", None, 0.3),
    ("words per line", "words_per_line", 1.5, None),
)


def measures(text: Column) -> Column:
    """A struct of the counts and ratios that the rules read.

    One expression with its intermediate arrays bound inside, so that a filter that the optimizer moves still computes them once.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    stop = [x for s in STOP_WORDS for x in (s, s.capitalize())]
    none = F.array().cast("array<long>")

    def windows(h: Column) -> Column:
        every = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), every)).otherwise(none)

    def counts(w: Column, h: Column, g: Column, ls: Column) -> Column:
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.regexp_replace(t, "[ \\t-\\r]+", "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_lines": F.size(ls),
            "n_repeat_words": F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)),
            "n_stop": F.size(F.filter(w, lambda x: x.isin(stop))),
            "n_stutter": F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1)))),
        }
        return F.struct(*(c.cast("long").alias(n) for n, c in found.items()))

    def ratios(c: Column) -> Column:
        per = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b]), F.lit(0.0))
        return F.struct(
            *(c[n].alias(n) for n in COUNTS),
            per("word_chars", "n_words").alias("chars_per_word"),
            per("n_symbols", "n_words").alias("symbols_per_word"),
            per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            per("n_stop", "n_words").alias("stop_ratio"),
            per("n_stutter", "n_words").alias("stutter_ratio"),
            per("n_words", "n_lines").alias("words_per_line"),
        )

    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    counted = let(words(t), lambda w: let(hashed(w), lambda h: let(windows(h), lambda g: let(lines, lambda ls: counts(w, h, g, ls)))))
    return let(counted, ratios)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop", "n_stutter")
RATIOS = ("chars_per_word", "symbols_per_word", "dup_line_ratio", "stop_ratio", "stutter_ratio", "words_per_line")
VERDICTS = ("base_failed", "failed_rules", "kept")


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: sort by hash, keep equal neighbours, join their extents."""

    def starts(s: Column) -> Column:
        same = lambda e, i, d: F.coalesce(F.get(s, i + d)["h"] == e["h"], F.lit(False))
        twice = F.filter(s, lambda e, i: ((i > 0) & same(e, F.greatest(i, F.lit(1)), -1)) | same(e, i, 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def extent(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(ordered, starts), extent)


def compile_rules(measure, rules=RULES) -> dict[str, Column]:
    """Each rule's name with the condition under which a document fails it; ``measure`` gives a measure's column by name."""
    out = {}
    for name, column, least, most in rules:
        low = measure(column) < least if least is not None else F.lit(False)
        high = measure(column) > most if most is not None else F.lit(False)
        out[name] = low | high
    return out


def verdict(text: Column, rules=RULES, base_words: int = 20, base_repeat: int = 30) -> Column:
    """A struct of the measures, ``base_failed``, ``failed_rules`` (names) and ``kept``."""

    def decide(m: Column) -> Column:
        base = (m["n_words"] < base_words) | (100 * m["n_repeat_words"] > base_repeat * m["n_words"])
        failed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in compile_rules(lambda x: m[x], rules).items())))
        kept = ~base & (F.size(failed) == 0)
        return F.struct(*(m[n].alias(n) for n in (*COUNTS, *RATIOS)), base.alias("base_failed"), failed.alias("failed_rules"), kept.alias("kept"))

    return let(measures(text), decide)


def judge(docs: DataFrame, text: str = "text", rules=RULES, base_words: int = 20, base_repeat: int = 30) -> DataFrame:
    """The input's rows with their measures, ``base_failed``, ``failed_rules`` and ``kept``; columns of those names are replaced."""
    j = spare(docs, "j__")
    new = (*COUNTS, *RATIOS, *VERDICTS)
    out = docs.withColumn(j, verdict(F.col(text), rules, base_words, base_repeat))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new), *(F.col(j)[n].alias(n) for n in new))


def keep_clean(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return docs.where(verdict(F.col(text), rules)["kept"])
