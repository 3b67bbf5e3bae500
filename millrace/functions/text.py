"""Text functions as Column expressions; Python runs only where a text isn't already in normal form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of the tokenisers and the Bengali stop words.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BM25_MARKS = "।॥—‘’“”"
BENGALI_MARKS = "।॥৷৸"
SENTENCE_ENDS = ".!?।॥"
BENGALI_STOPWORDS = tuple(
    """
    এ একটি একটা এক থেকে এবং কিন্তু আর ও তবে যদি যে যা যায় যাবে হয় হয়ে হয়েছে হবে হিসেবে হল করা করে করেন করার
    দিয়ে দিয়েছে দিয়ে দিয়া নিয়ে নিয়েছে নেওয়া না নয় নি নিল নাহলে ছিল ছিলেন ছে সে সেই বলা বলে বলেন বা বাড়া সাথে
    সম্পর্কে বিষয়ে সব সর্ব সর্বাই প্রতি তার তারা তারার তাদের আমার আমাদের আমি আমরা আপনার আপনি আপনাদের কে কার কারণ
    কি কী যেতে দিকে মধ্যে জন্য হোক থাকে থাকা থাকার তাই তাহলে পরে আগে পর পদ্ধতি এই ওই কোনো যেকোনো
    ০ ১ ২ ৩ ৪ ৫ ৬ ৭ ৮ ৯
    """.split()
)
JOINERS = "‌‍"

#: Letters that NFKC leaves alone wherever they stand, beside ASCII.
_SETTLED = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def settled(text: Column) -> Column:
    """Whether a text is ASCII and Latin-1 letters only; long character classes would cost more than counting bytes."""
    rest = F.translate(text, _SETTLED, "")
    return (F.octet_length(text) == F.length(text)) | (F.octet_length(rest) == F.length(rest))


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often a lambda in ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts with other than settled characters go through Python."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(~settled(text), text)), text)


def normalise(text: Column) -> Column:
    """NFKC, then every line end as a line feed."""
    return F.regexp_replace(nfkc(text), "\\r\\n?", "\n")


def squeeze(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(fields(text), " ")


def runs(text: Column, outside: str) -> Column:
    """Runs of other than the given characters, as an array."""
    return F.array_remove(F.split(F.translate(text, outside, " " * len(outside)), " "), "")


def bm25_tokens(text: Column, compose: bool = True) -> Column:
    """Lower-cased runs of what is neither white space nor punctuation."""
    lowered = F.lower(text)
    return runs(nfkc(lowered) if compose else lowered, SPACE_CHARS + ASCII_PUNCTUATION + BM25_MARKS)


_BM25_BREAKS = str.maketrans(dict.fromkeys(ASCII_PUNCTUATION + BM25_MARKS, " "))
_LATIN_BREAKS = bytes.maketrans(ASCII_PUNCTUATION.encode(), b" " * len(ASCII_PUNCTUATION))


def bm25_words(lowered: str, compose: bool = True) -> list[str]:
    """The tokens of ``bm25_tokens`` of a text already in lower case; Python splits at the same white space."""
    if compose and not lowered.isascii():
        lowered = unicodedata.normalize("NFKC", lowered)
    try:
        return lowered.encode("latin-1").translate(_LATIN_BREAKS).decode("latin-1").split()
    except UnicodeEncodeError:
        return lowered.translate(_BM25_BREAKS).split()


def _keep_joiners(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else "".join(p if p in JOINERS else unicodedata.normalize("NFKC", p) for p in _split(t)))


def _split(text: str) -> list[str]:
    parts = [""]
    for char in text:
        if char in JOINERS:
            parts += [char, ""]
        else:
            parts[-1] += char
    return [p for p in parts if p]


def view(text: Column) -> Column:
    """NFKC between zero-width joiners, which stay; offsets always refer to the raw text."""
    return F.pandas_udf(_keep_joiners, "string")(text)


def bengali_tokens(text: Column, drop_stopwords: bool = False, compose: bool = True) -> Column:
    """Tokens of the view in lower case, by the Bengali class of punctuation; repeats stay."""
    tokens = runs(F.lower(view(text) if compose else text), SPACE_CHARS + ASCII_PUNCTUATION + BENGALI_MARKS)
    return F.filter(tokens, lambda x: ~x.isin(list(BENGALI_STOPWORDS))) if drop_stopwords else tokens


def word_runs(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case; combining marks end a run."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces after sentence ends, as they are."""
    return F.split(text, f"(?<=[{SENTENCE_ENDS}])[{SPACES}]+")


def clean_sentences(text: Column) -> Column:
    """Sentences without outer white space; empty ones go."""
    trimmed = F.transform(sentences(text), lambda x: strip(x))
    return F.filter(trimmed, lambda x: x != "")


def lower_each(text: Column) -> Column:
    """Lower case of each character by itself: a sigma at a word's end is no other letter, and a dotted I becomes one character."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def fields(text: Column) -> Column:
    """Runs of other than white space."""
    return runs(text, SPACE_CHARS)


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded up, at least one; none for an empty text."""
    words = F.size(fields(text))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(words * F.lit(1.3)).cast("int")))


def trigrams(text: Column) -> Column:
    """Character trigrams of the squeezed lower-case text; a shorter text is its own gram."""

    def grams(t: Column) -> Column:
        # characters as an array, since each substring would be looked for from the text's beginning
        chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
        every = let(chars, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
        return F.when(F.length(t) >= 3, every).otherwise(F.filter(F.array(t), lambda x: x != ""))

    return let(squeeze(F.lower(text)), grams)
