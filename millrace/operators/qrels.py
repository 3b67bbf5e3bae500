"""Gold passages to relevant chunks.

Passages have passage (a key), query_id, doc_id, snippet and, where known, start_char and end_char; chunks have
chunk_id, doc_id, content, start_char, end_char.  Offsets known on both sides decide alone; the text rules
(containment, a phrase of four words, half of the words) serve where an offset is missing.  Candidates come by
equi-joins on rare terms where the rule allows it, so no rule compares every passage with every chunk's text
unless the passage names no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let, squeeze, word_runs
from millrace.storage import materialize

PHRASE = 4
#: Characters by which a word is looked for among words.
GRAM = 4
COMMON, SHARE = 3, 0.5
#: Words in common beyond one before a pair is counted in full, and words of passages that may be broadcast.
MORE, MANY = 3, 1 << 18
SHORT = 15
#: Characters of passages that may be broadcast.
BROADCAST = 1 << 21


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained_pairs(inner: DataFrame, outer: DataFrame, a: str, b: str, blank: bool = False) -> DataFrame:
    """(a, b) of texts of ``inner`` (a, text) that lie in texts of ``outer`` (b, text), by equi-joins.

    A text's longest run without spaces lies in one word of the other text.  It meets the distinct words of all outer
    texts by its rarest ``GRAM`` characters (by all of it if it is shorter), words meet the texts that hold them, and
    these are searched.  An empty text, or one of spaces, has no such run; with ``blank`` it is held against all.
    """
    fragments = F.sort_array(F.transform(F.split("text", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False)
    short = inner.select(a, F.col("text").alias("inner_text"), fragments[0]["w"].alias("part")).where("inner_text IS NOT NULL")
    listed = outer.select(b, F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word <> ''")
    held = listed.select("word").distinct()
    parts = short.where("part <> ''").select("part").distinct().withColumn("size", F.least(F.lit(GRAM), F.length("part")))
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # at most GRAM
    if not sizes:
        sizes = [GRAM]
    every = F.concat(*(_grams(F.col("word"), F.lit(n)) for n in sizes))
    grams = held.select("word", F.explode(every).alias("gram"))
    asked = parts.select("part", F.explode(_grams(F.col("part"), F.col("size"))).alias("gram"))
    grams = materialize(grams.join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    rarest = asked.join(common, "gram").groupBy("part").agg(F.min(F.struct("words", "gram")).alias("m"), F.count(F.lit(1)).alias("met"), F.max(F.size(_grams(F.col("part"), F.least(F.lit(GRAM), F.length("part"))))).alias("all"))
    # a part with a run of characters that no word has is in none
    probes = rarest.where("met = all").select("part", F.col("m.gram").alias("gram"))
    words = probes.join(grams, "gram").where(F.col("word").contains(F.col("part"))).select("part", "word")
    near = words.join(listed, "word").select("part", b).distinct()
    whole = outer.select(b, F.col("text").alias("outer_text"))
    found = short.join(near, "part").join(whole, b).where(F.col("outer_text").contains(F.col("inner_text"))).select(a, b)
    if not blank or (spaces := short.where("part = ''")).isEmpty():
        return found
    spaces = spaces.crossJoin(whole).where(F.col("outer_text").contains(F.col("inner_text"))).select(a, b)
    return found.unionByName(spaces)


def _named(passages: DataFrame, chunks: DataFrame, filename: str | None = None) -> DataFrame:
    """(passage, chunk_id) of equal doc_id or filename, or the id inside the chunk_id.

    An empty id lies in every chunk_id; its pairs are not listed, since passages that name nothing have all chunks anyway.
    """
    wanted = passages.select("passage", F.col("doc_id").alias("wanted")).where(F.col("wanted").cast("string") != "")
    named = wanted.join(chunks, F.col("wanted") == F.col("doc_id")).select("passage", "chunk_id")
    if filename:
        named = named.unionByName(wanted.join(chunks, F.col("wanted") == F.col(filename)).select("passage", "chunk_id"))
    ids = wanted.select(F.col("wanted").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    texts = chunks.select("chunk_id", F.col("chunk_id").cast("string").alias("text"))
    inside = contained_pairs(ids.withColumn("id", F.col("text")), texts, "id", "chunk_id", blank=True)
    named = named.unionByName(wanted.join(inside, F.col("wanted").cast("string") == F.col("id")).select("passage", "chunk_id")).distinct()
    return materialize(named, "named-chunks")


def _unnamed(passages: DataFrame, named: DataFrame) -> DataFrame:
    return passages.join(named.select("passage").distinct(), "passage", "left_anti").select("passage")


def candidates(passages: DataFrame, chunks: DataFrame, filename: str | None = None) -> DataFrame:
    """Chunks of the passage's document: equal doc_id or filename, or the id inside the chunk_id; all chunks where none match."""
    named = _named(passages, chunks, filename)
    return named.unionByName(_unnamed(passages, named).crossJoin(chunks.select("chunk_id")))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0) > 0


def span_matches(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(passage, chunk_id) of one document whose character spans overlap."""
    p, c = passages.alias("p"), chunks.alias("c")
    hit = overlaps(F.col("p.start_char"), F.col("p.end_char"), F.col("c.start_char"), F.col("c.end_char"))
    return p.join(c, (F.col("p.doc_id") == F.col("c.doc_id")) & hit).select("p.passage", "c.chunk_id")


def containment(snippet: Column, content: Column) -> Column:
    """The snippet lies in the chunk, or a chunk of some length lies in the snippet; white space squeezed."""
    s, c = squeeze(F.lower(snippet)), squeeze(F.lower(content))
    return ((s != "") & c.contains(s)) | ((F.length(c) > SHORT) & s.contains(c))


def _inner_phrase(text: Column) -> Column:
    """The second to fifth of a text's words, without the last: whole words wherever the text lies; null for one or two words."""
    words = F.split(text, " ")
    return F.when(F.size(words) >= 3, F.array_join(F.slice(words, 2, F.least(F.size(words) - 2, F.lit(PHRASE))), " "))


def _few_in_many(few: DataFrame, many: DataFrame, small: bool) -> DataFrame:
    """(passage, chunk_id) of passages' texts inside chunks' texts.

    A text of three or more words is looked for where its inner word of fewest chunks is; shorter ones are looked for by
    characters.  ``small`` passages are broadcast, so that chunks are searched where they are read.
    """
    split = F.split("text", " ")
    inner = few.where(F.size(split) >= 3).select("passage", F.explode(F.array_distinct(F.slice(split, 2, F.size(split) - 2))).alias("word"))
    wanted = inner.select("word").distinct()
    held = F.explode(F.array_distinct(split)).alias("word")
    listed = many.select(held).join(F.broadcast(wanted) if small else wanted, "word", "left_semi")
    frequency = listed.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = inner.join(frequency, "word", "left").groupBy("passage").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("m"))
    probes = materialize(rarest.join(few, "passage").select("passage", F.col("m.word").alias("word"), F.col("text").alias("inner_text")), "gold-words")
    if small:
        found = many.select("chunk_id", "text", held).join(F.broadcast(probes), "word")
    else:
        near = many.select("chunk_id", held).join(probes.select("word", "passage"), "word")
        found = near.join(many, "chunk_id").join(probes.drop("word"), "passage")
    found = found.where(F.col("text").contains(F.col("inner_text"))).select("passage", "chunk_id")
    short = few.where(F.size(split) < 3)
    return found if short.isEmpty() else found.unionByName(contained_pairs(short, many, "passage", "chunk_id"))


def _many_in_few(many: DataFrame, few: DataFrame, small: bool, longest: int) -> DataFrame:
    """(passage, chunk_id) of chunks' texts inside passages' texts: only chunks no longer than a passage, met by one phrase each."""
    brief = many.where((F.length("text") > SHORT) & (F.length("text") <= longest)).withColumn("phrase", _inner_phrase(F.col("text")))
    every = few.select("passage", F.explode(F.array_distinct(F.concat(*(phrases(F.col("text"), n) for n in range(1, PHRASE + 1))))).alias("phrase"))
    near = brief.where("phrase IS NOT NULL").join(F.broadcast(every) if small else every, "phrase")
    found = near.join(few.select("passage", F.col("text").alias("whole")), "passage").where(F.col("whole").contains(F.col("text"))).select("passage", "chunk_id")
    single = materialize(brief.where("phrase IS NULL").select("chunk_id", "text"), "brief-chunks")
    return found if single.isEmpty() else found.unionByName(contained_pairs(single, few, "chunk_id", "passage").select("passage", "chunk_id"))


def containment_matches(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(passage, chunk_id) by containment either way, as ``containment`` tests it, without comparing all pairs.

    White space of every text is squeezed once, into a table that the steps read.
    """
    p = materialize(passages.select("passage", squeeze(F.lower("snippet")).alias("text")).where("text <> ''"), "gold-texts")
    c = materialize(chunks.select("chunk_id", squeeze(F.lower("content")).alias("text")), "chunk-texts")
    sizes = p.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("all"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest")).first()
    small = sizes["all"] <= BROADCAST
    return materialize(_few_in_many(p, c, small).unionByName(_many_in_few(c, p, small, sizes["longest"])).distinct(), "contained")


def phrases(text: Column, n: int = PHRASE) -> Column:
    """Runs of ``n`` words of a text."""

    def runs(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(n))))
        return F.when(F.size(words) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(F.split(squeeze(F.lower(text)), " "), runs)


def phrase_matches(passages: DataFrame, chunks: DataFrame, n: int = PHRASE) -> DataFrame:
    """(passage, chunk_id) that share ``n`` words in a row, as an equi-join of phrases."""
    left = passages.select("passage", F.explode(phrases(F.col("snippet"), n)).alias("phrase"))
    right = chunks.select("chunk_id", F.explode(phrases(F.col("content"), n)).alias("phrase"))
    return left.join(right, "phrase").select("passage", "chunk_id").distinct()


def _words(text: Column) -> Column:
    return F.array_distinct(word_runs(text))


def shares_words(snippet: Column, content: Column, common: int = COMMON, share: float = SHARE) -> Column:
    """Whether the snippet's word set has enough words in common with the chunk's."""
    n = F.size(F.array_intersect(_words(snippet), _words(content)))
    return (n >= common) & (n >= share * F.size(_words(snippet)))


def word_matches(passages: DataFrame, chunks: DataFrame, common: int = COMMON, share: float = SHARE) -> DataFrame:
    """(passage, chunk_id) whose word sets share enough words.

    A match needs ``need`` of a passage's n words, so of any n - need + 1 + m of them it holds m + 1: only these many
    words of fewest chunks are joined, and the pairs that share m + 1 of them are counted in full.  Frequent words
    bring no pairs.  The words of chunks are made once, into a table that the steps read.
    """
    words = materialize(passages.select("passage", _words(F.col("snippet")).alias("words")), "gold-words")
    held = materialize(chunks.select("chunk_id", _words(F.col("content")).alias("held")), "chunk-words")
    n = F.size("words")
    need = F.greatest(F.lit(common), F.ceil(n * F.lit(share)).cast("int"))
    more = F.least(F.lit(MORE), need - 1)
    left = words.where(need <= n).select("passage", (more + 1).alias("least"), (n - need + 1 + more).alias("keep"), F.explode("words").alias("word"))
    small = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= MANY
    sent = F.broadcast if small else (lambda df: df)
    listed = held.select("chunk_id", F.explode("held").alias("word"))
    frequency = listed.join(sent(left.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("passage").orderBy(F.coalesce("df", F.lit(0)), "word"))
    probes = left.join(frequency, "word", "left").withColumn("nth", rarest).where(F.col("nth") <= F.col("keep"))
    probes = materialize(probes.select("passage", "word", "least"), "word-probes")
    pairs = listed.join(sent(probes), "word").groupBy("chunk_id", "passage").agg(F.count(F.lit(1)).alias("hits"), F.first("least").alias("least"))
    both = pairs.where("hits >= least").join(held, "chunk_id").join(sent(words), "passage")
    # one intersection by the smaller set
    n = F.size(F.array_intersect("held", "words"))
    return both.where(n >= F.greatest(F.lit(float(common)), share * F.size("words"))).select("passage", "chunk_id")


def shares_phrase(snippet: Column, content: Column, n: int = PHRASE) -> Column:
    return F.arrays_overlap(phrases(snippet, n), phrases(content, n))


def resolve(passages: DataFrame, chunks: DataFrame, compat: bool = False) -> DataFrame:
    """(query_id, passage, chunk_id): spans where both sides know them; else, within the passage's document, the text rules.

    The text rules are tested on the pairs of a passage and its own document's chunks.  ``compat`` lets passages that
    name no known document match any chunk; their pairs come from the rules' own joins.
    """
    spans = F.col("start_char").isNotNull() & F.col("end_char").isNotNull()
    known = span_matches(passages.where(spans), chunks.where(spans))
    textual = passages.where(~spans)
    texts = textual.select("passage", "snippet", F.col("doc_id").alias("wanted"))
    if compat:
        found = containment_matches(textual, chunks).unionByName(phrase_matches(textual, chunks)).unionByName(word_matches(textual, chunks))
        found, named = materialize(found.distinct(), "rule-matches"), _named(textual, chunks)
        # a passage that names no document may match any chunk
        found = found.join(named, ["passage", "chunk_id"], "left_semi").unionByName(found.join(_unnamed(textual, named), "passage", "left_semi"))
    else:
        pool = texts.join(chunks.select("chunk_id", "doc_id", "content"), F.col("wanted") == F.col("doc_id"))
        snippet, content = F.col("snippet"), F.col("content")
        found = pool.where(containment(snippet, content) | shares_phrase(snippet, content) | shares_words(snippet, content)).select("passage", "chunk_id")
    return known.unionByName(found).distinct().join(passages.select("passage", "query_id"), "passage").select("query_id", "passage", "chunk_id")


def ambiguous(matches: DataFrame, passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages without a document whose matches lie in more than one."""
    unnamed = passages.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == "").select("passage")
    docs = matches.join(unnamed, "passage", "left_semi").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return docs.groupBy("passage").agg(F.count_distinct("doc_id").alias("documents")).where("documents > 1")


def per_query(matches: DataFrame) -> DataFrame:
    """query_id and its sorted distinct relevant chunks."""
    return matches.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))


def unresolved(passages: DataFrame, matches: DataFrame) -> DataFrame:
    return passages.join(matches.select("passage").distinct(), "passage", "left_anti")


def unknown_documents(passages: DataFrame, documents: DataFrame, name: str = "filename") -> DataFrame:
    """Passages whose document is none of the corpus: neither equal to an id, name or stem, nor part of one, nor the reverse.

    Equality settles nearly all; only ids that no document bears are looked for inside the names, and names inside them.
    """
    stem = F.regexp_replace(F.col(name), "\\.[^.]*$", "")
    names = documents.select(F.explode(F.array(F.col("doc_id").cast("string"), F.col(name).cast("string"), stem)).alias("known")).where("known IS NOT NULL").distinct()
    key = F.col("doc_id").cast("string")
    rest = passages.select(key.alias("wanted")).distinct().join(names, F.col("wanted") == F.col("known"), "left_anti")
    asked, known = rest.where("wanted IS NOT NULL").select("wanted", F.col("wanted").alias("text")), names.select("known", F.col("known").alias("text"))
    met = contained_pairs(asked, known, "wanted", "known", blank=True)
    met = met.unionByName(contained_pairs(known, asked, "known", "wanted", blank=True).select("wanted", "known"))
    unknown = rest.join(met.select("wanted").distinct(), "wanted", "left_anti")
    return passages.join(unknown, key.eqNullSafe(F.col("wanted")), "left_semi")
