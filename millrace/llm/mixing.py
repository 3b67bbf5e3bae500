"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target in words: its share by weight of ``total``, at most
``MOST`` times its size, with the excess reshared by weight.  A target of
``e`` whole sizes and a rest means ``e`` complete epochs of every document and
a fractional selection: documents in ascending order of the exponential key
``-ln(u) / quality`` (so that better documents come earlier with the odds of
weighted sampling without replacement), taken while their prefix sum of words
meets the rest.

A source may hold any part of all rows: its keys are cut into blocks on the
scale of their logarithm, which holds about ``ROWS`` documents a block however
the quality is spread (more in a source so large that it would have over
``BLOCKS`` such blocks); prefix sums run within a block, and the blocks' sums,
of which there are a bounded number a source, give the offsets.  Rows that
agree in source, doc_id and text have equal keys; where more than a block's
worth do, they make blocks of their own, dealt by number, which is allowed
since they are interchangeable.  Blocks only spread the work;
results don't depend on them.  Texts are read once, for their sizes; only
sizes and keys move.

Defined results: ``u`` hashes the seed, doc_id and text, so reruns agree and
rows of one doc_id, or of none, are drawn apart.  Documents of equal key
follow doc_id, then a hash of their text.  A null source is a source of its
own, ranked last; a null doc_id hashes like the word ``null``, a null text like
an empty one.  A document without words takes 0; one of any length is a
document like others.  The document at the border is taken if that brings the
source nearer to its target.  An empty table gives an empty mix.  Columns of
the input may have any names: ``mix`` reads three, ``apply`` returns all as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import words
from millrace.llm.quality import SYMBOLS
from millrace.storage import materialize

WEIGHTS = (1, 2, 3)
MOST = 3
ROWS, BLOCKS = 128, 1 << 16


def uniform(seed: int, doc_id: Column, text_md5: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of seed, doc_id and the text's hash."""
    named = F.concat(F.lit(f"mix-{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_md5)
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: Column, size: Column) -> Column:
    """From 1 for clean text towards 0 with the number of symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return 1.0 / (1.0 + 4.0 * symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def targets(per_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``per_source`` (source, source_size) with ``weight`` and ``target``; one row per source, so its windows are small.

    Sources in order of what they can hold per weight: ``level`` is what is left per weight if all before are full.
    It rises up to the level that the others share and falls after it, so its maximum is that level.
    """
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*map(F.lit, weights))
    cap = F.col("source_size") * most
    order = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    out = per_source.withColumn("rank", rank).withColumn("weight", F.element_at(table, (F.col("rank") - 1) % len(weights) + 1))
    out = out.withColumn("cap", cap).withColumns(
        {
            "all": F.sum("source_size").over(one),
            "full": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "others": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.max((F.col("all") - F.col("full")).cast("double") / F.col("others").cast("double")).over(one)
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * level)
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def sizes(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The compact table that is mixed: doc_id, source, size, key, the hash that breaks ties, and a number that deals equal rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), t.alias("t"), F.size(words(t)).cast("long").alias("size"), F.md5(t).alias("text_md5")
    )
    return out.select(
        "doc_id",
        "source",
        "size",
        (-F.ln(uniform(seed, F.col("doc_id"), F.col("text_md5"))) / quality_weight(F.col("t"), F.col("size"))).alias("key"),
        "text_md5",
        F.monotonically_increasing_id().alias("row"),
    )


def _blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """The rows, which have their source's ``rows``, with the block that each lies in: ``bin``, ``sub`` and ``part``, in the order of their keys.

    On the scale of ln(key) no interval of width w holds more than w / e of a source's documents, whatever their quality.
    """
    worth = F.greatest(F.lit(per_block), F.ceil(F.col("rows") / BLOCKS))
    width = F.least(F.lit(1.0), F.lit(2.718281828459045) * worth / F.col("rows"))
    binned = rows.withColumns({"bin": F.floor(F.ln("key") / width), "worth": worth})
    alike = binned.groupBy("source", "bin", "key", "doc_id", "text_md5", "worth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.col("worth"))
    mark = F.struct(F.struct("key", "doc_id", "text_md5").alias("at"), F.ceil(F.col("n") / F.col("worth")).alias("parts"))
    # none, usually; written so that the join knows its size
    marks = materialize(alike.groupBy("source", "bin").agg(F.array_sort(F.collect_list(mark)).alias("marks")), "mix-alike")
    marks = marks.select(F.col("source").alias("s"), F.col("bin").alias("b"), "marks")
    binned = binned.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")), "left").drop("s", "b")
    here = F.struct("key", "doc_id", "text_md5")
    own = F.element_at(F.filter("marks", lambda m: m["at"] == here), 1)
    parts = F.coalesce(F.when(F.size(F.filter("marks", lambda m: m["at"] == here)) > 0, own["parts"]), F.lit(0))
    before = F.coalesce(F.size(F.filter("marks", lambda m: m["at"] < here)), F.lit(0))
    binned = binned.withColumns({"parts": parts, "before": F.when(F.col("marks").isNull(), 0).otherwise(before)})
    sub = F.col("before") * 2 + (F.col("parts") > 0).cast("int")
    part = F.when(F.col("parts") > 0, F.pmod("row", "parts")).otherwise(0)
    return binned.withColumns({"sub": sub, "part": part}).drop("marks", "parts", "before", "worth")


def mix(docs: DataFrame, seed: int = 1, weights=WEIGHTS, most: int = MOST, per_block: int = ROWS, **columns: str) -> DataFrame:
    """One row per document: doc_id, source, size, text_md5, source_size, target, epochs, ``copies`` and ``taken``."""
    rows = materialize(sizes(docs, seed, **columns), "mix-sizes")
    per_source = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-sources")
    plan = targets(per_source.drop("rows"), weights, most)
    epochs = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double"))
    plan = plan.join(per_source.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumnRenamed("source", "of")
    placed = _blocks(rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of"), per_block)
    block = ["source", "bin", "sub", "part"]
    sums = placed.groupBy(*block).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy(*block[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"o_{c}") for c in block), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*block).orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("o_source"))
    for c in block[1:]:
        on &= F.col(c) == F.col(f"o_{c}")
    summed = summed.join(offsets, on)
    middle = (F.col("offset") + F.col("ahead")).cast("double") + F.col("size").cast("double") / 2
    chosen = (middle <= F.col("rest")) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("epochs")).otherwise(0) + chosen.cast("long")
    return summed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "text_md5", "source_size", "target", "epochs", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply(docs: DataFrame, seed: int = 1, weights=WEIGHTS, most: int = MOST, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with its own columns.

    Decisions return to the rows by doc_id, source and text.  Rows that agree in all three share
    their copies out evenly, the first ones by a hash of the row getting what is left over.
    """
    mixed = mix(docs, seed, weights, most, doc_id=doc_id, source=source, text=text)
    keys = ["doc_id", "source", "text_md5"]
    shares = mixed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).where("copies > 0")
    shares = shares.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), "copies", "alike")
    boxed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"),
    )
    on = F.col("k2") == F.col("text_md5")
    for i, k in enumerate(keys[:2]):
        on &= F.col(f"k{i}").eqNullSafe(F.col(k))
    joined = boxed.join(shares, on)
    single = joined.where("alike = 1").select("doc", "copies")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc")))
    several = joined.where("alike > 1").withColumn("nth", nth)
    share = F.floor(F.col("copies") / F.col("alike")) + (F.col("nth") <= F.col("copies") % F.col("alike")).cast("long")
    several = several.select("doc", share.alias("copies")).where("copies > 0")
    return single.union(several).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
