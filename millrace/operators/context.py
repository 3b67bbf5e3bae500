"""Context packing: ranked chunks into a prompt of a token budget.

Candidates have query_id, rank, chunk_id, doc_id, content and score; a query's candidates are a top-k list, so
they fit in one array and one fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.bpe import Encoding, counter
from millrace.functions.text import token_estimate

HEADER = "[Source {index}] (doc: {doc_id}, chunk: {chunk_id})\n{content}"


def header(index: Column, doc_id: Column, chunk_id: Column, content: Column, template: str = HEADER) -> Column:
    """The template with its fields put in."""
    values = {"index": index, "doc_id": doc_id, "chunk_id": chunk_id, "content": content}
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        parts += [F.lit(rest[:at]), values[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def reorder_key(position: Column, size: Column, strategy: str = "standard") -> Column:
    """Sort key of a 0-based position: even places in order, then odd places reversed; up to two stay."""
    if strategy == "standard":
        return position
    if strategy != "lost_in_the_middle":
        raise ValueError(f"unknown order {strategy!r}")
    return F.when((position % 2 == 0) | (size <= 2), position).otherwise(2 * size - position)


def _greedy(kind: str, budget: int, template: str, encoding: Encoding):
    """The fold of ``select_within`` with the tokens of an encoding, on a query's few candidates."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            rows = []
            for items in lists:
                chosen, used = [], 0
                for x in items:
                    values = {"index": len(chosen) + 1, **{f: x[f] for f in ("doc_id", "chunk_id", "content")}}
                    if all(v is not None for v in values.values()):
                        parts = {"{" + f + "}": str(v) for f, v in values.items()}
                        cost = encoding(_substituted(template, parts) + "\n\n")
                        if used + cost <= budget:
                            chosen.append(x)
                            used += cost
                rows.append((chosen, used))
            yield pd.DataFrame({"chosen": pd.Series([c for c, _ in rows], dtype=object), "used": [u for _, u in rows]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, f"struct<chosen:{kind},used:int>")


def _substituted(template: str, parts: dict[str, str]) -> str:
    """The template with its fields put in, from left to right."""
    out = ""
    while template:
        spots = [(template.find(f), f) for f in parts if f in template]
        if not spots:
            return out + template
        at, name = min(spots)
        out, template = out + template[:at] + parts[name], template[at + len(name) :]
    return out


def select_within(candidates: DataFrame, budget: int, template: str = HEADER, encoding: Encoding | None = None) -> DataFrame:
    """Greedy choice in rank order: a chunk that doesn't fit is skipped, later ones may still fit.

    Tokens are those of ``encoding``, or estimated.  One row per query: ``chosen`` (structs in order), ``used`` tokens, ``candidates``, ``truncated``.
    """
    item = F.struct("rank", "chunk_id", "doc_id", "content", "score")
    grouped = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<rank:int,chunk_id:string,doc_id:string,content:string,score:double>>"
    start = F.struct(F.array().cast(kind).alias("chosen"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        text = F.concat(header(F.size(acc["chosen"]) + 1, x["doc_id"], x["chunk_id"], x["content"], template), F.lit("\n\n"))
        cost = token_estimate(text)
        taken = F.struct(F.concat(acc["chosen"], F.array(x)).alias("chosen"), (acc["used"] + cost).alias("used"))
        return F.when(acc["used"] + cost <= budget, taken).otherwise(acc)

    fold = F.aggregate("items", start, step) if encoding is None else _greedy(kind, budget, template, encoding)("items")
    folded = grouped.select("query_id", F.col("items").cast(kind).alias("items")).select("query_id", "items", fold.alias("fold"))
    return folded.select(
        "query_id",
        F.col("fold.chosen").alias("chosen"),
        F.col("fold.used").alias("used"),
        F.size("items").alias("candidates"),
        (F.size("items") - F.size("fold.chosen")).alias("truncated"),
    )


def assemble(selected: DataFrame, budget: int, strategy: str = "standard", template: str = HEADER, encoding: Encoding | None = None) -> DataFrame:
    """Reorder, number the sources again and join them; ``fits`` says whether the whole meets the budget."""
    n = F.size("chosen")
    keyed = F.transform("chosen", lambda x, i: F.struct(reorder_key(i, n, strategy).alias("k"), x.alias("x")))
    ordered = F.transform(F.array_sort(keyed), lambda p: p["x"])
    out = selected.withColumn("sources", ordered)
    blocks = F.transform("sources", lambda x, i: header(i + 1, x["doc_id"], x["chunk_id"], x["content"], template))
    out = out.withColumn("text", F.array_join(blocks, "\n\n")).withColumn("total_tokens", counter(encoding)(F.col("text")))
    sources = F.transform("sources", lambda x, i: F.struct((i + 1).alias("source_index"), x["chunk_id"].alias("chunk_id"), x["rank"].alias("original_rank")))
    return out.withColumn("sources", sources).withColumn("fits", F.col("total_tokens") <= budget)


def pack(
    queries: DataFrame, candidates: DataFrame, budget: int, strategy: str = "standard", template: str = HEADER, encoding: Encoding | None = None
) -> DataFrame:
    """A context per query; a query without candidates has an empty text and zero counts."""
    packed = assemble(select_within(candidates, budget, template, encoding), budget, strategy, template, encoding)
    zero = {"used": 0, "candidates": 0, "truncated": 0, "text": "", "total_tokens": 0, "fits": True}
    return queries.select("query_id").join(packed, "query_id", "left").fillna(zero)


class BudgetExceeded(ValueError):
    """A context that does not meet its budget."""


def over_budget(packed_total: Column, budget: int) -> Column:
    """What is wrong with a context of so many tokens; null if nothing is."""
    return F.when(packed_total > budget, F.concat(F.lit("context budget exceeded: "), packed_total.cast("string"), F.lit(f" > {budget}")))


def guard(packed: DataFrame, budget: int) -> DataFrame:
    """``packed``, whose reading fails at a context that does not meet the budget."""
    wrong = over_budget(F.col("total_tokens"), budget)
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("text"))
    return packed.withColumn("text", checked)


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def generate(packed: DataFrame, queries: DataFrame, model, cost_per_token: float = 0.0, encoding: Encoding | None = None) -> DataFrame:
    """Answers with their token counts and cost."""
    asked = packed.join(queries.select("query_id", "query"), "query_id").withColumn("prompt", prompt(F.col("text"), F.col("query")))
    out = asked.withColumn("answer", model(F.col("prompt")))
    tokens = counter(encoding)
    out = out.withColumn("input_tokens", tokens(F.col("prompt"))).withColumn("output_tokens", tokens(F.col("answer")))
    total = F.col("input_tokens") + F.col("output_tokens")
    return out.withColumn("total_tokens", total).withColumn("cost", total * F.lit(cost_per_token))
