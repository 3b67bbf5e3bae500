"""Query transforms: one query to one or more sub-queries, in order.

A language model is a function from a prompt column to a response column; ``canned`` is one without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.fusion import candidates, reciprocal_rank

Model = Callable[[Column], Column]

PROMPTS = {
    "hyde": "Write a short passage that answers the question.\n\nQuestion: {query}\n\nPassage:",
    "multi_query": "Write {num_queries} different search queries for the question, one per line.\n\nQuestion: {query}\n\nQueries:",
    "step_back": "Write a more general question behind the specific one.\n\nQuestion: {query}\n\nGeneral question:",
}


def canned(responses: dict[str, str] | None = None, prefix: str = "Mock response") -> Model:
    """The response of the first key that the prompt contains, else the prefix and the prompt's first 60 characters."""

    def answer(prompt: Column) -> Column:
        out = F.concat(F.lit(f"{prefix}: "), F.substring(prompt, 1, 60), F.lit("..."))
        for key, response in reversed(list((responses or {}).items())):
            out = F.when(prompt.contains(key), F.lit(response)).otherwise(out)
        return out

    return answer


def fill(template: str, query: Column, **values) -> Column:
    """A prompt template with its query and other fields put in."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    parts = template.split("{query}")
    return F.concat(*(p for i, part in enumerate(parts) for p in ([query] if i else []) + [F.lit(part)]))


def parse_lines(response: Column) -> Column:
    """Lines without numbering and bullets, the empty and the repeated ones dropped, in order."""

    def tidy(line: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(strip(line), "^[0-9]+[.)]\\s*", ""), "^[-*•]\\s*", ""))

    lines = F.transform(F.split(response, "\\r\\n?|\\n"), tidy)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def multi_query(query: Column, response: Column, n: int = 3, include_original: bool = True) -> Column:
    """Parsed queries; the original alone if there are none, and in front if it is missing."""
    found = parse_lines(response)
    found = F.when(F.size(found) == 0, F.array(query)).otherwise(found)
    if include_original:
        found = F.when(F.array_contains(found, query), found).otherwise(F.concat(F.array(query), found))
    return F.slice(found, 1, n + int(include_original))


def step_back(query: Column, response: Column, include_original: bool = True) -> Column:
    general = strip(response)
    both = F.when(general == query, F.array(general)).otherwise(F.array(general, query))
    return both if include_original else F.array(general)


#: From the query, the model's response, the number of queries and whether to keep the original, to the sub-queries.
Transform = Callable[[Column, Column, int, bool], Column]
_TRANSFORMS: dict[str, tuple[str | None, Transform]] = {}


def register(*names: str, prompt: str | None = None):
    """Add a query transform; one without a prompt asks no model."""

    def add(transform: Transform) -> Transform:
        _TRANSFORMS.update(dict.fromkeys(names, (prompt, transform)))
        return transform

    return add


register("none", "identity")(lambda query, response, n, keep: F.array(query))
register("hyde", prompt=PROMPTS["hyde"])(lambda query, response, n, keep: F.array(strip(response)))
register("multi_query", prompt=PROMPTS["multi_query"])(multi_query)
register("step_back", prompt=PROMPTS["step_back"])(lambda query, response, n, keep: step_back(query, response, keep))


def strategies() -> tuple[str, ...]:
    return tuple(_TRANSFORMS)


def sub_queries(queries: DataFrame, strategy: str = "none", model: Model | None = None, n: int = 3, include_original: bool = True, template: str | None = None) -> DataFrame:
    """``queries`` exploded to (query_id, sequence_index, sub_query), other columns kept."""
    try:
        prompt, transform = _TRANSFORMS[strategy.lower().strip()]
    except KeyError:
        raise ValueError(f"unknown query transform {strategy!r}; known: {sorted(_TRANSFORMS)}") from None
    query = F.col("query")
    response = (model or canned())(fill(template or prompt, query, num_queries=n)) if prompt else F.lit("")
    return queries.select("*", F.posexplode(transform(query, response, n, include_original)).alias("sequence_index", "sub_query"))


def retrieve(subs: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Search every sub-query for ``candidates(k)`` chunks and fuse a query's lists; a single list stays as it is."""
    parts = F.struct("query_id", "sequence_index")
    asked = subs.select(parts.alias("query_id"), F.col("sub_query").alias("query"))
    found = search(asked, candidates(k)).select("query_id.query_id", "chunk_id", "score", "rank")
    single = subs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("query_id")
    alone = found.join(single, "query_id", "left_semi").where(F.col("rank") <= k)
    fused = reciprocal_rank(found.join(single, "query_id", "left_anti"), k, constant)
    return alone.unionByName(fused)
