"""Metrics of rankings, answers and citations; one row per query, all cut-offs in one aggregation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_sentences, let, strip, word_runs
from millrace.operators.transforms import parse_lines


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ranking_metrics(queries: DataFrame, rankings: DataFrame, qrels: DataFrame, ks: list[int], item: str = "chunk_id", gain: str | None = None) -> DataFrame:
    """Recall, precision, MRR, nDCG and hit at each k: (query_id, k, recall, precision, mrr, ndcg, hit).

    ``queries`` lists the query_ids; ``qrels`` has query_id and the item, and optionally a graded ``gain`` that only
    nDCG reads.  An item that a list names twice counts once for recall, precision and gain.  Without relevant
    items, or with k of 0 or less, every metric is 0.  Precision divides by k.
    """
    grades = qrels.groupBy("query_id", item).agg((F.max(gain) if gain else F.lit(1)).cast("double").alias("gain"))
    first = rankings.groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), item))
    rows = grades.where("gain > 0").join(first, ["query_id", item], "left").withColumn("place", place)
    cut = lambda k, by, value: F.when(F.col(by) <= k, value)
    worth = lambda by: (F.pow(2.0, F.col("gain")) - 1) / F.log2(F.col(by) + F.lit(1.0))
    per_k = [F.count(F.lit(1)).alias("relevant")]
    for k in ks:
        per_k += [F.count(cut(k, "rank", F.lit(1))).alias(f"hits_{k}"), F.min(cut(k, "rank", F.col("rank"))).alias(f"first_{k}")]
        per_k += [F.sum(cut(k, by, worth(by))).alias(f"{name}_{k}") for name, by in (("dcg", "rank"), ("ideal", "place"))]
    wide = queries.select("query_id").distinct().join(rows.groupBy("query_id").agg(*per_k), "query_id", "left")

    def at(k: int) -> Column:
        n = _zero(F.col(f"hits_{k}").cast("double"))
        ok = F.lit(k > 0)
        value = {
            "recall": n / F.nullif(F.col("relevant"), F.lit(0)),
            "precision": n / k if k > 0 else F.lit(0.0),
            "mrr": 1.0 / F.col(f"first_{k}"),
            "ndcg": _zero(F.col(f"dcg_{k}")) / F.nullif(F.col(f"ideal_{k}"), F.lit(0.0)),
            "hit": (n > 0).cast("double"),
        }
        return F.struct(F.lit(k).alias("k"), *(F.when(ok, _zero(v)).otherwise(0.0).alias(name) for name, v in value.items()))

    return wide.select("query_id", F.explode(F.array(*map(at, ks))).alias("m")).select("query_id", "m.*")


def document_recall(queries: DataFrame, rankings: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Recall of documents: rankings carry doc_id, ``gold`` has query_id and doc_id; queries without gold have no row."""
    asked = queries.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return ranking_metrics(asked, rankings, gold, ks, item="doc_id").select("query_id", "k", F.col("recall").alias("doc_recall"))


def entails(context: Column, proposition: Column, fixed: dict[str, bool] | None = None) -> Column:
    """Whether half of the words over three letters lie somewhere in the context; true without such words.

    ``fixed`` decides propositions that contain one of its keys.
    """

    def half(words: Column) -> Column:
        inside = let(F.lower(context), lambda low: F.size(F.filter(words, lambda w: low.contains(w))))
        return F.when(F.size(words) == 0, F.lit(True)).otherwise(inside / F.size(words) >= 0.5)

    out = let(F.filter(word_runs(proposition), lambda w: F.length(w) > 3), half)
    for key, value in reversed(list((fixed or {}).items())):
        out = F.when(proposition.contains(key), F.lit(value)).otherwise(out)
    return out


def says_yes(response: Column) -> Column:
    """A model's verdict as a boolean."""
    return F.upper(F.trim(response)).startswith("YES")


#: Whether a context (first) entails a proposition (second).
Judge = Callable[[Column, Column], Column]
_JUDGES: dict[str, Callable[..., Judge]] = {}

JUDGE_PROMPT = "Does the context support every part of the statement, with nothing assumed? Answer YES or NO.\n\nContext: {context}\n\nStatement: {statement}\n\nAnswer:"
QUESTIONS_PROMPT = "Write {n} different questions that the answer answers, one per line.\n\nAnswer: {answer}\n\nQuestions:"


def register_judge(*names: str):
    """Add an entailment classifier: a factory of judges."""

    def add(factory: Callable[..., Judge]):
        _JUDGES.update(dict.fromkeys(names, factory))
        return factory

    return add


def judge(name: str = "mock", **options) -> Judge:
    """An entailment classifier by any of its names."""
    try:
        return _JUDGES[name.lower().strip()](**options)
    except KeyError:
        raise ValueError(f"unknown entailment classifier {name!r}; known: {sorted(_JUDGES)}") from None


@register_judge("mock", "overlap")
def overlap_judge(fixed: dict[str, bool] | None = None) -> Judge:
    return lambda context, proposition: entails(context, proposition, fixed)


@register_judge("llm", "model")
def model_judge(model: Callable[[Column], Column], template: str = JUDGE_PROMPT) -> Judge:
    """A language model as the judge; an answer that begins with YES is one."""

    def run(context: Column, proposition: Column) -> Column:
        return F.coalesce(says_yes(model(filled(template, context=context, statement=proposition))), F.lit(False))

    return run


def filled(template: str, **values: Column | int) -> Column:
    """A template with its fields put in, each wherever it occurs."""
    parts: list[Column] = []
    for piece in re.split("(" + "|".join(re.escape("{" + n + "}") for n in values) + ")", template):
        value = values.get(piece[1:-1]) if piece.startswith("{") else None
        parts.append(F.lit(piece) if value is None else F.lit(str(value)) if isinstance(value, int) else value)
    return F.concat(*parts)


def propositions(answer: Column, response: Column | None = None) -> Column:
    """A model's lines where it gave any, else the answer's sentences."""
    own = clean_sentences(F.coalesce(answer, F.lit("")))
    if response is None:
        return own
    lines = F.coalesce(parse_lines(response), F.array().cast("array<string>"))
    return F.when(F.size(lines) > 0, lines).otherwise(own)


def faithfulness(
    answers: DataFrame,
    answer: str = "answer",
    context: str = "context",
    fixed: dict[str, bool] | None = None,
    response: str | None = None,
    judged: Judge | None = None,
) -> DataFrame:
    """(query_id, propositions, entailed, faithfulness, hallucination_rate); an empty answer is faithful.

    ``response`` names the column of a model's decomposition, if there is one; ``judged`` replaces the overlap of words.
    """
    judged = judged or overlap_judge(fixed)
    props = propositions(F.col(answer), F.col(response) if response else None)
    good = F.filter(props, lambda p: judged(F.col(context), p))
    out = answers.select("query_id", F.size(props).alias("propositions"), F.size(good).alias("entailed"))
    score = F.when(F.col("propositions") == 0, F.lit(1.0)).otherwise(F.col("entailed") / F.nullif(F.col("propositions"), F.lit(0)))
    return out.withColumn("faithfulness", score).withColumn("hallucination_rate", 1.0 - F.col("faithfulness"))


_CITATION = "(?i)\\[(?:Source\\s+)?([0-9]+)\\]"


def citations(text: Column) -> Column:
    """Source numbers that a text cites, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_CITATION), F.lit(1)), lambda x: x.cast("int"))


def citation_metrics(answers: DataFrame, sources: DataFrame, answer: str = "answer", judged: Judge = entails) -> DataFrame:
    """(query_id, citations, valid, claims, cited, citation_precision, citation_recall).

    ``sources`` has query_id, source_index and content.  A citation is valid if its source exists and entails the
    sentence; a claim is cited if one of its citations is valid.  Every sentence is a claim.
    """
    claims = answers.select("query_id", F.posexplode(clean_sentences(F.coalesce(F.col(answer), F.lit("")))).alias("claim", "sentence"))
    bare = F.regexp_replace("sentence", _CITATION, "")
    cited = claims.select("query_id", "claim", bare.alias("bare"), F.explode_outer(citations(F.col("sentence"))).alias("source_index"))
    joined = cited.join(sources.select("query_id", "source_index", "content"), ["query_id", "source_index"], "left")
    valid = F.coalesce(judged(F.col("content"), F.col("bare")), F.lit(False)) & F.col("content").isNotNull()
    per_claim = joined.groupBy("query_id", "claim").agg(F.count("source_index").alias("made"), F.count_if(valid).alias("good"))
    totals = per_claim.groupBy("query_id").agg(
        F.sum("made").alias("citations"), F.sum("good").alias("valid"), F.count(F.lit(1)).alias("claims"), F.count_if(F.col("good") > 0).alias("cited")
    )
    out = answers.select("query_id").join(totals, "query_id", "left").fillna(0)
    ratio = lambda a, b: _zero(F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return out.withColumn("citation_precision", ratio("valid", "citations")).withColumn("citation_recall", ratio("cited", "claims"))


def answer_relevance(pairs: DataFrame, query_vector: str = "query_vector", question_vectors: str = "question_vectors") -> DataFrame:
    """Mean cosine, at least 0 each, of a query's vector with those of questions generated from its answer."""
    from millrace.operators.dense import cosine

    each = F.transform(question_vectors, lambda v: F.greatest(F.lit(0.0), cosine(F.col(query_vector), v)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(each), F.lit(0))
    return pairs.select("query_id", _zero(mean).alias("answer_relevance"))


def relevance(answers: DataFrame, model: Callable[[Column], Column], encode: Callable[[Column], Column], n: int = 3, template: str = QUESTIONS_PROMPT) -> DataFrame:
    """(query_id, answer_relevance): a model writes questions to each answer, and their vectors are compared with the query's.

    ``answers`` has query_id, query and answer.  A blank answer, and one without questions, has relevance 0.
    """
    response = model(filled(template, n=n, answer=F.col("answer")))
    lines = F.slice(F.filter(F.transform(F.split(response, "\\r\\n?|\\n"), strip), lambda x: x != ""), 1, n)
    asked = answers.select("query_id", "query", F.when(F.length(strip(F.coalesce("answer", F.lit("")))) > 0, lines).alias("lines"))
    each = asked.select("query_id", "query", F.explode_outer("lines").alias("line"))
    encoded = each.select("query_id", F.when(F.col("line").isNotNull(), encode(F.col("query"))).alias("q"), encode(F.coalesce("line", F.lit(""))).alias("v"))
    paired = encoded.groupBy("query_id").agg(F.first("q", ignorenulls=True).alias("query_vector"), F.collect_list(F.when(F.col("q").isNotNull(), F.col("v"))).alias("question_vectors"))
    return answer_relevance(paired)


def long_form(wide: DataFrame, names: list[str], by_k: bool = True) -> DataFrame:
    """(query_id, metric, value) rows, with ``@k`` in the names where metrics have a cut-off."""
    label = lambda n: F.concat(F.lit(f"{n}@"), F.col("k")) if by_k else F.lit(n)
    cells = F.array(*(F.struct(label(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return wide.select("query_id", F.explode(cells).alias("c")).select("query_id", "c.*")


def latency_metrics(durations: DataFrame) -> DataFrame:
    """Stage durations in milliseconds as metrics; a batch engine measures stages, so a query's columns may be null."""
    names = ["total_latency_ms", "retrieval_latency_ms", "reranking_latency_ms", "generation_latency_ms"]
    return long_form(durations, names, by_k=False).where("value IS NOT NULL")
