"""Experiment configurations: components with defaults, checked values, and no unknown keys."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from millrace.functions.hashing import config_hash
from millrace.operators import chunking, transforms

# The names and defaults that configurations of this kind use.
METRICS = ("recall", "precision", "mrr", "ndcg", "hit", "faithfulness", "answer_relevance", "citations")
CHOICES = {
    ("chunking", "strategy"): ("fixed", "recursive", "sentence", "semantic"),
    ("embedding", "provider"): ("fastembed", "sentence_transformers", "mock"),
    ("retrieval", "mode"): ("dense", "bm25", "hybrid"),
    ("retrieval", "hybrid_fusion"): ("rrf", "rsn"),
    ("reranker", "strategy"): ("none", "flashrank", "cross_encoder", "mock"),
    ("query_transform", "strategy"): ("none", "identity", "hyde", "multi_query", "step_back"),
    ("context", "reorder_strategy"): ("standard", "lost_in_the_middle"),
}
POSITIVE = {
    "chunking": ("chunk_size",),
    "embedding": ("dimension", "batch_size"),
    "retrieval": ("top_k", "rrf_k"),
    "reranker": ("top_n",),
    "query_transform": ("num_queries",),
    "context": ("token_budget",),
    "generation": ("max_tokens",),
}


@dataclass(frozen=True)
class Chunking:
    strategy: str = "fixed"
    chunk_size: int = 512
    chunk_overlap: int = 64
    similarity_threshold: float = 0.8


@dataclass(frozen=True)
class Embedding:
    provider: str = "fastembed"
    model_name: str = "BAAI/bge-small-en-v1.5"
    dimension: int = 384
    batch_size: int = 32


@dataclass(frozen=True)
class Retrieval:
    mode: str = "dense"
    top_k: int = 10
    hybrid_fusion: str = "rrf"
    rrf_k: int = 60
    dense_weight: float = 0.7


@dataclass(frozen=True)
class Reranker:
    enabled: bool = False
    strategy: str = "none"
    model_name: str = ""
    top_n: int = 5


@dataclass(frozen=True)
class QueryTransform:
    strategy: str = "none"
    num_queries: int = 3
    include_original: bool = True
    prompt_template: str | None = None


@dataclass(frozen=True)
class Context:
    token_budget: int = 2048
    reorder_strategy: str = "standard"
    encoding_name: str = "cl100k_base"


@dataclass(frozen=True)
class Generation:
    model_name: str = "mock"
    temperature: float = 0.0
    max_tokens: int = 512


@dataclass(frozen=True)
class Evaluation:
    metrics: tuple[str, ...] = METRICS
    k_values: tuple[int, ...] = (1, 3, 5, 10, 20)


@dataclass(frozen=True)
class Pipeline:
    """One point of a sweep: a value for every field of every component."""

    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranker: Reranker = field(default_factory=Reranker)
    query_transform: QueryTransform = field(default_factory=QueryTransform)
    context: Context = field(default_factory=Context)
    generation: Generation = field(default_factory=Generation)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def hash(self) -> str:
        return config_hash(asdict(self))


COMPONENTS = {f.name: f.default_factory for f in fields(Pipeline)}
#: Fields whose value is itself a list, so that a list doesn't sweep them.
LISTS = {("evaluation", "metrics"), ("evaluation", "k_values")}


def problems(point: Pipeline) -> list[str]:
    """Everything that is wrong with a point."""
    out = []
    added = {("chunking", "strategy"): chunking.strategies(), ("query_transform", "strategy"): transforms.strategies()}
    for (component, name), allowed in CHOICES.items():
        value, allowed = getattr(getattr(point, component), name), (*allowed, *added.get((component, name), ()))
        if value not in allowed:
            out.append(f"{component}.{name} is {value!r}, not one of {', '.join(allowed)}")
    for component, names in POSITIVE.items():
        out += [f"{component}.{n} must be positive" for n in names if not getattr(getattr(point, component), n) > 0]
    c, r = point.chunking, point.retrieval
    if not 0 <= c.chunk_overlap < c.chunk_size:
        out.append("chunking.chunk_overlap must be at least 0 and less than chunk_size")
    if not 0 <= c.similarity_threshold <= 1:
        out.append("chunking.similarity_threshold must lie between 0 and 1")
    if not 0 <= r.dense_weight <= 1:
        out.append("retrieval.dense_weight must lie between 0 and 1")
    if point.reranker.enabled and point.reranker.top_n > r.top_k:
        out.append("reranker.top_n must not exceed retrieval.top_k")
    out += [f"unknown metric {m!r}" for m in point.evaluation.metrics if m not in METRICS]
    out += [f"k must be positive, not {k}" for k in point.evaluation.k_values if k <= 0]
    if not point.evaluation.k_values:
        out.append("evaluation.k_values must hold a cut-off")
    return out


def warnings(point: Pipeline) -> list[str]:
    q = point.query_transform
    out = ["multi_query with fewer than two queries expands nothing"] if q.strategy == "multi_query" and q.num_queries < 2 else []
    if point.retrieval.mode == "bm25" and point.embedding != Embedding():
        out.append("a lexical run reads no embeddings")
    return out


def _clean(component: str, name: str, value: Any) -> Any:
    if isinstance(value, str) and (component, name) in CHOICES:
        value = value.lower().strip()
        return "bm25" if (name, value) == ("mode", "sparse") else value
    if (component, name) == ("evaluation", "k_values"):
        return tuple(sorted(set(value)))
    return tuple(m.lower().strip() for m in value) if (component, name) == ("evaluation", "metrics") else value


def make(component: str, values: dict) -> Any:
    """A component from a mapping; unknown keys are errors."""
    kind = COMPONENTS[component]
    known = {f.name for f in fields(kind)}
    if extra := set(values) - known:
        raise ValueError(f"unknown keys in {component}: {', '.join(sorted(extra))}")
    return kind(**{n: _clean(component, n, v) for n, v in values.items()})


def with_values(point: Pipeline, values: dict[tuple[str, str], Any]) -> Pipeline:
    """``point`` with fields replaced by (component, field)."""
    for (component, name), value in values.items():
        point = replace(point, **{component: replace(getattr(point, component), **{name: _clean(component, name, value)})})
    return point


@dataclass(frozen=True)
class Experiment:
    """A study: what it is called, the data it reads, and values or lists of values for its components."""

    name: str = "experiment"
    dataset_id: str = ""
    dataset_version_id: str = ""
    description: str = ""
    components: dict = field(default_factory=dict)
    author: str = ""
    tags: tuple[str, ...] = ()
    version: str = "1.0"
    corpus_path: str | None = None
    evaluation_qa_path: str | None = None


_META = ("name", "description", "author", "tags", "version")
_DATASET = ("dataset_id", "dataset_version_id", "corpus_path", "evaluation_qa_path")


def experiment(source: dict) -> Experiment:
    """An experiment from a parsed file: metadata nested or at top level, components under ``parameters`` or at top level.

    The dataset's id and version must be there; what is nested counts before what stands at top level.
    """
    if not isinstance(source, dict):
        raise ValueError("an experiment is a mapping")
    nested = source.get("metadata") or source.get("experiment") or {}
    meta = {k: source[k] for k in _META if k in source} | (nested if isinstance(nested, dict) else {})
    dataset = source.get("dataset")
    if not isinstance(dataset, dict):
        raise ValueError("an experiment needs a dataset mapping")
    for name in _DATASET[:2]:
        if not str(dataset.get(name) or ""):
            raise ValueError(f"the dataset needs a {name}")
    given = source.get("parameters")
    parameters = {k: v for k, v in source.items() if k in COMPONENTS} | (given if isinstance(given, dict) else {})
    known = {"metadata", "experiment", "dataset", "parameters", *_META, *COMPONENTS}
    if extra := (set(source) - known) | (set(parameters) - set(COMPONENTS)) | (set(dataset) - set(_DATASET)) | (set(meta) - set(_META)):
        raise ValueError(f"unknown keys: {', '.join(sorted(extra))}")
    for component, values in parameters.items():
        if not isinstance(values, dict):
            raise ValueError(f"{component} must be a mapping")
    texts = {k: str(v) for k, v in (meta | dataset).items() if k != "tags" and v is not None}
    return Experiment(components=parameters, tags=tuple(map(str, meta.get("tags") or ())), **texts)


def load(path: str) -> Experiment:
    import yaml

    with open(path, encoding="utf-8") as file:
        return experiment(yaml.safe_load(file))
