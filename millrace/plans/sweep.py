"""Sweeps: a Cartesian grid of pipeline points, their checks, hashes and comparability."""

from __future__ import annotations

from dataclasses import asdict, fields
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import cache_hash, sha256_text
from millrace.operators.rerank import topology
from millrace.plans.config import COMPONENTS, LISTS, Experiment, Pipeline, make, problems, warnings, with_values

HEAVY, MODERATE, SAMPLES = 48, 12, 10


def axes(components: dict) -> list[tuple[tuple[str, str], list]]:
    """Swept fields with their values: components in fixed order, fields by name, values as given."""
    out = []
    for component in COMPONENTS:
        for name, value in sorted((components.get(component) or {}).items()):
            swept = isinstance(value, list) and ((component, name) not in LISTS or (value and isinstance(value[0], list)))
            if swept:
                if not value:
                    raise ValueError(f"{component}.{name} has no values")
                out.append(((component, name), value))
    return out


def baseline(components: dict) -> Pipeline:
    """The point of every list's first value."""
    first = {axis: values[0] for axis, values in axes(components)}
    made = {}
    for component in COMPONENTS:
        values = components.get(component) or {}
        made[component] = make(component, {n: first.get((component, n), v) for n, v in values.items()})
    return Pipeline(**made)


def expand(components: dict, skip_invalid: bool = False) -> list[Pipeline]:
    """All points, later fields fastest.  An invalid point is an error, or left out."""
    start, grid = baseline(components), axes(components)
    points = []
    for values in product(*(v for _, v in grid)):
        point = with_values(start, dict(zip((a for a, _ in grid), values, strict=True)))
        if wrong := problems(point):
            if skip_invalid:
                continue
            raise ValueError("; ".join(wrong))
        points.append(point)
    return points


def difference(base: Pipeline, point: Pipeline) -> dict[str, Any]:
    """``component.field`` to the point's value where it differs from the base."""
    out = {}
    for component in COMPONENTS:
        one, two = getattr(base, component), getattr(point, component)
        out |= {f"{component}.{f.name}": getattr(two, f.name) for f in fields(one) if getattr(one, f.name) != getattr(two, f.name)}
    return out


def pairwise_difference(a: Pipeline, b: Pipeline) -> list[tuple[str, str, Any, Any]]:
    return sorted((c, n, getattr(getattr(a, c), n), getattr(getattr(b, c), n)) for c, n in (k.split(".") for k in difference(a, b)))


def dry_run(experiment: Experiment, version_hash: str, n_queries: int, benchmark: str = "", skip_invalid: bool = False) -> list[dict]:
    """What a sweep would run: index, hashes, differences from the baseline, topology, warnings, queries."""
    base = baseline(experiment.components)
    return [
        {
            "index": i,
            "config_hash": p.hash(),
            "cache_hash": cache_hash(experiment.dataset_id, version_hash, asdict(p), benchmark),
            "difference": difference(base, p),
            "topology": topology(p.retrieval.mode, p.reranker.enabled),
            "warnings": warnings(p),
            "queries": n_queries,
        }
        for i, p in enumerate(expand(experiment.components, skip_invalid))
    ]


def preview(lists: dict[str, list]) -> dict:
    """Size class of a grid and its first points."""
    total = reduce(lambda n, v: n * len(v), lists.values(), 1)
    size = "HEAVY" if total > HEAVY else "MODERATE" if total > MODERATE else "LIGHT"
    shown = []
    for values in product(*lists.values()):
        if len(shown) == SAMPLES:
            break
        shown.append(dict(zip(lists, values, strict=True)))
    return {"total": total, "size": size, "samples": shown}


def validate(points: list[Pipeline]) -> tuple[list[str], list[str]]:
    """Errors and warnings of a sweep, each once."""
    wrong = [w for p in points for w in problems(p)]
    return list(dict.fromkeys(wrong)), list(dict.fromkeys(w for p in points for w in warnings(p)))


def to_yaml(name: str, dataset_id: str, version: str, components: dict) -> str:
    """A sweep file with the keys that the loader reads."""
    import yaml

    body = {"name": name, "dataset": {"dataset_id": dataset_id, "dataset_version_id": version}, "parameters": components}
    return yaml.safe_dump(body, sort_keys=False, allow_unicode=True)


def cross(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """The grid as a table with an index; the lists are parameters, so their product is small."""
    tables = []
    for name, values in lists.items():
        tables.append(spark.range(1, numPartitions=1).select(F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}__i", name)))
    grid = reduce(lambda a, b: a.crossJoin(b), tables)
    index = F.lit(0)
    for name, values in lists.items():
        index = index * len(values) + F.col(f"{name}__i")
    return grid.select(index.cast("long").alias("index"), *lists)


CONTROL_FIELDS = (
    "dataset_id",
    "dataset_version",
    "content_hash",
    "benchmark_hash",
    "query_set_hash",
    "chunking",
    "embedding_provider",
    "embedding_model",
    "reranker",
    "top_k",
    "metric_version",
    "protocol_version",
    "seed",
)


def signature(values: dict) -> dict:
    """The control fields that must agree for runs to be compared, with their hash."""
    signed = {f: str(values.get(f, "")) for f in CONTROL_FIELDS}
    return signed | {"signature_hash": sha256_text("|".join(f"{k}:{v}" for k, v in signed.items()))}


def signatures(runs: DataFrame, **fixed) -> DataFrame:
    """``runs`` with ``signature``, as ``signature_hash`` has it, of columns named like control fields; ``fixed`` gives others."""
    values = {f: F.col(f).cast("string") if f in runs.columns else F.lit(str(fixed.get(f, ""))) for f in CONTROL_FIELDS}
    signed = F.concat_ws("|", *(F.concat(F.lit(f"{f}:"), F.coalesce(v, F.lit(""))) for f, v in values.items()))
    return runs.withColumn("signature", F.sha2(signed, 256))
