"""Embedding providers: deterministic hash embeddings built in, models as optional adapters.

A provider turns a text column into an array column.  ``register`` adds one; the two below need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import fields, nfkc, strip, trigrams

_PROVIDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def register(*names: str):
    def add(factory):
        _PROVIDERS.update(dict.fromkeys(names, factory))
        return factory

    return add


def provider(name: str, **options) -> Callable[[Column], Column]:
    """The embedding function of a provider by any of its names."""
    try:
        return _PROVIDERS[name.lower().strip()](**options)
    except KeyError:
        raise ValueError(f"unknown embedding provider {name!r}; known: {sorted(_PROVIDERS)}") from None


def shingle_hashes(texts: DataFrame, key: str, text: str, dimension: int = 384, compose: bool = True, blank: bool = True) -> DataFrame:
    """Sparse hash projection: (key, idx, value) with L2 norm 1 per key.

    Shingles are the three characters from each position of a token, shorter at its end.  The MD5 of a shingle, as a
    128-bit number, gives the place (modulo ``dimension``) and the sign (bit 16).  A text without shingles, or whose
    signs cancel everywhere, is the first unit vector; with ``blank`` off it has no rows.

    Texts are dealt by their keys and taken apart there, so that shingles and sums are neither shuffled nor joined; a
    null among a text's shingles stands for the text itself.
    """
    body = F.lower(strip(F.col(text)))
    texts = texts.select(key, (nfkc(body) if compose else body).alias("body__")).repartition(key)
    tokens = fields(F.col("body__"))
    parts = F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(3)))))
    if blank:
        parts = F.concat(F.coalesce(parts, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    shingles = texts.select(key, F.explode(parts).alias("shingle")).groupBy(key, "shingle").agg(F.count(F.lit(1)).alias("times"))
    digest = F.md5("shingle")
    place = F.lit(0).cast("long")
    for word in range(4):
        digits = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")
        place = F.pmod(place * F.lit((1 << 32) % dimension) + digits, F.lit(dimension))
    odd = F.conv(F.substring(digest, 28, 1), 16, 10).cast("int") % 2 == 1
    sums = shingles.select(key, place.alias("idx"), F.when(odd, F.col("times")).otherwise(-F.col("times")).alias("signed"))
    sums = sums.groupBy(key, "idx").agg(F.sum("signed").alias("signed"))
    own = F.col("idx").isNotNull()
    square = F.sum(F.when(own, F.col("signed") * F.col("signed")).otherwise(0)).over(Window.partitionBy(key))
    cell = F.struct(F.col("idx"), (F.col("signed") / F.sqrt(F.col("square").cast("double"))).alias("value"))
    unit = F.struct(F.lit(0).cast("long").alias("idx"), F.lit(1.0).alias("value"))
    rows = F.when(own & (F.col("signed") != 0), F.array(cell)).when(~own & (F.col("square") == 0), F.array_repeat(unit, F.abs("signed").cast("int")))
    return sums.withColumn("square", square).select(key, F.inline(rows))


def sparse_cosine(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Cosines of all pairs of two sparse tables that share a place; (a, b, score)."""
    other = right.select(F.col(b), "idx", F.col("value").alias("other"))
    return left.join(other, "idx").groupBy(a, b).agg(F.sum(F.col("value") * F.col("other")).alias("score"))


def gram_likeness(rows: DataFrame, group: str, place: str, text: str) -> DataFrame:
    """(group, place, similarity): the cosine of a row's character trigrams with those of the row before it in its group.

    ``place`` numbers the rows of a group; neighbours without a common trigram have no row.  A text goes to its own
    place and to the next one, so that both texts of a pair meet before they are taken apart; no grams are shuffled or
    joined.
    """
    own = F.struct(F.col(place).alias("at"), F.lit(1).alias("own"))
    following = F.struct((F.col(place) + 1).alias("at"), F.lit(0).alias("own"))
    dealt = rows.where(F.col(group).isNotNull() & F.col(place).isNotNull()).select(group, F.col(text).alias("text__"), F.explode(F.array(own, following)).alias("to"))
    met = dealt.select(group, F.col("to.at").alias(place), F.col("to.own").alias("own"), "text__").repartition(group, place)
    grams = met.select(group, place, "own", F.explode(trigrams(F.col("text__"))).alias("gram"))
    count = lambda side: F.count_if(F.col("own") == side).cast("double")
    counts = grams.groupBy(group, place, "gram").agg(count(1).alias("n"), count(0).alias("m"))
    times = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = counts.groupBy(group, place).agg(times("n", "m").alias("dot"), F.sqrt(times("n", "n")).alias("norm"), F.sqrt(times("m", "m")).alias("other"))
    return sums.where("dot > 0").select(group, place, (F.col("dot") / (F.col("norm") * F.col("other"))).alias("similarity"))


def _hash_projection(dimension: int):
    import hashlib
    import unicodedata

    def one(text: str | None) -> np.ndarray:
        out = np.zeros(dimension)
        for token in unicodedata.normalize("NFKC", (text or "").strip().lower()).split():
            for i in range(len(token)):
                number = int(hashlib.md5(token[i : i + 3].encode()).hexdigest(), 16)
                out[number % dimension] += 1.0 if number >> 16 & 1 else -1.0
        norm = np.linalg.norm(out)
        return out / norm if norm else np.eye(1, dimension)[0]

    return one


def _digest_projection(dimension: int):
    import hashlib

    def one(text: str | None) -> np.ndarray:
        data = (text or "").encode()
        blocks = b"".join(hashlib.sha256(data + k.to_bytes(4, "little")).digest() for k in range(-(-dimension // 32)))
        out = (np.frombuffer(blocks, np.uint8)[:dimension] - 127.5) / 127.5
        return out / np.linalg.norm(out)

    return one


def _by_text(make, dimension: int) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = make(dimension)
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda text: F.pandas_udf(run, "array<double>")(text)


@register("mock", "test")
def hash_projection(dimension: int = 384, **_):
    """The dense form of ``shingle_hashes``."""
    return _by_text(_hash_projection, dimension)


@register("mock_multilingual")
def digest_projection(dimension: int = 1024, **_):
    """Bytes of SHA-256 digests of the text and a counter, scaled to -1..1 and normalised."""
    return _by_text(_digest_projection, dimension)


def _model(load):
    """A provider around a model that each worker loads once; ``load`` gives a function from texts to vectors."""

    def factory(model_name: str = "", dimension: int = 0, batch_size: int = 32, **options):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load(model_name, batch_size, **options)
            for texts in batches:
                vectors = [np.asarray(v, dtype=np.float64) for v in encode([t or "" for t in texts])]
                if dimension and any(len(v) != dimension for v in vectors):
                    raise ValueError(f"the model's vectors are not of dimension {dimension}")
                yield pd.Series(vectors, dtype=object)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return lambda text: F.pandas_udf(run, "array<double>")(text)

    return factory


def _load_fastembed(model: str, batch: int, **_):
    from fastembed import TextEmbedding

    encoder = TextEmbedding(model)
    return lambda texts: encoder.embed(texts, batch_size=batch)


def _load_sentence_transformer(model: str, batch: int, **_):
    from sentence_transformers import SentenceTransformer

    encoder = SentenceTransformer(model)
    return lambda texts: encoder.encode(texts, batch_size=batch, normalize_embeddings=True)


def _load_http(model: str, batch: int, url: str = "", key: str = "", timeout: float = 30.0, **_):
    import json
    import urllib.request

    def encode(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = json.load(answer)["data"]
        return [row["embedding"] for row in sorted(data, key=lambda r: r.get("index", 0))]

    return encode


register("fastembed", "onnx", "local")(_model(_load_fastembed))
register("sentence_transformers", "pytorch")(_model(_load_sentence_transformer))
register("cloud", "http")(_model(_load_http))
