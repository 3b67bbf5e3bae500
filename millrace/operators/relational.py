"""The relational layer over run tables: lookups, audits, evidence trails, sweeps' frontiers and cache lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, *order: Column | str, offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values; None leaves a column open."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key a table of keys holds."""
    return df.join(keys.select(key), key, "left_semi")


def search_text(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(F.col(c)).contains(text.lower())
    return df.where(hit)


def latest(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).where("n__ = 1").drop("n__")


def cached_runs(runs: DataFrame, cache_hash: str = "cache_hash") -> DataFrame:
    """The newest completed run of each cache hash."""
    return latest(runs.where(F.col("status") == "COMPLETED"), cache_hash, F.col("completed_at").desc(), F.col("run_id").desc())


def plan_status(plan: DataFrame, runs: DataFrame | None) -> DataFrame:
    """``plan`` with HIT, MISS, or UNKNOWN where there is no table of runs."""
    if runs is None:
        return plan.withColumn("cache_status", F.lit("UNKNOWN"))
    known = cached_runs(runs).select("cache_hash", F.lit(True).alias("known__"))
    hit = F.when(F.col("known__"), "HIT").otherwise("MISS")
    return plan.join(known, "cache_hash", "left").withColumn("cache_status", hit).drop("known__")


def in_flight(plan: DataFrame, cache_hash: str = "cache_hash", index: str = "index") -> DataFrame:
    """Points of equal hash share the first one's run: ``leader`` is its index, ``executes`` says whether the point runs."""
    leader = F.min(index).over(Window.partitionBy(cache_hash))
    return plan.withColumn("leader", leader).withColumn("executes", F.col("leader") == F.col(index))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows whose key it lacks; existing rows stay as they are."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key the parent table lacks."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur twice or more."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def children(parent: DataFrame, child: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """``parent`` with its child rows as a sorted array; empty where it has none."""
    fields = [*order, *(c for c in child.columns if c not in (key, *order))]
    nested = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parent.join(nested, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(nested.dtypes)[name])))


def evidence_trail(query_runs: DataFrame, key: str = "query_run_id", **tables: DataFrame) -> DataFrame:
    """Query runs with their stages nested: sub-queries, retrieved and reranked chunks by rank, context, answer, metrics."""
    order = {"transformed": ["sequence_index"], "retrieved": ["rank"], "reranked": ["reranked_rank"]}
    out = query_runs
    for name in ("transformed", "retrieved", "reranked"):
        if name in tables:
            out = children(out, tables[name], key, name, *order[name])
    for name in ("context", "generation"):
        if name in tables:
            fields = [c for c in tables[name].columns if c != key]
            out = out.join(tables[name].select(key, F.struct(*fields).alias(name)), key, "left")
    if "metrics" in tables:
        pairs = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
        out = out.join(tables["metrics"].groupBy(key).agg(pairs.alias("metrics")), key, "left")
    return out


def exact_mean(value: Column) -> Column:
    """The mean of doubles by a sum in decimals of twelve places, so that no order of rows decides ties of equal values.

    Values or sums beyond decimals of 38 digits, and values that are not finite, take the mean of doubles instead.
    """
    fine = value.try_cast("decimal(26,12)")
    exact = F.try_sum(fine).cast("double") / F.nullif(F.count(value), F.lit(0))
    return F.when(F.count(fine) == F.count(value), F.coalesce(exact, F.avg(value))).otherwise(F.avg(value))


#: Groups whose frontiers are found side by side.
PARETO_GROUPS = 256


def pareto(points: DataFrame, gain: str = "recall", cost: str = "latency") -> DataFrame:
    """Points that no other beats in both: more gain at no more cost, or as much gain at less.

    In order of cost a point stays if its gain exceeds all gains at lower cost and is the best at its own.  Costs are
    dealt to groups first; what is beaten within a group is beaten, so only the groups' frontiers meet in one task.
    """

    def frontier(levels: DataFrame, group: Column) -> DataFrame:
        before = F.max("top__").over(Window.partitionBy(group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
        return levels.withColumn("before__", before).where(F.col("before__").isNull() | (F.col("top__") > F.col("before__"))).drop("before__")

    levels = points.groupBy(cost).agg(F.max(gain).alias("top__"))
    best = frontier(frontier(levels, F.pmod(F.xxhash64(cost), F.lit(PARETO_GROUPS))), F.lit(0))
    return points.join(best, cost).where(F.col(gain) == F.col("top__")).drop("top__")


def divergence(signatures: DataFrame, fields: list[str]) -> DataFrame:
    """(field, values, diverges): whether runs that are to be compared differ in a control field."""
    counts = signatures.agg(*(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in fields))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields)))
    return counts.select(cells.alias("c")).select("c.*").withColumn("diverges", F.col("values") > 1)


RADAR = ("recall@5", "precision@5", "mrr@5", "ndcg@5", "faithfulness")


def radar(summaries: DataFrame, run: str = "run_id", metrics: tuple[str, ...] = RADAR) -> DataFrame:
    """A few metrics of each run as columns, by default five bounded ones."""
    return summaries.groupBy(run).pivot("metric", list(metrics)).agg(F.first("mean"))


def document_totals(docs: DataFrame, version: str | None = None, content: str = "content") -> DataFrame:
    totals = [F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("total_bytes")]
    return docs.groupBy(version).agg(*totals) if version else docs.agg(*totals)
