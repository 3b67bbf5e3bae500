"""Summaries of runs and paired comparisons.

Aggregates, ranks and corrections are expressions.  Only the t distribution and the signed-rank p run in Python, on one
row of sums per (comparison, metric) group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.special import NEGLIGIBLE, t_critical, t_two_tailed, wilcoxon_p
from millrace.operators import ordering


def summary(values: DataFrame, *groups: str, value: str = "value", large: int = ordering.LARGE) -> DataFrame:
    """Mean, median, least, most, sample deviation (0 for one value) and count of the values that exist.

    Medians of groups of more than ``large`` rows come by ranks over range partitions, others by one buffer each.
    """
    v = F.col(value)
    known = values.where(v.isNotNull())
    wide = ordering.largest(known, *groups) > large
    out = known.groupBy(*groups).agg(
        F.avg(v).alias("mean"),
        *([] if wide else [F.median(v).alias("median")]),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"),
        F.count(v).alias("count"),
    )
    if not wide:
        return out
    middle = ordering.medians(known, groups, value)
    both = out.alias("a").join(middle.alias("b"), ordering._same("a", "b", groups))
    return both.select(*(F.col(f"a.{g}").alias(g) for g in groups), "mean", "median", "min", "max", "stddev", "count")


def run_status(queries: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """A run is COMPLETED without failures, FAILED without successes, else PARTIAL."""
    failed, done = F.count_if(F.col(status) == "FAILED"), F.count_if(F.col(status) == "SUCCESS")
    verdict = F.when(failed == 0, "COMPLETED").when(done == 0, "FAILED").otherwise("PARTIAL")
    return queries.groupBy(run).agg(F.count(status).alias("queries"), done.alias("completed"), failed.alias("failed"), verdict.alias("status"))


def matrix_status(runs: DataFrame, matrix: str, status: str = "status") -> DataFrame:
    s = F.col(status)
    verdict = F.when(F.every(s == "COMPLETED"), "COMPLETED").when(F.every(s == "FAILED"), "FAILED").otherwise("PARTIAL")
    return runs.groupBy(matrix).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(s == "COMPLETED").alias("completed_runs"), F.count_if(s != "COMPLETED").alias("failed_runs"), verdict.alias("status")
    )


def last_scores(values: DataFrame, unit: str, metric: str = "metric", value: str = "value", time: str = "started_at") -> DataFrame:
    """The latest value of each unit and metric."""
    return values.groupBy(unit, metric).agg(F.max_by(value, time).alias(value))


def paired(a: DataFrame, b: DataFrame, unit: str = "query_id") -> DataFrame:
    """(metric, unit, a, b, difference) of units that both runs scored."""
    left = a.select("metric", unit, F.col("value").alias("a"))
    right = b.select("metric", unit, F.col("value").alias("b"))
    return left.join(right, ["metric", unit]).withColumn("difference", F.col("b") - F.col("a"))


def paired_statistics(pairs: DataFrame, *groups: str) -> DataFrame:
    """n, means, mean and deviation of the differences, t, its degrees of freedom and Cohen's dz, by expressions.

    Constant differences give an infinite t and dz (0 where they are all 0); one pair gives nulls.
    """
    out = pairs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("difference").alias("mean_difference"),
        F.stddev_samp("difference").alias("std_difference"),
    )
    n, mean, std = F.col("n"), F.col("mean_difference"), F.col("std_difference")
    flat = std <= NEGLIGIBLE
    infinite = F.signum(mean) * F.lit(math.inf)
    degenerate = F.when(F.abs(mean) <= NEGLIGIBLE, F.lit(0.0)).otherwise(infinite)
    real = lambda c: F.when(n < 2, F.lit(None).cast("double")).when(flat, degenerate).otherwise(c)
    safe = F.when(flat, F.lit(1.0)).otherwise(std)
    return out.withColumns({"t_df": n - 1, "t_statistic": real(mean / (safe / F.sqrt(n))), "cohens_dz": real(mean / safe)})


def _ranked_by_levels(kept: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``_ranked`` for groups of any size: one row a distinct size, ranked over range partitions."""
    ups = F.when(F.col("difference") > 0, F.lit(1)).otherwise(F.lit(0))
    found = ordering.levels(kept, groups, "size", ups=ups)
    place, t = F.col("below") + (F.col("ties") + 1) / 2, F.col("ties").cast("double")
    up, down = F.sum(place * F.col("ups")), F.sum(place * (F.col("ties") - F.col("ups")))
    return found.groupBy(*groups).agg(F.sum("ties").alias("n"), F.least(up, down).alias("w"), F.count(F.lit(1)).alias("levels"), F.sum(t * (t * t - 1)).alias("excess"))


def _ranked(pairs: DataFrame, *groups: str, large: int = ordering.LARGE) -> DataFrame:
    """n, W = min(W+, W-) with mid-ranks, the number of sizes and the ties' sum of t**3 - t, by windows."""
    kept = pairs.where(F.abs("difference") > NEGLIGIBLE).withColumn("size", F.round(F.abs("difference"), 12))
    if ordering.largest(kept, *groups) > large:
        return _ranked_by_levels(kept, groups)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, "size"))
    ranked = kept.withColumns({"ties": ties, "place": F.rank().over(Window.partitionBy(*groups).orderBy("size")) + (ties - 1) / 2})
    up = F.coalesce(F.sum(F.when(F.col("difference") > 0, F.col("place"))), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(F.col("difference") < 0, F.col("place"))), F.lit(0.0))
    t = F.col("ties").cast("double")
    return ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.least(up, down).alias("w"), F.count_distinct("size").alias("levels"), F.sum(t * t - 1).alias("excess")
    )


def wilcoxon_statistic(pairs: DataFrame, *groups: str, large: int = ordering.LARGE) -> DataFrame:
    """n and W of each group's differences that aren't 0; groups of more than ``large`` are ranked over range partitions."""
    return _ranked(pairs, *groups, large=large).select(*groups, "n", "w")


_TESTS = "struct<ci95_lower:double,ci95_upper:double,p_value:double,wilcoxon_statistic:double,wilcoxon_p:double,wilcoxon_method:string>"


def _tests(n: pd.Series, mean: pd.Series, std: pd.Series, kept: pd.Series, w: pd.Series, levels: pd.Series, excess: pd.Series) -> pd.DataFrame:
    def one(n, mean, std, kept, w, levels, excess):
        if n < 2:
            return [None] * 6
        if std <= NEGLIGIBLE:
            level = 0.0 if abs(mean) <= NEGLIGIBLE else mean
            low, high, p = level, level, 0.0 if level else 1.0
        else:
            error = std / math.sqrt(n)
            half = t_critical(n - 1) * error
            low, high, p = mean - half, mean + half, t_two_tailed(mean / error, n - 1)
        return [low, high, p, w, *wilcoxon_p(w, int(kept), int(levels), excess)]

    rows = [one(*r) for r in zip(n, mean, std, kept, w, levels, excess, strict=True)]
    return pd.DataFrame(rows, columns=["ci95_lower", "ci95_upper", "p_value", "wilcoxon_statistic", "wilcoxon_p", "wilcoxon_method"])


def paired_tests(pairs: DataFrame, *groups: str) -> DataFrame:
    """Confidence interval, t-test p and signed-rank test of each group's differences.

    Differences are reduced by aggregates and windows; Python sees one row a group.
    """
    sums = paired_statistics(pairs, *groups).select(*groups, "n", "mean_difference", "std_difference")
    parts = _ranked(pairs, *groups).withColumnRenamed("n", "kept")
    both = sums.join(parts, list(groups), "left").fillna(0, ["kept", "levels"]).fillna(0.0, ["w", "excess"])
    found = F.pandas_udf(_tests, _TESTS)("n", "mean_difference", F.coalesce("std_difference", F.lit(0.0)), "kept", "w", "levels", "excess")
    return both.select(*groups, "mean_difference", found.alias("t")).select(*groups, "mean_difference", "t.*")


def _family(group: str | None) -> Window:
    return Window.partitionBy(*([group] if group else [F.lit(0)]))


def _counted(df: DataFrame, p: str, family: str | None) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with ``m__``, its family's number of hypotheses, and the columns that name a family."""
    if family is None:
        return df.crossJoin(F.broadcast(df.agg(F.count(p).alias("m__")))), ()
    sizes = df.groupBy(F.col(family).alias("family__")).agg(F.count(p).alias("m__"))
    return df.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, F.col(family).eqNullSafe(F.col("family__"))).drop("family__"), (family,)


def _holm_by_parts(df: DataFrame, p: str, family: str | None, order: str) -> DataFrame:
    """``holm`` over range partitions: a running number, then a running maximum."""
    known, groups = _counted(df, p, family)
    by = (F.col(p), F.col(order))
    numbered = ordering.running(known, groups, by, sums={"nth__": F.lit(1)}).withColumn("step__", F.col(p) * (F.col("m__") - F.col("nth__") + 1))
    out = ordering.running(numbered, groups, by, greatest={"p_holm": F.col("step__")})
    return out.withColumn("p_holm", F.least(F.lit(1.0), F.col("p_holm"))).drop("step__", "nth__", "m__")


def _bh_by_parts(df: DataFrame, p: str, family: str | None, order: str) -> DataFrame:
    """``benjamini_hochberg`` over range partitions: a running number, then from the largest down a running minimum."""
    known, groups = _counted(df, p, family)
    numbered = ordering.running(known, groups, (F.col(p), F.col(order)), sums={"nth__": F.lit(1)})
    numbered = numbered.withColumn("step__", F.col(p) * F.col("m__") / F.col("nth__"))
    out = ordering.running(numbered, groups, (F.col(p).desc(), F.col(order).desc()), greatest={"p_bh": -F.col("step__")})
    return out.withColumn("p_bh", F.least(F.lit(1.0), -F.col("p_bh"))).drop("step__", "nth__", "m__")


def holm(df: DataFrame, p: str = "p_value", family: str | None = None, order: str = "metric", large: int = ordering.LARGE) -> DataFrame:
    """``p_holm``: p times the hypotheses left, never falling, at most 1.  Families of more than ``large`` are sorted by range."""
    w = _family(family).orderBy(p, order)
    if ordering.largest(df, *([family] if family else [])) > large:
        return _holm_by_parts(df, p, family, order)
    left = F.count(p).over(_family(family)) - F.row_number().over(w) + 1
    stepped = df.withColumn("step__", F.col(p) * left)
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("step__").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("step__")


def benjamini_hochberg(df: DataFrame, p: str = "p_value", family: str | None = None, order: str = "metric", large: int = ordering.LARGE) -> DataFrame:
    """``p_bh``: p times the number of hypotheses over its rank, never rising from the largest down, at most 1."""
    if ordering.largest(df, *([family] if family else [])) > large:
        return _bh_by_parts(df, p, family, order)
    up, down = _family(family).orderBy(p, order), _family(family).orderBy(F.col(p).desc(), F.col(order).desc())
    stepped = df.withColumn("step__", F.col(p) * F.count(p).over(_family(family)) / F.row_number().over(up))
    return stepped.withColumn("p_bh", F.least(F.lit(1.0), F.min("step__").over(down.rowsBetween(Window.unboundedPreceding, 0)))).drop("step__")


def stars(p: Column) -> Column:
    known = p.isNotNull() & ~F.isnan(p)
    return F.when(known & (p < 0.001), "***").when(known & (p < 0.01), "**").when(known & (p < 0.05), "*").otherwise("ns")


def drop_warm_up(values: DataFrame, n: int, unit: str = "query_id") -> DataFrame:
    """Latency metrics without their first ``n`` units."""
    place = F.row_number().over(Window.partitionBy("metric").orderBy(unit))
    return values.withColumn("place__", place).where(~F.col("metric").contains("latency") | (F.col("place__") > n)).drop("place__")


CONTROLS = ("dataset_version", "content_hash", "benchmark_hash", "protocol_version", "metric_version", "k")


def align(run_a: dict, run_b: dict, ids_a: DataFrame, ids_b: DataFrame, partial: bool = False, unit: str = "query_id") -> dict[str, DataFrame]:
    """Check that two runs may be compared; returns their common units and those that one lacks.

    Differing dataset versions pass if their contents are equal.
    """
    for name in CONTROLS:
        same = run_a.get(name) == run_b.get(name)
        if name == "dataset_version" and run_a.get("content_hash") and run_a.get("content_hash") == run_b.get("content_hash"):
            same = True
        if not same:
            raise ValueError(f"the runs differ in {name}: {run_a.get(name)!r} and {run_b.get(name)!r}")
    a, b = ids_a.select(unit).distinct(), ids_b.select(unit).distinct()
    out = {"common": a.join(b, unit), "only_a": a.join(b, unit, "left_anti"), "only_b": b.join(a, unit, "left_anti")}
    if not partial and not (out["only_a"].isEmpty() and out["only_b"].isEmpty()):
        raise ValueError("the runs have different queries")
    return out


def compare(a: DataFrame, b: DataFrame, correction: str = "holm", warm_up: int = 0, unit: str = "query_id") -> DataFrame:
    """All metrics that two runs (unit, metric, value) share, tested and corrected on the t-test's p."""
    pairs = paired(drop_warm_up(a, warm_up, unit), drop_warm_up(b, warm_up, unit), unit)
    out = paired_statistics(pairs, "metric").join(paired_tests(pairs, "metric").drop("mean_difference"), "metric")
    if correction == "holm":
        out = holm(out).withColumnRenamed("p_holm", "adjusted_p")
    elif correction == "bh":
        out = benjamini_hochberg(out).withColumnRenamed("p_bh", "adjusted_p")
    elif correction == "none":
        out = out.withColumn("adjusted_p", F.col("p_value"))
    else:
        raise ValueError(f"unknown correction {correction!r}")
    return out.withColumn("adjustment", F.lit(correction)).withColumn("stars", stars(F.col("adjusted_p")))


def unit_of(query_id: Column) -> Column:
    """The information unit that a query id of the form q_<unit>_<lang>_<lang> names."""
    return F.regexp_replace(query_id, "^q_|_(en|bn)_(en|bn)$", "")


def transfer(mono: DataFrame, cross: DataFrame, unit: str = "unit") -> DataFrame:
    """Penalty of crossing languages per metric: mean, deviation, interval, t, dz (null for a constant), W and its p, to six places."""
    pairs = paired(cross, mono, unit)
    basic = paired_statistics(pairs, "metric").join(paired_tests(pairs, "metric").drop("mean_difference"), "metric")
    dz = F.when(F.col("std_difference") > NEGLIGIBLE, F.col("cohens_dz"))
    cells = {
        "mean_mono": F.col("mean_b"),
        "mean_cross": F.col("mean_a"),
        "mean_penalty": F.col("mean_difference"),
        "std_penalty": F.coalesce("std_difference", F.lit(0.0)),
        "ci95_lower": F.col("ci95_lower"),
        "ci95_upper": F.col("ci95_upper"),
        "t_statistic": F.col("t_statistic"),
        "cohens_dz": dz,
        "wilcoxon_w": F.col("wilcoxon_statistic"),
        "p_value": F.col("wilcoxon_p"),
    }
    return basic.select("metric", "n", *(F.bround(c, 6).alias(n) for n, c in cells.items()))


def attenuation(dense: DataFrame, hybrid: DataFrame) -> DataFrame:
    """How much of the dense penalty the hybrid saves, with a verdict."""
    both = dense.select("metric", F.col("mean_penalty").alias("dense")).join(hybrid.select("metric", F.col("mean_penalty").alias("hybrid")), "metric")
    out = both.withColumn("attenuation", F.col("dense") - F.col("hybrid"))
    return out.withColumn("verdict", F.when(F.col("attenuation") > 0, "Attenuated").otherwise("Not attenuated"))


def hypothesis_verdict(name: Column, penalty: Column, p: Column, alpha: float = 0.05) -> Column:
    """SUPPORTED for a significant positive penalty, else why not."""
    good = (penalty > 0) & (p < alpha)
    why = F.when(name == "H2", "NOT SUPPORTED (Gain)").otherwise("NOT SUPPORTED (Worse)")
    p_text = F.when(p < 0.001, F.lit("p < 0.001")).otherwise(F.format_string("p = %.3f", p))
    return F.concat(F.when(good, F.lit("SUPPORTED")).otherwise(why), F.lit(", "), p_text)
