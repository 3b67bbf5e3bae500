"""Exports of comparisons: LaTeX and Markdown tables, CSV files, replication bundles.  Their inputs are a row per metric."""

from __future__ import annotations

import hashlib
import json
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What LaTeX text needs in place of special characters, in the order of replacement.
LATEX = (
    ("\\", "\\textbackslash{}"),
    ("&", "\\&"),
    ("%", "\\%"),
    ("$", "\\$"),
    ("#", "\\#"),
    ("_", "\\_"),
    ("{", "\\{"),
    ("}", "\\}"),
    ("~", "\\textasciitilde{}"),
    ("^", "\\textasciicircum{}"),
)
SUMMARY = (
    "metric mean_run_a mean_run_b mean_difference std_difference ci95_lower ci95_upper t_statistic t_df raw_p_value cohens_dz "
    "wilcoxon_statistic wilcoxon_pvalue adjustment_method adjusted_p_value significance_level n_paired"
).split()


def latex_escape(text: str) -> str:
    """Replacements one after another; the braces that the backslash brings are replaced in their turn."""
    for plain, escaped in LATEX:
        text = text.replace(plain, escaped)
    return text


def latex_escape_column(text: Column) -> Column:
    for plain, escaped in LATEX:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def summary_rows(report: DataFrame) -> DataFrame:
    """The summary's columns under their published names."""
    names = {
        "mean_a": "mean_run_a",
        "mean_b": "mean_run_b",
        "p_value": "raw_p_value",
        "wilcoxon_p": "wilcoxon_pvalue",
        "adjustment": "adjustment_method",
        "adjusted_p": "adjusted_p_value",
        "stars": "significance_level",
        "n": "n_paired",
    }
    return report.withColumnsRenamed(names).select(*SUMMARY).orderBy("metric")


def fixed_places(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles as text with a fixed number of places; nulls are empty."""
    show = lambda n, t: F.coalesce(F.format_string(f"%.{places}f", F.col(n)), F.lit("")) if t == "double" else F.coalesce(F.col(n).cast("string"), F.lit(""))
    return df.select(*(F.when(F.col(n).isNull(), "").otherwise(show(n, t)).alias(n) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the table's order; for small results."""
    frame = fixed_places(df).toPandas()
    frame.to_csv(path, index=False)


def raw_pairs(pairs: DataFrame, unit: str = "query_id") -> DataFrame:
    return pairs.select(F.col(unit).alias("query_id"), "metric", F.col("a").alias("score_run_a"), F.col("b").alias("score_run_b"), "difference").orderBy("metric", "query_id")


def _number(value, places: int = 4) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "--"
    if math.isinf(value):
        return "$\\infty$" if value > 0 else "$-\\infty$"
    return f"{value:+.{places}f}"


def latex_table(rows: list[dict], caption: str, label: str, bold: bool = True) -> str:
    """A booktabs table of differences with intervals and stars."""
    lines = ["\\begin{table}[ht]", "\\centering", f"\\caption{{{latex_escape(caption)}}}", f"\\label{{{label}}}", "\\begin{tabular}{lrrrrr}", "\\toprule"]
    lines.append("Metric & Run A & Run B & Difference & 95\\% CI & $d_z$ \\\\")
    lines.append("\\midrule")
    for r in rows:
        mark = "" if r["significance_level"] in ("ns", None) else f"$^{{{r['significance_level']}}}$"
        change = _number(r["mean_difference"]) + mark
        if bold and mark:
            change = f"\\textbf{{{change}}}"
        interval = f"[{_number(r['ci95_lower'])}, {_number(r['ci95_upper'])}]"
        lines.append(f"{latex_escape(r['metric'])} & {r['mean_run_a']:.4f} & {r['mean_run_b']:.4f} & {change} & {interval} & {_number(r['cohens_dz'], 2)} \\\\")
    return "\n".join([*lines, "\\bottomrule", "\\end{tabular}", "\\end{table}", ""])


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"


def ascii_table(rows: list[dict], columns: list[str]) -> str:
    """Columns padded to their widest cell."""
    cells = [columns, *([str(r.get(c, "")) for c in columns] for r in rows)]
    width = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    text = [" | ".join(c.ljust(w) for c, w in zip(line, width, strict=True)).rstrip() for line in cells]
    return "\n".join([text[0], "-+-".join("-" * w for w in width), *text[1:]]) + "\n"


def delta(a: float, b: float) -> str:
    """A change with its sign, and in per cent where that is defined."""
    return f"{b - a:+.4f}" + (f" ({(b - a) / abs(a):+.1%})" if a else "")


def bundle(folder: str, report: DataFrame, pairs: DataFrame, manifest: dict, differences: list) -> dict[str, str]:
    """Write a comparison's files and their SHA-256 sums; returns the sums by name."""
    os.makedirs(folder, exist_ok=True)
    rows = summary_rows(report)
    data = [r.asDict() for r in rows.collect()]
    texts = {
        "statistical_summary.json": json.dumps(data, indent=2, sort_keys=True, default=str),
        "comparison.tex": latex_table(data, manifest.get("title", "Comparison"), "tab:comparison"),
        "config_diff.json": json.dumps(differences, indent=2, default=str),
        "manifest.json": json.dumps(manifest, indent=2, sort_keys=True, default=str),
    }
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
            out.write(text)
    write_csv(rows, os.path.join(folder, "statistical_summary.csv"))
    write_csv(raw_pairs(pairs), os.path.join(folder, "raw_paired_observations.csv"))
    sums = {}
    for name in sorted(os.listdir(folder)):
        if name != "sha256.json":
            with open(os.path.join(folder, name), "rb") as data_file:
                sums[name] = hashlib.sha256(data_file.read()).hexdigest()
    with open(os.path.join(folder, "sha256.json"), "w", encoding="utf-8") as out:
        json.dump(sums, out, indent=2)
    return sums


def export_run(summaries: DataFrame, kind: str) -> str:
    """A run's metric summaries as LaTeX, CSV or JSON."""
    rows = [r.asDict() for r in summaries.orderBy("metric").collect()]
    columns = ["metric", "mean", "median", "min", "max", "stddev", "count"]
    if kind == "json":
        return json.dumps([{c: r[c] for c in columns} for r in rows], indent=2)
    if kind == "csv":
        return "\n".join([",".join(columns), *(",".join(str(r[c]) for c in columns) for r in rows)]) + "\n"
    if kind == "latex":
        body = "\n".join(f"{latex_escape(r['metric'])} & " + " & ".join(f"{r[c]:.4f}" for c in columns[1:6]) + f" & {r['count']} \\\\" for r in rows)
        return f"\\begin{{tabular}}{{lrrrrrr}}\n\\toprule\n{' & '.join(columns)} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n"
    raise ValueError(f"unknown export {kind!r}")
