"""Reports of a language-transfer study: its result file checked, then tables and a text in LaTeX and Markdown."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass

from millrace.sources.export import latex_escape, markdown_table

# The names that result files of such a study use.
HYPOTHESES = ("H1_dense_EN_to_BN", "H2_dense_BN_to_EN", "H3_hybrid_attenuation_EN_to_BN", "H4_hybrid_attenuation_BN_to_EN")
PARTS = ("metadata", "hypotheses", "all_comparisons")
NUMBERS = ("mean_mono", "mean_cross", "mean_penalty", "cohens_dz", "wilcoxon_w", "wilcoxon_p_value")


class InvalidStudy(ValueError):
    """A result file that lacks something or holds what is no number."""


@dataclass(frozen=True)
class Finding:
    """What became of a hypothesis."""

    name: str
    statement: str
    metric: str
    change: float
    effect: float
    p: float
    supported: bool

    def verdict(self) -> str:
        """The decision; a gain where a loss was expected is one, whatever its p."""
        p = "p < 0.001" if self.p < 0.001 else f"p = {self.p:.3f}"
        if self.supported:
            return f"SUPPORTED, {p}"
        return "NOT SUPPORTED (Gain)" if self.name.startswith("H2") else f"NOT SUPPORTED (Worse), {p}"


@dataclass(frozen=True)
class Study:
    """A checked result file: comparisons are rows of condition, paradigm, metric and ``NUMBERS`` with their interval."""

    title: str
    protocol: str
    model: str
    dimension: int
    units: int
    findings: tuple[Finding, ...]
    comparisons: tuple[dict, ...]


def _number(source: dict, where: str, *names: str, default: float | None = None) -> float:
    for name in names:
        if source.get(name) is not None:
            try:
                return float(source[name])
            except (TypeError, ValueError):
                raise InvalidStudy(f"{where}: {name} is {source[name]!r}, not a number") from None
    if default is None:
        raise InvalidStudy(f"{where} lacks {' and '.join(names)}")
    return default


def _finding(name: str, row: dict) -> Finding:
    test = row.get("wilcoxon_signed_rank") or {}
    return Finding(
        name,
        str(row.get("statement", "")),
        str(row.get("metric", "recall@5")),
        _number(row, name, "mean_penalty", "mean_attenuation"),
        _number(row, name, "cohens_dz", default=0.0),
        _number(test, name, "adj_p_holm", "raw_p", default=1.0),
        row.get("primary_decision") == "SUPPORTED",
    )


def study(data: dict) -> Study:
    """Check a parsed result file; what is missing is named."""
    if not isinstance(data, dict) or (lost := [p for p in PARTS if not isinstance(data.get(p), dict)]):
        raise InvalidStudy(f"the results lack {', '.join(PARTS if not isinstance(data, dict) else lost)}")
    meta, given = data["metadata"], data["hypotheses"]
    if lost := [h for h in HYPOTHESES if h not in given]:
        raise InvalidStudy(f"the results lack the hypotheses {', '.join(lost)}")
    if lost := [h for h in HYPOTHESES if not isinstance(given[h], dict)]:
        raise InvalidStudy(f"no table of results: {', '.join(lost)}")
    rows, sizes = [], set()
    for condition, by_metric in sorted(data["all_comparisons"].items()):
        paradigm = next((p for p in ("dense", "bm25", "hybrid") if p in condition.lower()), "hybrid")
        if not isinstance(by_metric, dict):
            raise InvalidStudy(f"no table of results: {condition}")
        for metric, cells in sorted(by_metric.items()):
            where = f"{condition}, {metric}"
            if not isinstance(cells, dict):
                raise InvalidStudy(f"no table of results: {where}")
            low, high = (cells.get("ci_95") or (math.nan, math.nan))[:2]
            numbers = {n: _number(cells, where, n, default=math.nan if n not in NUMBERS[:3] else None) for n in NUMBERS}
            rows.append({"condition": condition, "paradigm": paradigm, "metric": metric, **numbers, "low": float(low), "high": float(high), "stars": str(cells.get("significance_stars", "ns"))})
            if cells.get("n_units") is not None:
                sizes.add(int(cells["n_units"]))
    if len(sizes) > 1:
        raise InvalidStudy(f"the comparisons match different numbers of units: {sorted(sizes)}")
    units = sizes.pop() if sizes else int(_number(meta, "metadata", "matched_units", default=0))
    vectors = meta.get("embedding_configuration") or {}
    return Study(
        str(meta.get("study", "Language transfer")),
        str(meta.get("evaluation_protocol_version", "")),
        str(vectors.get("model_identifier", "")),
        int(_number(vectors, "metadata", "embedding_dimension", default=0)),
        units,
        tuple(_finding(h, given[h]) for h in HYPOTHESES),
        tuple(rows),
    )


def read(*paths: str) -> Study:
    """The first of some result files that exists."""
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                try:
                    return study(json.load(file))
                except json.JSONDecodeError as error:
                    raise InvalidStudy(f"{path} is not JSON: {error}") from error
    raise InvalidStudy(f"no results at {', '.join(paths)}")


def _cell(value: float, places: int = 4) -> str:
    return "--" if math.isnan(value) else f"{value:.{places}f}"


def comparison_latex(found: Study) -> str:
    """All comparisons as a booktabs table, a rule between conditions."""
    lines = ["\\begin{table}[ht]", "\\centering", f"\\caption{{{latex_escape(found.title)} ({found.units} matched units)}}", "\\label{tab:transfer}", "\\begin{tabular}{llrrrrl}", "\\toprule"]
    lines += ["Condition & Metric & Mono & Cross & Penalty & 95\\% CI & $d_z$ \\\\", "\\midrule"]
    before = None
    for r in found.comparisons:
        if before not in (None, r["condition"]):
            lines.append("\\midrule")
        before = r["condition"]
        stars = "" if r["stars"] == "ns" else f"$^{{{r['stars']}}}$"
        cells = [latex_escape(r["condition"]), latex_escape(r["metric"]), _cell(r["mean_mono"]), _cell(r["mean_cross"]), _cell(r["mean_penalty"]) + stars]
        lines.append(" & ".join([*cells, f"[{_cell(r['low'])}, {_cell(r['high'])}]", _cell(r["cohens_dz"], 2)]) + " \\\\")
    return "\n".join([*lines, "\\bottomrule", "\\end{tabular}", "\\end{table}", ""])


def _finding_rows(found: Study) -> list[dict]:
    return [{"hypothesis": f.name.split("_")[0], "statement": f.statement, "metric": f.metric, "change": _cell(f.change), "d_z": _cell(f.effect, 2), "verdict": f.verdict()} for f in found.findings]


def hypothesis_latex(found: Study) -> str:
    rows = [" & ".join(latex_escape(str(v)) for v in row.values()) + " \\\\" for row in _finding_rows(found)]
    return "\n".join(["\\begin{tabular}{llllll}", "\\toprule", "Hypothesis & Statement & Metric & Change & $d_z$ & Verdict \\\\", "\\midrule", *rows, "\\bottomrule", "\\end{tabular}", ""])


def narrative(found: Study) -> str:
    """The study in words: what was compared, each finding, and where the penalty is least and greatest."""
    setting = f" with {found.model} ({found.dimension} dimensions)" if found.model else ""
    text = [f"Each of {found.units} units was asked in the language of its document and across languages{setting}, under protocol {found.protocol or 'unnamed'}."]
    for f in found.findings:
        text.append(f"{f.name.split('_')[0]}: {f.statement.rstrip('.') or f.name}. The mean change of {f.metric} is {_cell(f.change)} (d_z {_cell(f.effect, 2)}): {f.verdict()}.")
    main = [r for r in found.comparisons if r["metric"] == found.findings[0].metric]
    if main:
        least, most = (pick(main, key=lambda r: r["mean_penalty"]) for pick in (min, max))
        text.append(f"By {main[0]['metric']} the penalty is least for {least['condition']} ({_cell(least['mean_penalty'])}) and greatest for {most['condition']} ({_cell(most['mean_penalty'])}).")
    return "\n\n".join(text) + "\n"


def markdown(found: Study) -> str:
    rows = [{k: (_cell(v) if isinstance(v, float) else v) for k, v in r.items()} for r in found.comparisons]
    table = markdown_table(rows, ["condition", "paradigm", "metric", *NUMBERS, "low", "high", "stars"])
    hypotheses = markdown_table(_finding_rows(found), ["hypothesis", "statement", "metric", "change", "d_z", "verdict"])
    return f"# {found.title}\n\n{narrative(found)}\n## Hypotheses\n\n{hypotheses}\n## Comparisons\n\n{table}"


def write(found: Study, folder: str) -> list[str]:
    """Write the report's files; returns their paths."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, text in (("comparisons.tex", comparison_latex(found)), ("hypotheses.tex", hypothesis_latex(found)), ("report.md", markdown(found))):
        out.append(os.path.join(folder, name))
        with open(out[-1], "w", encoding="utf-8") as file:
            file.write(text)
    return out
