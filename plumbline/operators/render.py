"""Reports as text: Markdown, CSV, LaTeX, JSON and HTML of small, already aggregated tables.

Numbers are rounded by Python, ties to even on the exact binary value. A table here has a row for each configuration,
repository or file of one run, so it is collected; anything larger belongs into `df.write`.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions.scalars import STATUS_COLOURS, STATUS_MARKS
from ..sources.schemas import METRICS
from .metrics import ALL_METRICS

NONE = "—"
#: Columns of the tables, in their order.
MARKDOWN_HEAD = ("Config", "Files", "Gen", "Val", "DiffCov", "Branch", "Err-path", "Mut", "Tok/test", "Assert/test", "NoA%", "NilOnly%", "TestNameScore", "VarNameScore", "Dur(s)")
MARKDOWN_RULE = ("--------", "------:", "----:", "----:", "--------:", "-------:", "---------:", "----:", "---------:", "------------:", "-----:", "---------:", "--------------:", "-------------:", "-------:")
CSV_HEAD = ("config", "files", "tests_generated", "tests_validated", "diff_cov_pct", "branch_cov_pct", "error_path_cov_pct", "mutation_pct", "tokens_per_test", "assertions_per_test", "no_assertions_pct",
            "nil_only_pct", "error_assertions_pct", "test_name_score", "var_name_score", "duration_s")
LATEX_HEAD = ("Config", "Files", "Gen", "Val", "DiffCov", "Branch", "ErrPath", "Mut", "Tok/test")
#: Headings of the mutation report.
MUTATION_TITLE, SURVIVORS_TITLE, BY_TYPE_TITLE = "## 🧬 Mutation Testing Results", "### ⚠️ Survived Mutants (tests did NOT catch these)", "### By Mutation Type"
SURVIVORS_HEAD, BY_TYPE_HEAD = ("#", "Function", "Line", "Mutation", "Original", "Replacement"), ("Type", "Killed", "Total", "Score")
#: How a metric is written.
PERCENT_METRICS = ("diff_cov_pct", "branch_cov_pct", "error_path_cov_pct", "mutation_pct", "no_assertions_pct", "nil_only_pct", "error_asserts_pct")
DIGITS = {"token_efficiency": 0, "duration_sec": 0, "tests_validated": 0, "assertion_ratio": 2, "test_name_score": 1, "var_name_score": 1}


def number(value: float | None, digits: int) -> str:
    return NONE if value is None else f"{value:.{digits}f}"


def percentage(value: float | None) -> str:
    return NONE if value is None else f"{value:.1f}%"


def csv_number(value: float | None) -> str:
    return "" if value is None else f"{value:.4f}"


def metric(value: float | None, name: str) -> str:
    return percentage(value) if name in PERCENT_METRICS else number(value, DIGITS.get(name, 3))


def latex(text: str) -> str:
    return "".join("\\" + c if c in "_&#%" else c for c in text)


def _table(rows: Iterable[Iterable[str]]) -> str:
    return "".join("| " + " | ".join(r) + " |\n" for r in rows)


def summary_markdown(summary: DataFrame) -> str:
    def cells(r):
        yield from (r["config"], str(r["files_processed"]), str(r["tests_generated"]), str(r["tests_validated"]))
        yield from (percentage(r[m]) for m in METRICS[:4])
        yield from (number(r["token_efficiency"], 0), number(r["assertion_ratio"], 2), percentage(r["no_assertions_pct"]), percentage(r["nil_only_pct"]), number(r["test_name_score"], 1), number(r["var_name_score"], 1), f"{r['duration_sec']:.1f}")

    return _table([MARKDOWN_HEAD]) + "|" + "|".join(MARKDOWN_RULE) + "|\n" + _table(cells(r) for r in summary.collect())


def summary_csv(summary: DataFrame) -> str:
    lines = [",".join(CSV_HEAD)]
    for r in summary.collect():
        lines.append(",".join([r["config"], str(r["files_processed"]), str(r["tests_generated"]), str(r["tests_validated"]), *(csv_number(r[m]) for m in METRICS), f"{r['duration_sec']:.1f}"]))
    return "\n".join(lines) + "\n"


def _tabular(columns: str, head: list[str], rows: Iterable[list[str]]) -> str:
    out = [f"\\begin{{tabular}}{{{columns}}}", "\\hline", " & ".join(head) + " \\\\", "\\hline", *(" & ".join(r) + " \\\\" for r in rows), "\\hline", "\\end{tabular}"]
    return "\n".join(out) + "\n"


def summary_latex(summary: DataFrame) -> str:
    rows = ([latex(r["config"]), str(r["files_processed"]), str(r["tests_generated"]), str(r["tests_validated"]), *(percentage(r[m]) for m in METRICS[:4]), number(r["token_efficiency"], 0)] for r in summary.collect())
    return _tabular("l r r r r r r r r", list(LATEX_HEAD), rows)


def matrix_markdown(matrix: DataFrame, name: str) -> str:
    configs = matrix.columns[1:]
    out = f"**Metric:** `{name}`\n\n| Repo |" + "".join(f" {c} |" for c in configs) + "\n|------|" + "----:|" * len(configs) + "\n"
    return out + _table([r[0], *(metric(r[c], name) for c in configs)] for r in matrix.collect())


def matrix_csv(matrix: DataFrame) -> str:
    configs = matrix.columns[1:]
    return "\n".join([",".join(["repo", *configs]), *(",".join([r[0], *(csv_number(r[c]) for c in configs)]) for r in matrix.collect())]) + "\n"


def matrix_latex(matrix: DataFrame, name: str) -> str:
    configs = matrix.columns[1:]
    return _tabular("l" + " r" * len(configs), ["Repo", *map(latex, configs)], ([latex(r[0]), *(metric(r[c], name) for c in configs)] for r in matrix.collect()))


def dump(summary: DataFrame, matrices: DataFrame) -> str:
    """JSON of the summary and of one matrix a metric, from the table of all matrices."""
    configs = [c for c in matrices.columns if c not in ("metric", "repo")]
    by: dict[str, dict] = {m: {"metric": m, "repos": [], "configs": configs, "cells": []} for m in ALL_METRICS}
    for r in matrices.collect():
        one = by.setdefault(r["metric"], {"metric": r["metric"], "repos": [], "configs": configs, "cells": []})
        one["repos"].append(r["repo"])
        one["cells"].append([r[c] for c in configs])
    return json.dumps({"summary": [r.asDict() for r in summary.collect()], "matrices": by}, indent=2) + "\n"


def mutation_markdown(mutants: DataFrame) -> str:
    from . import mutation

    s = mutation.score(mutants).first()
    out = f"{MUTATION_TITLE}\n\n**Mutation Score: {s['score']:.1f}%** ({s['killed']} killed / {s['total']} total" + (f", {s['errors']} errors" if s["errors"] else "") + ")\n\n"
    if s["survived"]:
        alive = mutants.where("not killed and coalesce(error, '') = ''").orderBy("id").collect()
        out += f"{SURVIVORS_TITLE}\n\n" + _table([SURVIVORS_HEAD]) + "|---|----------|------|----------|----------|-------------|\n"
        out += _table((str(m["id"]), m["func_name"], str(m["line"]), m["type"], f"`{m['original']}`", f"`{m['replacement']}`") for m in alive) + "\n"
    out += f"{BY_TYPE_TITLE}\n\n" + _table([BY_TYPE_HEAD]) + "|------|--------|-------|-------|\n"
    return out + _table((r["type"], str(r["killed"]), str(r["total"]), f"{r['score']:.0f}%") for r in mutation.by_type(mutants).where(mutation_kinds()).collect())


def mutation_kinds():
    from pyspark.sql import functions as F

    from .mutation import KINDS

    return F.col("type").isin(*KINDS)


def compact_feedback(feedback: Iterable) -> str:
    """PASS and FAIL lines; what was expected and came, else the message, cut at 150 bytes."""
    out = []
    for f in feedback:
        if f["passed"]:
            out.append(f"PASS {f['name']}\n")
            continue
        text = f"FAIL {f['name']}"
        if f["expected"] and f["got"]:
            text += f": expected {json.dumps(f['expected'], ensure_ascii=False)}, got {json.dumps(f['got'], ensure_ascii=False)}"
        elif f["error"]:
            raw = f["error"].encode()
            text += ": " + (raw[:150].decode(errors="ignore") + "..." if len(raw) > 150 else f["error"])
        out.append(text + (f" ({f['line']})" if f["line"] else "") + "\n")
    return "".join(out)


def pull_request_markdown(files: list[dict], totals: dict) -> str:
    """A run's files and totals for a pull request. Function lists are cut at 40 characters."""
    cut = lambda s: s if len(s) <= 40 else s[:37] + "..."
    head = [("Files processed", str(totals["files_processed"])), ("Tests generated", str(totals["tests_generated"])), ("Tests validated", str(totals["tests_validated"])),
            ("Diff coverage", percentage(totals.get("diff_coverage_pct"))), ("Branch coverage", percentage(totals.get("branch_coverage_pct"))), ("Error-path coverage", percentage(totals.get("error_path_coverage_pct"))),
            ("Mutation score", percentage(totals.get("mutation_score_pct"))), ("Tokens per test", number(totals.get("token_efficiency_tokens_per_test"), 0))]
    out = "## Test generation report\n\n" + _table([("Metric", "Value")]) + "|--------|-------|\n" + _table(head) + "\n### Files\n\n"
    out += _table([("File", "Functions", "Status", "Diff coverage", "Mutation")]) + "|------|-----------|--------|--------------|----------|\n"
    return out + _table((f"`{f['file']}`", cut(", ".join(f.get("functions") or [])), f"{STATUS_MARKS.get(f['status'], '')} {f['status']}", percentage(f.get("diff_coverage_pct")), percentage(f.get("mutation_score_pct"))) for f in files)


def run_html(files: list[dict], totals: dict, title: str) -> str:
    """One self-contained page: cards of totals, a bar of coverage for each file."""
    card = "".join(f"<div class=card><b>{html.escape(v)}</b><span>{k}</span></div>" for k, v in (("Files", str(totals["files_processed"])), ("Tests", str(totals["tests_validated"])), ("Diff coverage", percentage(totals.get("diff_coverage_pct")))))
    rows = ""
    for f in files:
        pct = min(100.0, max(0.0, f.get("diff_coverage_pct") or 0.0))
        colour = STATUS_COLOURS["success" if pct >= 80 else "partial" if pct >= 50 else "failed"]
        rows += f"<tr><td>{html.escape(f['file'])}</td><td style='color:{STATUS_COLOURS.get(f['status'], '#666')}'>{html.escape(f['status'])}</td><td><div class=bar><i style='width:{pct:.0f}%;background:{colour}'></i></div>{pct:.1f}%</td></tr>\n"
    style = "body{font:14px sans-serif;margin:2em}.card{display:inline-block;margin:1em}.card span{display:block}.bar{width:200px;background:#eee}.bar i{display:block;height:8px}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{card}<table>{rows}</table></body></html>\n"


def validation_summary(r: dict) -> str:
    if not r["compiles"]:
        return "compilation failed"
    return f"{r['passed']} passed, {r['failed']} failed" if not r["tests_pass"] else f"all {r['passed']} tests passed"
