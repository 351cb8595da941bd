"""Reports: Markdown and exit codes from small aggregates, the only place that collects. Rounds as Python does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge.operators import calibration as C
from trustgauge.operators import metrics as A
from trustgauge.operators import review as R
from trustgauge.operators.extraction import Extractor

DASH = "—"
PASSED, GATE_FAILED, CANARY_BROKEN = 0, 1, 2


def percent(x: float | None, places: int = 1) -> str:
    return DASH if x is None else f"{x:.{places}%}"


def shortened(text: str | None, most: int = 42) -> str:
    """A table cell: bars escaped, long texts cut with an ellipsis."""
    if text is None:
        return DASH
    cut = text if len(text) <= most else text[: most - 1] + "…"
    return cut.replace("|", r"\|")


def table(rows: list[dict], columns: list[str]) -> str:
    def cell(v) -> str:
        return DASH if v is None else f"{round(v, 4)}" if isinstance(v, float) else shortened(str(v))

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def markdown(points: DataFrame, threshold: float, records: DataFrame | None = None, ledger: DataFrame | None = None, limits: DataFrame | None = None) -> str:
    """The score report; its tables have a row a tier, field, bin, error type, threshold, reason or limit."""
    head = A.headline(points).first().asDict()
    parts = [
        "# Extraction reliability",
        f"Trust score {percent(head['trust_score'])}; accuracy where readable {percent(head['accuracy_readable'])}, critical fields {percent(head['critical_accuracy'])}; "
        f"abstained rightly {percent(head['abstain_ok_rate'])}, fabricated {percent(head['fabricated_rate'])}.",
        f"{head['n_scored']} points scored, {head['n_grey']} grey, {head['n_infra']} not run.",
    ]
    sections = {
        "By tier": A.score_by(points, "tier", "tier_ord").orderBy("tier_ord").drop("tier_ord"),
        "By document type": A.score_by(points, "doc_type").orderBy("doc_type"),
        "By field, worst first": A.worst_first(A.by_field(points)),
        "Errors": A.error_histogram(points).orderBy(F.desc("n_points"), "error_type"),
        "Calibration": C.bins(points).orderBy("bin"),
        "Thresholds": C.threshold_sweep_suffix(points).orderBy("step"),
        f"Review gate at {threshold:.2f}": C.review_gate(points, threshold),
    }
    if ledger is not None and records is not None:
        sections["Dossiers"] = R.dossier_summary(records, ledger)
        sections["Wrongly returned, by reason"] = R.wrongly_returned(records, ledger).orderBy(F.desc("n_dossiers"), "reason")
    sections["Three kinds of silence"] = A.silent_kinds(points)
    sections["Time by document type"] = A.timing(points.select("id", "doc_type", "elapsed_ms").distinct(), "doc_type").orderBy("overall", "key") if "elapsed_ms" in points.columns else None
    if limits is not None:
        sections["Open limits"] = limits.where("status = 'open'").select("code", "level", "title").orderBy("code")
    for title, df in sections.items():
        if df is not None:
            parts += [f"## {title}", table(_rows(df), df.columns)]
    return "\n\n".join(parts) + "\n"


def case_dossiers(cases: DataFrame) -> str:
    """Test cases (case_id, field, label, model, confidence, outcome) as Markdown, a section a case; for as many as a reader asks for."""
    parts: list[str] = ["# Test cases"]
    rows = _rows(cases.select("case_id", "field", "label", "model", "confidence", "outcome").orderBy("case_id", "field"))
    for case_id in dict.fromkeys(r["case_id"] for r in rows):
        parts += [f"## {case_id}", table([r for r in rows if r["case_id"] == case_id], ["field", "label", "model", "confidence", "outcome"])]
    return "\n\n".join(parts) + "\n"


def gate_exit(spark: SparkSession, extractor: Extractor, gate: DataFrame | None, only_regression: bool = False) -> tuple[int, list[str]]:
    """Exit code and messages: 2 if the extractor's self test fails (then nothing was measured), 1 for a failed gate, else 0."""
    fine, said = extractor.self_test(spark)
    if not fine:
        return CANARY_BROKEN, [said]
    if gate is None:
        return GATE_FAILED, ["there is no score"]
    rows = gate.where("not ok")
    rows = rows.where("tier <> 'absolute'") if only_regression else rows
    failed = [f"{r['tier']}: {r['metric']} {r['value']} against {r['limit']}" for r in rows.collect()]
    return (GATE_FAILED if failed else PASSED), failed


def regression_messages(tolerances: DataFrame) -> list[str]:
    return [f"tolerance: {r['metric']} fell by {abs(r['delta']):.4f}, more than {r['allowed']:.4f}" for r in tolerances.where("over").collect()]
