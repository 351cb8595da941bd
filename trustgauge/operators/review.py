"""Review flags, dossier status and the evidence ledger. Nothing here takes labels: in use there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators.points import first_values


def needs_review(confidence: Column, threshold: Column | float) -> Column:
    """Below the threshold or without a confidence; one equal to it passes."""
    return F.coalesce(confidence < threshold, F.lit(True))


def review_flags(results: DataFrame, threshold: float) -> DataFrame:
    flags = results.select("id", F.explode("fields").alias("f")).select("id", "f.field", F.col("f.value").alias("value"), "f.confidence", "f.source")
    return flags.withColumn("needs_review", needs_review(F.col("confidence"), F.lit(threshold)))


def missing_critical(records: DataFrame, results: DataFrame, dimension: DataFrame) -> DataFrame:
    """(id, missing): critical fields of the record's type without a value, in the type's order; records lacking none are left out."""
    want = records.select("id", "doc_type").join(F.broadcast(dimension.where("severity = 'critical'").select("doc_type", "field", "field_ord")), "doc_type")
    have = first_values(results).where("model is not null and model <> ''").select("id", "field")
    lacking = want.join(have, ["id", "field"], "left_anti").groupBy("id")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("field_ord", "field"))), lambda x: x["field"])
    return lacking.agg(listed.alias("missing"))


def with_status(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """results with dossier_status and reason, the first of: infrastructure error, abstained, no field, critical field missing.

    The critical fields of the few document types are literals of the expression, so this is row-local.
    """
    critical: dict[str, list[str]] = {}
    for r in dimension.where("severity = 'critical'").orderBy("field_ord").select("doc_type", "field").collect():  # a row a declared field
        critical.setdefault(r["doc_type"], []).append(r["field"])
    wanted = F.lit(None).cast("array<string>")
    for doc_type, names in critical.items():
        wanted = F.when(F.col("doc_type") == doc_type, F.array(*map(F.lit, names))).otherwise(wanted)
    first = lambda name: F.get(F.filter("fields", lambda f: f["field"] == name), F.lit(0))["value"]
    missing = F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda n: F.coalesce(first(n), F.lit("")) == "")
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("cannot process: "), F.col("error")))
        .when(F.col("abstain_reason").isNotNull(), F.col("abstain_reason"))
        .when(F.size("fields") == 0, "text read but no field found")
        .when(F.size(missing) > 0, F.concat(F.lit("missing critical: "), F.array_join(missing, ", ")))
    )
    out = results.withColumn("reason", reason)
    return out.withColumn("dossier_status", F.when(F.col("reason").isNotNull(), S.NEEDS_SUPPLEMENT).otherwise(S.ELIGIBLE))


def evidence_ledger(records: DataFrame, results: DataFrame, dimension: DataFrame, threshold: float, files: DataFrame | None = None) -> DataFrame:
    """A row for each record: status, reason, fields with their flag, counts; a record without a result needs a supplement.

    With files (id, path, sha256) a record also has the path and hash of the file that it was read from.
    """
    flagged = F.transform(
        "fields",
        lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), f["confidence"].alias("confidence"), f["source"].alias("source"), needs_review(f["confidence"], F.lit(threshold)).alias("needs_review")),
    )
    done = with_status(results, dimension).select("id", F.lit(True).alias("_has"), "dossier_status", "reason", flagged.alias("fields"), "elapsed_ms", "error")
    out = records.select("id", "doc_type").join(done, "id", "left")
    out = out.withColumn("reason", F.when(F.col("_has").isNull(), "no result for this record").otherwise(F.col("reason")))
    out = out.withColumn("dossier_status", F.coalesce("dossier_status", F.lit(S.NEEDS_SUPPLEMENT)))
    n = F.coalesce(F.when(F.col("fields").isNotNull(), F.size("fields")), F.lit(0))
    flags = F.coalesce(F.when(F.col("fields").isNotNull(), F.size(F.filter("fields", lambda f: f["needs_review"]))), F.lit(0))
    if files is not None:
        out = out.join(files.select("id", "path", "sha256"), "id", "left")
    return out.withColumn("n_fields", n).withColumn("n_flagged", flags).drop("_has")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count(F.lit(1)).alias("n_dossiers"),
        F.count_if(F.col("dossier_status") == S.NEEDS_SUPPLEMENT).alias("n_needs_supplement"),
        F.coalesce(F.sum("n_flagged"), F.lit(0)).alias("n_flagged"),
    )


def with_ledger(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """records (id, readable, tier) with their dossier's status; one without a dossier has none."""
    return records.select("id", "readable", "tier").join(ledger.select("id", "dossier_status", "reason"), "id", "left")


def dossier_summary(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Readable dossiers returned wrongly or passed through, and unreadable ones rightly returned."""
    back = F.coalesce(F.col("dossier_status") == S.NEEDS_SUPPLEMENT, F.lit(False))
    read = F.col("readable")
    out = with_ledger(records, ledger).agg(
        F.count(F.lit(1)).alias("n_dossiers"),
        F.count_if(read).alias("n_readable"),
        F.count_if(read & back).alias("n_wrongly_returned"),
        F.try_divide(F.count_if(read & back), F.count_if(read)).alias("wrongly_returned_rate"),
        F.count_if(read & ~back).alias("n_passed"),
        F.try_divide(F.count_if(read & ~back), F.count_if(read)).alias("passed_rate"),
        F.try_divide(F.count_if(~read & back), F.count_if(~read)).alias("unreadable_status_rate"),
    )
    return out


def wrongly_returned(records: DataFrame, ledger: DataFrame, by: str = "reason") -> DataFrame:
    """Wrongly returned dossiers by tier, or by the reason before its colon."""
    rows = with_ledger(records, ledger).where(F.col("readable") & (F.col("dossier_status") == S.NEEDS_SUPPLEMENT))
    key = F.split(F.coalesce("reason", F.lit("")), ":")[0] if by == "reason" else F.col(by)
    return rows.groupBy(key.alias(by)).agg(F.count(F.lit(1)).alias("n_dossiers"))


#: Characters of a file's hash in a log line.
HASH_PREFIX = 12


def log_lines(ledger: DataFrame, run_at: str) -> DataFrame:
    """One pipe-delimited line a dossier: run, id, start of the file's hash, milliseconds, status, counts and reason; a dash for what is null."""
    have = set(ledger.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in have else F.lit("-")
    parts = [F.lit(run_at), F.col("id").cast("string"), F.substring(text("sha256"), 1, HASH_PREFIX)]
    parts.append(F.when(F.col("elapsed_ms").isNotNull(), F.format_string("%.1f", "elapsed_ms")).otherwise("-") if "elapsed_ms" in have else F.lit("-"))
    parts += [text("dossier_status"), text("n_fields"), text("n_flagged"), text("reason")]
    return ledger.select("id", F.concat_ws(" | ", *parts).alias("line"))
