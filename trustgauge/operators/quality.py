"""Data-quality assertions: each returns the rows that break it, none for a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions.normalize import blank
from trustgauge.operators.review import needs_review


def undeclared_fields(values: DataFrame, dimension: DataFrame) -> DataFrame:
    return values.join(F.broadcast(dimension.select("doc_type", "field")), ["doc_type", "field"], "left_anti").select("id", "doc_type", "field")


def bad_confidence(values: DataFrame) -> DataFrame:
    """Values whose confidence is missing or outside 0 to 1."""
    fine = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return values.where(F.col("model").isNotNull() & ~fine).select("id", "field", "confidence")


def bad_source(values: DataFrame, sources: tuple[str, ...] = S.SOURCES) -> DataFrame:
    return values.where(F.col("model").isNotNull() & ~F.coalesce(F.col("source").isin(*sources), F.lit(False))).select("id", "field", "source")


def bad_flags(flags: DataFrame, threshold: float) -> DataFrame:
    """Flags that disagree with the threshold."""
    return flags.where(F.col("needs_review") != needs_review(F.col("confidence"), F.lit(threshold))).select("id", "field", "confidence", "needs_review")


def abstain_violations(labels: DataFrame, ledger: DataFrame, dimension: DataFrame) -> DataFrame:
    """(id, violation), a row for each rule that a dossier breaks: a value although unreadable, unreadable but not returned, returned without a reason, eligible with a critical gap.

    The dimension is a row a declared field; its critical fields are broadcast as a list a document type.
    """
    critical = dimension.where("severity = 'critical'").groupBy("doc_type").agg(F.collect_list("field").alias("_critical"))
    joined = ledger.join(labels.select("id", "readable"), "id").join(F.broadcast(critical), "doc_type", "left")
    given = F.transform(F.filter(F.coalesce("fields", F.array().cast(ledger.schema["fields"].dataType)), lambda f: ~blank(f["value"])), lambda f: f["field"])
    eligible = F.col("dossier_status") == S.ELIGIBLE
    rules = {
        "value on unreadable": ~F.col("readable") & (F.size("_given") > 0),
        "unreadable not returned": ~F.col("readable") & (F.col("dossier_status") != S.NEEDS_SUPPLEMENT),
        "no reason": (F.col("dossier_status") == S.NEEDS_SUPPLEMENT) & blank(F.col("reason")),
        "eligible with a critical gap": eligible & F.exists("_critical", lambda c: ~F.array_contains("_given", c)),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return joined.withColumn("_given", given).select("id", F.explode(broken).alias("violation"))


def label_violations(points: DataFrame) -> DataFrame:
    """Fields that must be abstained from although they have a label."""
    return points.where((F.col("expectation") == S.MUST_ABSTAIN) & ~blank(F.col("label"))).select("id", "field")


def uncovered_metrics(published: DataFrame, limits: DataFrame) -> DataFrame:
    """Published metrics that no limit covers."""
    covered = limits.select(F.explode("covers").alias("metric")).distinct()
    return published.join(covered, "metric", "left_anti")


def unbound(needed: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """Files without a counterpart."""
    return needed.join(bound, key, "left_anti")


#: How a file is named in a text of evidence.
EVIDENCE_FILE = r"[\w/\-]+\.(?:csv|jsonl|json|md|py)"


def limit_lints(limits: DataFrame) -> DataFrame:
    """(code, violation) of each rule that a limit breaks."""
    length = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rules = {
        "unproved too short": length("unproved") < 60,
        "evidence needed too short": length("evidence_needed") < 30,
        "no consequence": length("consequence") == 0,
        "unknown level": ~F.coalesce(F.col("level").isin(*S.LIMIT_LEVELS), F.lit(False)),
        "resolved without evidence": (F.col("status") == "resolved") & (length("evidence") < 40),
        "resolved without a file": (F.col("status") == "resolved") & ~F.coalesce(F.col("evidence").rlike(EVIDENCE_FILE), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return limits.select("code", F.explode(broken).alias("violation"))


#: Limits that stay open, at least: a measurement without any has not looked for them.
LEAST_OPEN = 5


def limit_set_violations(limits: DataFrame, headline_metrics: DataFrame) -> DataFrame:
    """(violation, metric): too few open limits, and headline metrics (metric) that no limit covers that blocks a conclusion."""
    few = limits.agg(F.count_if(F.col("status") == "open").alias("n")).where(F.col("n") < LEAST_OPEN)
    blocking = limits.where(F.col("level") == S.LIMIT_LEVELS[0]).select(F.explode("covers").alias("metric")).distinct()
    bare = headline_metrics.select("metric").distinct().join(blocking, "metric", "left_anti")
    return few.select(F.lit("too few open limits").alias("violation"), F.lit(None).cast("string").alias("metric")).unionByName(
        bare.select(F.lit("no blocking limit").alias("violation"), "metric")
    )


def missing_evidence_files(limits: DataFrame, files: DataFrame) -> DataFrame:
    """(code, file) that resolved limits name as evidence and that are not among files (path)."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = F.regexp_extract_all(F.col("evidence"), F.lit(EVIDENCE_FILE), F.lit(0))
    rows = limits.where("status = 'resolved'").select("code", F.explode(named).alias("file")).withColumn("name", base(F.col("file")))
    return rows.join(files.select(base(F.col("path")).alias("name")).distinct(), "name", "left_anti").select("code", "file")


def wrong_prefix(values: DataFrame, prefix: str) -> DataFrame:
    """Identifiers that could be a real person's: those without the test prefix."""
    return values.where(~F.startswith(F.col("label"), F.lit(prefix))).select("id", "label")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two tables only, repeats counted, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def bad_hashes(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Dossiers that don't lead back to the bytes they were read from: no link, no such file, or another hash. files is (path, sha256)."""
    there = files.select("path", F.col("sha256").alias("_there"))
    joined = ledger.select("id", "path", "sha256").join(there, "path", "left")
    what = (
        F.when(blank(F.col("path")) | blank(F.col("sha256")), "no link")
        .when(F.col("_there").isNull(), "no file")
        .when(F.col("_there") != F.col("sha256"), "other bytes")
    )
    return joined.select("id", what.alias("violation")).where("violation is not null")


#: Bars in a whole log line, at least.
LEAST_BARS = 6


def bad_log_lines(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Records without exactly one log line (id, line), and lines with too few columns."""
    bars = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    counted = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.min(bars).alias("bars"))
    joined = records.select("id").join(counted, "id", "full")
    what = F.when(F.coalesce("n_lines", F.lit(0)) != 1, "not one line").when(F.col("bars") < LEAST_BARS, "columns missing")
    return joined.select("id", what.alias("violation")).where("violation is not null")


#: Least share of second reads that agree, and least number of them.
LEAST_AGREEMENT, LEAST_COMPARED = 0.95, 30


def weak_agreement(agreed: DataFrame) -> DataFrame:
    """The agreement row if it is too low or rests on too few fields."""
    fine = (F.col("n_compared") >= LEAST_COMPARED) & F.coalesce(F.col("agreement") >= LEAST_AGREEMENT, F.lit(False))
    return agreed.where(~fine)


def uncovered(records: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Values that no record has."""
    want = records.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return want.join(records.select(column).distinct(), column, "left_anti")


#: Label records at least.
LEAST_RECORDS = 30


def label_set_violations(labels: DataFrame, dimension: DataFrame) -> DataFrame:
    """(doc_type, violation): types whose records don't hold just the declared fields, and under a null type a set that is too small."""
    own = labels.select("doc_type", F.array_sort(F.transform("fields", lambda f: f["field"])).alias("names")).distinct()
    declared = dimension.groupBy("doc_type").agg(F.array_sort(F.collect_list("field")).alias("declared"))
    other = own.join(F.broadcast(declared), "doc_type", "left").where(~F.col("names").eqNullSafe(F.col("declared")))
    few = labels.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LEAST_RECORDS)
    return other.select("doc_type", F.lit("other fields").alias("violation")).distinct().unionByName(few.select(F.lit(None).cast("string").alias("doc_type"), F.lit("too few records").alias("violation")))


def unclassified(failures: DataFrame) -> DataFrame:
    """Failing points (key, code) that have no failure code."""
    return failures.where("code = 'UNCLASSIFIED'").select("key")


def case_count(labels: DataFrame, points: DataFrame) -> DataFrame:
    """Fields of the labels and check points made of them, if they differ in number."""
    fields = labels.agg(F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("n_fields"))
    return fields.crossJoin(points.agg(F.count(F.lit(1)).alias("n_points"))).where("n_fields <> n_points")  # one row each
