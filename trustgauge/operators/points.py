"""Check points: one row for each labelled field of each record, with its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions import match
from trustgauge.operators.ordered import running


def unnest_labels(labels: DataFrame) -> DataFrame:
    """A row for each field of a label record, in the record's order."""
    out = labels.select("id", "doc_type", "tier", F.posexplode("fields").alias("field_pos", "f"))
    return out.select("id", "doc_type", "tier", "field_pos", "f.field", "f.expectation", "f.label")


def of_runs(points: DataFrame, n_runs: int) -> DataFrame:
    """Every row once a run, as ``run`` from 0: a run that left no result for a record must show as such."""
    return points.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))


def first_values(results: DataFrame) -> DataFrame:
    """A row for each record and field that a result has; of several the first counts.

    Done inside the array, so the join that follows is the only shuffle.
    """
    fields = F.col("fields")
    first = F.filter(fields, lambda f, i: F.array_position(F.transform(fields, lambda g: g["field"]), f["field"]) == i + 1)
    return results.select("id", F.explode(first).alias("f")).select("id", "f.field", F.col("f.value").alias("model"), "f.confidence", "f.source")


def with_results(points: DataFrame, results: DataFrame) -> DataFrame:
    """Left join on the record: one without a result is an infrastructure error, not a silent model.

    The result keeps its array through the join; a field is looked up in it, so there is one
    shuffle on the record id whatever the number of fields. Results with a ``run`` meet the points of their run.
    """
    keys = ["id", *(c for c in ("run",) if c in results.columns)]
    r = results.select(
        *keys, F.lit(True).alias("_has"), "error", "abstain_reason", F.coalesce("no_anchor", F.lit(False)).alias("no_anchor"), "elapsed_ms", F.col("fields").alias("_fields")
    )
    joined = points.join(r, keys, "left")
    own = F.get(F.filter("_fields", lambda f: f["field"] == F.col("field")), F.lit(0))
    note = F.when(F.col("_has").isNull(), "no result for this record").otherwise(F.col("error"))
    return joined.withColumns(
        {
            "model": own["value"],
            "confidence": own["confidence"],
            "source": own["source"],
            "note": note,
            "infra": note.isNotNull(),
            "no_anchor": F.coalesce("no_anchor", F.lit(False)),
        }
    ).drop("_has", "_fields", "error")


def with_dimension(points: DataFrame, dimension: DataFrame) -> DataFrame:
    """Broadcast join with the field dimension (a row for each declared field); an undeclared field raises."""
    d = dimension.select("doc_type", "field", "type_ord", "field_ord", "severity", "weight", "kind")
    joined = points.join(F.broadcast(d), ["doc_type", "field"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no field"), "field", F.lit("in document type"), "doc_type")).cast("string")
    return joined.withColumn("kind", F.when(F.col("kind").isNull(), missing).otherwise(F.col("kind")))


def check_points(labels: DataFrame, results: DataFrame, dimension: DataFrame, kinds: tuple[str, ...] = tuple(match.RULES), similarity: bool = True) -> DataFrame:
    """The fact table that all metrics read."""
    return _judged(unnest_labels(labels), results, dimension, kinds, similarity)


def check_points_of_runs(
    labels: DataFrame, results: DataFrame, dimension: DataFrame, n_runs: int, kinds: tuple[str, ...] = tuple(match.RULES), similarity: bool = True
) -> DataFrame:
    """The fact table of ``n_runs`` runs, with ``run`` in front; results have a run from 0. Labels are read once for all runs."""
    return _judged(of_runs(unnest_labels(labels), n_runs), results, dimension, kinds, similarity, "run")


def _judged(cells: DataFrame, results: DataFrame, dimension: DataFrame, kinds: tuple[str, ...], similarity: bool, *keep: str) -> DataFrame:
    points = with_dimension(with_results(cells, results), dimension)
    out = match.with_verdict(points, kinds, similarity).withColumn("tier_ord", S.tier_ordinal(F.col("tier")))
    return out.select(
        *keep, "id", "doc_type", "type_ord", "tier", "tier_ord", "field", "field_ord", "severity", "weight", "expectation", "label", "model", "confidence",
        "source", "verdict", "error_type", "similarity", "note", "abstain_reason", "no_anchor", "elapsed_ms",
    )


def population(points: DataFrame) -> DataFrame:
    """points with ``population``: infra, grey, readable or unreadable, decided before anything is summed."""
    kind = (
        F.when(F.col("verdict") == S.SYSTEM_ERROR, "infra")
        .when(F.col("expectation") == S.GREY, "grey")
        .when(F.col("expectation") == S.MUST_EXTRACT, "readable")
        .when(F.col("expectation") == S.MUST_ABSTAIN, "unreadable")
    )
    return points.withColumn("population", kind)


def scored(points: DataFrame) -> DataFrame:
    return points.where((F.col("verdict") != S.SYSTEM_ERROR) & F.col("expectation").isin(S.MUST_EXTRACT, S.MUST_ABSTAIN))


def failing(points: DataFrame) -> DataFrame:
    """Points that count and aren't right, with their key."""
    rest = points.where((F.col("expectation") != S.GREY) & ~match.is_correct())
    return rest.withColumn("key", key())


def key():
    return F.concat_ws("::", F.col("id").cast("string"), "field")


def result_status(results: DataFrame) -> DataFrame:
    """(id, status): infrastructure error, abstained, text without an anchor, or the number of fields; first that holds."""
    n = F.size("fields")
    status = (
        F.when(F.col("error").isNotNull(), "infra error")
        .when(F.col("abstain_reason").isNotNull(), "abstained")
        .when(n == 0, F.when(F.col("no_anchor"), "text but no anchor").otherwise("no field"))
        .otherwise(F.concat(n.cast("string"), F.lit(" fields")))
    )
    return results.select("id", status.alias("status"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often: a load must fail on them, not keep one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def case_ids(records: DataFrame) -> DataFrame:
    """Running case number of a record in its document type and tier, by id."""
    n = F.col("_place")
    padded = F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    numbered = running(records, "id", ("doc_type", "tier"), _place=F.lit(1))
    return numbered.withColumn("case_id", F.concat_ws("-", F.lit("TC"), F.upper("doc_type"), F.upper("tier"), padded)).drop("_place", "_place_all")
