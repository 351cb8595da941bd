"""Confidence calibration, separation and the trade-off of review thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators.ordered import running
from trustgauge.operators.points import scored


def judged(points: DataFrame) -> DataFrame:
    """Readable points with a value and a confidence."""
    return scored(points).where((F.col("expectation") == S.MUST_EXTRACT) & F.col("confidence").isNotNull() & F.col("verdict").isin(S.CORRECT, S.WRONG))


def bin_of(confidence: Column) -> Column:
    """Number of the bin [edge, next edge) that a confidence is in, null outside all."""
    out = F.lit(None).cast("int")
    edges = S.CONFIDENCE_EDGES
    for i in reversed(range(len(edges) - 1)):
        out = F.when((confidence >= edges[i]) & (confidence < edges[i + 1]), i).otherwise(out)
    return out


def bin_label(i: Column) -> Column:
    edges = F.array(*(F.lit(e) for e in S.CONFIDENCE_EDGES))
    return F.format_string("[%.2f,%.2f)", F.get(edges, i), F.least(F.get(edges, i + 1), F.lit(1.0)))


def bins(points: DataFrame) -> DataFrame:
    """Samples, mean confidence, accuracy and their gap in each bin that has any."""
    b = judged(points).withColumn("bin", bin_of(F.col("confidence"))).where("bin is not null")
    right = F.avg((F.col("verdict") == S.CORRECT).cast("double"))
    out = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n_points"), F.avg("confidence").alias("mean_confidence"), right.alias("accuracy"))
    return out.withColumn("gap", F.col("mean_confidence") - F.col("accuracy")).withColumn("label", bin_label(F.col("bin")))


def expected_error(points: DataFrame) -> DataFrame:
    """ECE from the bins' unrounded figures; null without samples."""
    return bins(points).agg(F.try_divide(F.sum(F.col("n_points") * F.abs("gap")), F.sum("n_points")).alias("ece"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("n_points"))


def mean_by_class(points: DataFrame) -> DataFrame:
    return judged(points).agg(
        F.avg(F.when(F.col("verdict") == S.CORRECT, F.col("confidence"))).alias("mean_when_correct"),
        F.avg(F.when(F.col("verdict") == S.WRONG, F.col("confidence"))).alias("mean_when_wrong"),
    )


def auc(points: DataFrame) -> DataFrame:
    """Chance that a correct point is more confident than a wrong one, ties a half; null if a class is empty.

    From counts by distinct confidence and running sums over those, not from pairs or a rank over all rows.
    """
    by = judged(points).groupBy("confidence").agg(
        F.count_if(F.col("verdict") == S.CORRECT).alias("right"), F.count_if(F.col("verdict") == S.WRONG).alias("wrong")
    )
    below = F.col("upto") - F.col("wrong")
    won = running(by, "confidence", upto=F.col("wrong")).withColumn("won", F.col("right") * (below + 0.5 * F.col("wrong")))
    return won.agg(F.try_divide(F.sum("won"), F.sum("right") * F.sum("wrong")).alias("auc"))


def auc_pairs(points: DataFrame) -> DataFrame:
    """The same from pairs of distinct confidences with their counts: the definition, for checking."""
    by = judged(points).groupBy("confidence", "verdict").agg(F.count(F.lit(1)).alias("n"))
    a = by.where(F.col("verdict") == S.CORRECT).select(F.col("confidence").alias("ca"), F.col("n").alias("na"))
    b = by.where(F.col("verdict") == S.WRONG).select(F.col("confidence").alias("cb"), F.col("n").alias("nb"))
    won = F.when(F.col("ca") > F.col("cb"), 1.0).when(F.col("ca") == F.col("cb"), 0.5).otherwise(0.0)
    pairs = F.col("na") * F.col("nb")
    return a.join(b, F.lit(True)).agg(F.try_divide(F.sum(won * pairs), F.sum(pairs)).alias("auc"))


def _valued(points: DataFrame) -> DataFrame:
    return scored(points).where("model is not null and confidence is not null")


def _sweep(points: DataFrame, by_step: DataFrame) -> DataFrame:
    """Rates from counts by step; no row at all without values or without anything to fill in."""
    total = scored(points).agg(F.count_if(F.col("expectation") == S.MUST_EXTRACT).alias("n_must_extract"))
    out = by_step.crossJoin(F.broadcast(total)).where("n_must_extract > 0")  # one row
    auto = F.col("n_auto") / F.col("n_must_extract")
    return out.select(
        "step", (F.col("step") / S.SWEEP_STEPS).alias("threshold"), "n_auto", "n_must_extract", auto.alias("auto_rate"), (1 - auto).alias("review_rate"),
        "n_leaks", "n_critical_leaks", F.coalesce(F.try_divide("n_leaks", "n_above"), F.lit(0.0)).alias("leak_share"),
    )


def _is_leak() -> Column:
    return F.col("verdict").isin(S.WRONG, S.FABRICATED)


def threshold_sweep(points: DataFrame) -> DataFrame:
    """What passes unseen at each threshold i / 20: a range join of the few thresholds with counts by distinct confidence."""
    critical = F.col("severity") == "critical"
    by = _valued(points).groupBy("confidence").agg(
        F.count(F.lit(1)).alias("above"),
        F.count_if(F.col("expectation") == S.MUST_EXTRACT).alias("auto"),
        F.count_if(_is_leak()).alias("leaks"),
        F.count_if(_is_leak() & critical).alias("critical"),
    )
    steps = points.sparkSession.range(S.SWEEP_STEPS + 1).select(F.col("id").cast("int").alias("step"))
    joined = F.broadcast(steps).join(by, F.col("confidence") >= F.col("step") / S.SWEEP_STEPS, "right").where("step is not null")
    counts = joined.groupBy("step").agg(F.sum("above").alias("n_above"), F.sum("auto").alias("n_auto"), F.sum("leaks").alias("n_leaks"), F.sum("critical").alias("n_critical_leaks"))
    every = steps.join(F.broadcast(_valued(points).limit(1).select(F.lit(1).alias("_any"))), F.lit(True)).drop("_any")
    return _sweep(points, every.join(counts, "step", "left").na.fill(0))


def threshold_sweep_suffix(points: DataFrame) -> DataFrame:
    """The same from a histogram of 21 steps and sums from above: one pass, whatever the number of confidences."""
    critical = F.col("severity") == "critical"
    step = F.least(F.floor(F.col("confidence") * S.SWEEP_STEPS + 1e-9), F.lit(S.SWEEP_STEPS)).cast("int")
    hist = _valued(points).withColumn("step", step).where("step >= 0").groupBy("step").agg(
        F.count(F.lit(1)).alias("above"),
        F.count_if(F.col("expectation") == S.MUST_EXTRACT).alias("auto"),
        F.count_if(_is_leak()).alias("leaks"),
        F.count_if(_is_leak() & critical).alias("critical"),
    )
    steps = points.sparkSession.range(S.SWEEP_STEPS + 1).select(F.col("id").cast("int").alias("step"))
    full = steps.join(hist, "step", "left").na.fill(0)  # 21 rows, so the window's one task is small
    w = Window.orderBy(F.desc("step"))
    sums = full.select("step", *(F.sum(c).over(w).alias(n) for c, n in (("above", "n_above"), ("auto", "n_auto"), ("leaks", "n_leaks"), ("critical", "n_critical_leaks"))))
    some = F.max("n_above").over(Window.partitionBy()) > 0
    return _sweep(points, sums.withColumn("_some", some).where("_some").drop("_some"))


def at_steps(sweep: DataFrame, *steps: int) -> DataFrame:
    """Rows of a sweep by whole step, not by a double."""
    return sweep.where(F.col("step").isin(*steps))


def review_gate(points: DataFrame, threshold: float) -> DataFrame:
    """One row: what passes the review gate; a missing confidence counts as 0 here."""
    p = scored(points)
    read, has = F.col("expectation") == S.MUST_EXTRACT, F.col("model").isNotNull()
    above = has & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    out = p.agg(
        F.count_if(read).alias("n_must_extract"),
        F.count_if(has).alias("n_with_value"),
        F.count_if(above & read).alias("n_auto"),
        F.count_if(read & ~has).alias("n_silent"),
        F.count_if(above & _is_leak()).alias("n_leaks"),
        F.count_if(above & _is_leak() & (F.col("severity") == "critical")).alias("n_critical_leaks"),
    )
    out = out.withColumn("n_review", F.col("n_must_extract") - F.col("n_auto"))
    out = out.withColumn("n_flagged", F.col("n_review") - F.col("n_silent"))
    return out.withColumn("auto_rate", F.try_divide("n_auto", "n_must_extract")).withColumn("threshold", F.lit(threshold))


def critical_leaks(points: DataFrame, threshold: float) -> DataFrame:
    above = F.col("model").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= threshold)
    rest = scored(points).where(above & _is_leak() & (F.col("severity") == "critical"))
    return rest.select("id", "field", "label", "model", "confidence", "error_type")


def boundary(points: DataFrame) -> DataFrame:
    """The upper middle of the distinct confidences, and how many points with a value a review flag at just that threshold marks.

    From counts by distinct confidence alone; those without one come first in the running sums, as they are flagged.
    """
    by = points.groupBy("confidence").agg(F.count_if(F.col("model").isNotNull()).alias("n"))
    sums = running(by, "confidence", place=F.col("confidence").isNotNull().cast("int"), upto=F.col("n"))
    at = sums.where(F.col("confidence").isNotNull() & (F.col("place") == F.floor(F.col("place_all") / 2) + 1))
    return at.where("upto_all > 0").select(F.col("confidence").alias("threshold"), (F.col("upto") - F.col("n")).alias("n_flagged"), F.col("upto_all").alias("n_points"))
