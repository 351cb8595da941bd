"""Scores and breakdowns of check points; each is one aggregation, partial before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions.match import is_correct
from trustgauge.operators.ordered import running
from trustgauge.operators.points import population, scored


def _n(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def ratio(cond: Column, among: Column) -> Column:
    """Share of rows that hold; null where there are none."""
    return F.try_divide(F.count_if(cond & among), F.count_if(among))


def weighted(among: Column) -> Column:
    w = F.col("weight")
    return F.try_divide(F.coalesce(F.sum(F.when(among & is_correct(), w)), F.lit(0.0)), F.sum(F.when(among, w)))


def _verdict_counts() -> list[Column]:
    names = {"n_correct": S.CORRECT, "n_wrong": S.WRONG, "n_missed": S.MISSED, "n_abstain_ok": S.ABSTAIN_OK, "n_fabricated": S.FABRICATED}
    return [_n(F.col("verdict") == v).alias(n) for n, v in names.items()]


def verdict_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_points"))


def population_split(points: DataFrame) -> DataFrame:
    return population(points).groupBy("population").agg(F.count(F.lit(1)).alias("n_points"))


def headline(points: DataFrame, *keys: str) -> DataFrame:
    """All headline figures in one pass, in a row for each value of the keys; without keys in one row."""
    return population(points).groupBy(*keys).agg(*headline_columns())


#: Names of the headline figures, in their order.
HEADLINE = (
    "n_records", "n_scored", "n_grey", "n_infra", "trust_score", "accuracy_readable", "weighted_accuracy_readable", "miss_rate", "wrong_rate", "abstain_ok_rate", "fabricated_rate", "n_fabricated",
    "critical_accuracy",
)


def headline_columns() -> list[Column]:
    """The headline figures as aggregates over points with a population."""
    read, unread = F.col("population") == "readable", F.col("population") == "unreadable"
    is_ = lambda v: F.col("verdict") == v
    return [
        F.count_distinct("id").alias("n_records"),
        _n(read | unread).alias("n_scored"),
        _n(F.col("population") == "grey").alias("n_grey"),
        _n(F.col("population") == "infra").alias("n_infra"),
        weighted(read | unread).alias("trust_score"),
        ratio(is_(S.CORRECT), read).alias("accuracy_readable"),
        weighted(read).alias("weighted_accuracy_readable"),
        ratio(is_(S.MISSED), read).alias("miss_rate"),
        ratio(is_(S.WRONG), read).alias("wrong_rate"),
        ratio(is_(S.ABSTAIN_OK), unread).alias("abstain_ok_rate"),
        ratio(is_(S.FABRICATED), unread).alias("fabricated_rate"),
        _n(unread & is_(S.FABRICATED)).alias("n_fabricated"),
        ratio(is_(S.CORRECT), read & (F.col("severity") == "critical")).alias("critical_accuracy"),
    ]


def silent_kinds(points: DataFrame) -> DataFrame:
    """Records in which the model returned nothing, by the three reasons; over all points, grey too."""
    return points.agg(
        F.count_distinct(F.when(F.col("abstain_reason").isNotNull(), F.col("id"))).alias("n_policy_abstain"),
        F.count_distinct(F.when(F.col("no_anchor"), F.col("id"))).alias("n_no_anchor"),
        F.count_distinct(F.when(F.col("verdict") == S.SYSTEM_ERROR, F.col("id"))).alias("n_infra"),
    )


def score_by(points: DataFrame, *keys: str) -> DataFrame:
    """Verdict counts and weighted score by keys; groups without a point are left out."""
    return scored(points).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *_verdict_counts(), weighted(F.lit(True)).alias("trust_score"))


def by_field(points: DataFrame) -> DataFrame:
    """Counts, accuracy and mean confidence of each field, to be shown worst first with fields never readable in front."""
    read = F.col("expectation") == S.MUST_EXTRACT
    return (
        scored(points)
        .groupBy("doc_type", "field")
        .agg(
            F.min("severity").alias("severity"),
            F.count(F.lit(1)).alias("n_points"),
            _n(read).alias("n_readable"),
            *_verdict_counts(),
            F.try_divide(F.count_if(F.col("verdict") == S.CORRECT), F.count_if(read)).alias("accuracy_readable"),
            F.avg("confidence").alias("mean_confidence"),
        )
    )


def worst_first(fields: DataFrame) -> DataFrame:
    return fields.orderBy(F.col("accuracy_readable").asc_nulls_first(), "doc_type", "field")


def _errors(points: DataFrame) -> DataFrame:
    return scored(points).where((F.col("expectation") == S.MUST_EXTRACT) & F.col("verdict").isin(S.WRONG, S.MISSED) & F.col("error_type").isNotNull())


def error_histogram(points: DataFrame, *keys: str) -> DataFrame:
    return _errors(points).groupBy(*keys, "error_type").agg(F.count(F.lit(1)).alias("n_points"))


def error_map(points: DataFrame) -> DataFrame:
    """The error histogram of each field as a map, for reports; as many entries as there are error types."""
    h = error_histogram(points, "doc_type", "field")
    return h.groupBy("doc_type", "field").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n_points")))).alias("errors"))


def top_errors(points: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent error types of each field; ties by name."""
    w = Window.partitionBy("doc_type", "field").orderBy(F.desc("n_points"), "error_type")
    return error_histogram(points, "doc_type", "field").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def timing(df: DataFrame, key: str, value: str = "elapsed_ms") -> DataFrame:
    """n, upper median, least, most and sum of a value by key and over all (key null), both from one pass.

    The upper median is the value at place n div 2 of the ascending order, without interpolation.
    It is found from the counts of distinct values in ranges, so no task or list holds a group's values.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).alias("v"))
    counted = rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select("key", F.lit(0).alias("overall"), "v", "n").unionByName(
        counted.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("key"), F.lit(1).alias("overall"), "v", "n")
    )
    ranked = running(both, "v", ("key", "overall"), upto=F.col("n"))
    middle = F.floor(F.col("upto_all") / 2)
    return ranked.groupBy("key", "overall").agg(
        F.max("upto_all").alias("n"),
        F.min(F.when(F.col("upto") > middle, F.col("v"))).alias("upper_median"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.sum(F.col("v") * F.col("n")).alias("total"),
    )


def run_stability(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean, population deviation (0 for one run), least and most of each metric over runs; metrics that are always null are left out."""
    long = runs.select("run", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m"))
    return (
        long.select("run", "m.metric", "m.v")
        .where("v is not null")
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"), F.min("v").alias("least"), F.max("v").alias("most"))
    )


def confidence_spread(points: DataFrame) -> DataFrame:
    """Deviation of the confidences of each field: a constant one says nothing."""
    return points.where("confidence is not null").groupBy("doc_type", "field").agg(F.count(F.lit(1)).alias("n_points"), F.stddev_pop("confidence").alias("sigma"))
