"""The regression gate: invariants, absolute limits, tolerance against a snapshot, flips of single points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators.metrics import HEADLINE, headline_columns
from trustgauge.operators.points import key, population

#: Watched metrics and whether more of them is better.
WATCHED = {"trust_score": True, "accuracy_readable": True, "critical_accuracy": True, "abstain_ok_rate": True, "fabricated_rate": False}
#: Limits of the absolute gates, the least drop that counts, and how many deviations of repeated runs do.
LIMITS = {"trust_score_least": 0.55, "critical_accuracy_least": 0.60, "fabricated_rate_most": 0.0, "critical_leaks_most": 2, "tolerance": 0.05}
SIGMAS = 3
#: Rows or hashes of a fingerprint that are hashed together.
BLOCK = 4096


def metric_rows(headline: DataFrame, metrics: tuple[str, ...] = tuple(WATCHED), keep: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value) from a headline row, with columns to keep in front."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return headline.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.metric", "p.value")


def gate_rows(headline: DataFrame, critical_leaks: Column | int, canary_ok: bool = True, limits: dict = LIMITS) -> DataFrame:
    """(tier, metric, value, limit, ok) of invariants and absolute gates; a null metric counts as 0. Without a score nothing passes."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    leaks = critical_leaks if isinstance(critical_leaks, Column) else F.lit(critical_leaks)

    def row(tier: str, metric: str, v: Column, limit: float, ok: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(metric).alias("metric"), v.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), ok.alias("ok"))

    rows = [
        row("invariant", "canary", F.lit(float(canary_ok)), 1, F.lit(bool(canary_ok))),
        row("invariant", "fabricated_rate", value("fabricated_rate"), limits["fabricated_rate_most"], value("fabricated_rate") <= limits["fabricated_rate_most"]),
        row("invariant", "n_infra", value("n_infra"), 0, value("n_infra") <= 0),
        row("absolute", "trust_score", value("trust_score"), limits["trust_score_least"], value("trust_score") >= limits["trust_score_least"]),
        row("absolute", "critical_accuracy", value("critical_accuracy"), limits["critical_accuracy_least"], value("critical_accuracy") >= limits["critical_accuracy_least"]),
        row("absolute", "critical_leaks", leaks, limits["critical_leaks_most"], leaks <= limits["critical_leaks_most"]),
    ]
    return headline.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def tolerance(now: DataFrame, before: DataFrame, sigma: DataFrame | None = None, least: float = LIMITS["tolerance"]) -> DataFrame:
    """Direction-aware change of each metric and whether it is a drop beyond the larger of 3 deviations and ``least``; nulls on either side are skipped."""
    joined = now.where("value is not null").join(before.where("value is not null").select("metric", F.col("value").alias("baseline")), "metric")
    joined = joined.join(sigma.select("metric", "sigma"), "metric", "left") if sigma is not None else joined.withColumn("sigma", F.lit(0.0))
    return _allowed(joined, least)


def tolerance_of_runs(runs: DataFrame, now: int, before: int, least: float = LIMITS["tolerance"]) -> DataFrame:
    """The same from a table of headlines by run: both runs and the deviation over all of them in one aggregation."""
    long = metric_rows(runs, keep=("run",)).where("value is not null")
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))  # noqa: E731  (a headline is one row)
    both = long.groupBy("metric").agg(of(now).alias("value"), of(before).alias("baseline"), F.stddev_pop("value").alias("sigma"))
    return _allowed(both.where("value is not null and baseline is not null"), least)


def _allowed(joined: DataFrame, least: float) -> DataFrame:
    down = [m for m, up in WATCHED.items() if not up]
    delta = F.when(F.col("metric").isin(*down), F.col("baseline") - F.col("value")).otherwise(F.col("value") - F.col("baseline"))
    allowed = F.greatest(SIGMAS * F.coalesce("sigma", F.lit(0.0)), F.lit(least))
    out = joined.withColumn("delta", delta).withColumn("allowed", allowed)
    return out.withColumn("over", F.col("delta") < -F.col("allowed")).select("metric", "baseline", "value", "delta", "sigma", "allowed", "over")


def flips(now: DataFrame, before: DataFrame) -> DataFrame:
    """Points (key, verdict) that went from right to wrong or back; keys of one side only are ignored."""
    joined = before.select("key", F.col("verdict").alias("was")).join(now.select("key", F.col("verdict").alias("is_now")), "key")
    return joined.withColumn("change", _change(F.col("was"), F.col("is_now"))).where("change is not null")


def _good(verdict: Column) -> Column:
    return verdict.isin(*S.GOOD)


def _change(was: Column, is_now: Column) -> Column:
    return F.when(_good(was) & ~_good(is_now), "worse").when(~_good(was) & _good(is_now), "better")


def flips_of_runs(points: DataFrame, now: int, before: int) -> DataFrame:
    """The flips between two runs of a fact table with ``run``: one pivot of the key, no join."""
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("verdict")))  # noqa: E731  (a key is one point a run)
    both = points.where(F.col("run").isin(now, before)).groupBy("id", "field").agg(of(before).alias("was"), of(now).alias("is_now"))
    changed = both.withColumn("change", _change(F.col("was"), F.col("is_now"))).where("change is not null")
    return changed.select(key().alias("key"), "was", "is_now", "change")


def trend_of_runs(points: DataFrame, now: int, before: int, least: float = LIMITS["tolerance"]) -> DataFrame:
    """The trend between two runs, with deviations over all runs of the fact table, in one reading of it.

    Each point of ``now`` takes the verdict that its key had before beside it; one aggregation by run then gives
    headlines and flips, and what is left is a row a run.
    """
    was = F.max(F.when(F.col("run") == before, F.col("verdict"))).over(Window.partitionBy("id", "field"))
    beside = population(points.select("run", "id", "field", "verdict", "expectation", "severity", "weight")).withColumn("was", was)
    change = F.when(F.col("run") == now, _change(F.col("was"), F.col("verdict")))
    watched = [c for c, name in zip(headline_columns(), HEADLINE, strict=True) if name in WATCHED]
    by_run = beside.groupBy("run").agg(*watched, F.count_if(change == "worse").alias("n_worse"), F.count_if(change == "better").alias("n_better"))

    def row(metric: str, up: bool) -> Column:
        value, of = F.col(metric).cast("double"), lambda run: F.max(F.when(F.col("run") == run, F.col(metric)))
        delta = (of(now) - of(before)) * (1 if up else -1)
        return F.struct(delta.alias("delta"), F.greatest(SIGMAS * F.coalesce(F.stddev_pop(value), F.lit(0.0)), F.lit(least)).alias("allowed"))

    one = by_run.agg(F.array(*(row(m, up) for m, up in WATCHED.items())).alias("m"), F.coalesce(F.sum("n_worse"), F.lit(0)).alias("n_worse"), F.coalesce(F.sum("n_better"), F.lit(0)).alias("n_better"))
    some = lambda test: F.exists("m", lambda x: F.coalesce(test(x), F.lit(False)))
    flags = (some(lambda x: x["delta"] < -x["allowed"]), some(lambda x: x["delta"] > 1e-9), some(lambda x: x["delta"] < -1e-9))
    return one.select(_said(*flags).alias("trend"), "n_worse", "n_better")


def _said(over: Column, up: Column, down: Column) -> Column:
    return (
        F.when(over | ((F.col("n_worse") > 0) & (F.col("n_better") == 0)), "WORSE")
        .when(up & ~down & (F.col("n_worse") == 0), "BETTER")
        .otherwise("SAME")
    )


def trend(tolerances: DataFrame, changes: DataFrame) -> DataFrame:
    """WORSE, BETTER or SAME, in one row."""
    t = tolerances.agg(
        F.coalesce(F.bool_or("over"), F.lit(False)).alias("over"),
        F.coalesce(F.bool_or(F.col("delta") > 1e-9), F.lit(False)).alias("up"),
        F.coalesce(F.bool_or(F.col("delta") < -1e-9), F.lit(False)).alias("down"),
    )
    c = changes.agg(F.count_if(F.col("change") == "worse").alias("n_worse"), F.count_if(F.col("change") == "better").alias("n_better"))
    return t.crossJoin(c).select(_said(F.col("over"), F.col("up"), F.col("down")).alias("trend"), "n_worse", "n_better")  # one row each


def fingerprint(records: DataFrame) -> DataFrame:
    """First 16 hex digits of a SHA-256 that changes with any label, expectation, field or record.

    ``records`` is (ord, text), the text of each record or field in a fixed order. Hashes of blocks of
    rows are hashed in blocks again, so no task gets more than a block, and the last one a hash for 16.8 million places.
    """
    level = records.select("ord", "text")
    for _ in range(2):
        rows = F.sort_array(F.collect_list(F.struct("ord", "text")))
        blocks = level.groupBy(F.expr(f"ord div {BLOCK}").alias("block")).agg(rows.alias("rows"))
        level = blocks.select(F.col("block").alias("ord"), F.sha2(F.array_join(F.transform("rows", lambda r: r["text"]), ""), 256).alias("text"))
    top = level.agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("rows"))
    return top.select(F.substring(F.sha2(F.array_join(F.transform("rows", lambda r: r["text"]), ""), 256), 1, 16).alias("fingerprint"))


def hash_tree(records: DataFrame, levels: int = 3) -> DataFrame:
    """(level, node, hash) of a tree over (ord, text): level 0 has a hash a record, and a node of each next level one of up to BLOCK nodes below it.

    Written once a version, with level as a folder, so that a comparison reads only what differs; no task gets more than a block.
    """
    rows = F.sort_array(F.collect_list("text"))  # texts of one place, in their own order
    level = records.groupBy(F.col("ord").cast("long").alias("node")).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("hash"))
    out = level.select(F.lit(0).alias("level"), "node", "hash")
    for k in range(1, levels):
        below = F.sort_array(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy(F.expr(f"floor(node / {BLOCK})").alias("up")).agg(F.sha2(F.array_join(F.transform(below, lambda r: F.concat_ws(":", r["node"], r["hash"])), ","), 256).alias("hash"))
        level = level.withColumnRenamed("up", "node")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "node", "hash"))
    return out


def tree_changes(now: DataFrame, before: DataFrame, levels: int = 3) -> DataFrame:
    """(ord, change) between two trees: added, removed or changed records, found from the top down among the nodes below those that differ.

    A level joins only children of the changed nodes above it, so equal versions cost the comparison of their top.
    """
    changed = None
    for k in reversed(range(levels)):
        sides = []
        for tree in (now, before):
            nodes = tree.where(F.col("level") == k).select("node", "hash")
            if changed is not None:
                nodes = nodes.withColumn("_up", F.expr(f"floor(node / {BLOCK})")).join(changed.select(F.col("node").alias("_up")), "_up", "left_semi").drop("_up")
            sides.append(nodes)
        both = sides[0].withColumnRenamed("hash", "_now").join(sides[1].withColumnRenamed("hash", "_before"), "node", "full_outer")
        changed = both.where(~F.col("_now").eqNullSafe(F.col("_before")))
    kind = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("changed")
    return changed.select(F.col("node").alias("ord"), kind.alias("change"))


def compare_fingerprints(now: DataFrame, before: str | None) -> str:
    """``no_baseline`` (absolute gates only), ``same`` or ``changed`` (a hard failure: no comparison means anything)."""
    if before is None:
        return "no_baseline"
    return "same" if now.first()["fingerprint"] == before else "changed"


#: Failure codes, first that fits: (code, condition).
def failure_code(name_fields: tuple[str, ...], choice_fields: tuple[str, ...]) -> Column:
    field, error, tier = F.col("field"), F.col("error_type"), F.col("tier")
    return (
        F.when(field.isin(*name_fields) & error.isin("diacritics", "some_characters", "part_missing_or_added", "all_wrong"), "F-01")
        .when(field.isin(*choice_fields) & (error == "wrong_option"), "F-02")
        .when(error.isin("wrong_value", "one_digit", "wrong_digit_count", "not_a_number"), "F-05")
        .when((error == "silent_on_readable") & tier.isin("medium", "heavy"), "F-03")
        .when(error == "silent_on_readable", "F-06")
        .when(error.isin("beyond_threshold", "not_a_date", "wrong_date"), "F-03")
        .otherwise("UNCLASSIFIED")
    )


def xfail_states(points: DataFrame, known: DataFrame) -> DataFrame:
    """(key, state) of every point: known failures must fail and all others pass; grey ones are skipped."""
    marked = points.join(known.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
    ok, is_known = F.col("verdict").isin(*S.GOOD), F.coalesce("known", F.lit(False))
    state = (
        F.when(F.col("expectation") == S.GREY, "skipped")
        .when(is_known & ~ok, "expected_failure")
        .when(is_known, "unexpected_pass")
        .when(ok, "pass")
        .otherwise("new_failure")
    )
    return marked.select("key", state.alias("state"))


def mutation_outcomes(points: DataFrame, truth: Column, mutants: dict[str, Column], explained: tuple[str, ...] = ()) -> DataFrame:
    """(mutant, n_changed, killed, explained): altered rules judged beside the true one in a single reading of the points.

    A mutant is killed if it changes the outcome of any point; ``explained`` are those that can't on such data.
    """
    counts = points.agg(*(F.count_if(~truth.eqNullSafe(c)).alias(f"_{i}") for i, c in enumerate(mutants.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("mutant"), F.col(f"_{i}").alias("n_changed")) for i, n in enumerate(mutants)))
    out = counts.select(F.explode(rows).alias("m")).select("m.mutant", "m.n_changed")
    return out.withColumn("killed", F.col("n_changed") > 0).withColumn("explained", F.col("mutant").isin(*explained) if explained else F.lit(False))


def mutation_summary(mutants: DataFrame) -> DataFrame:
    """Counts of (killed, explained) rows: killed, survivors with an explanation, gaps."""
    return mutants.agg(
        F.count_if("killed").alias("n_killed"),
        F.count_if(~F.col("killed") & F.col("explained")).alias("n_explained"),
        F.count_if(~F.col("killed") & ~F.col("explained")).alias("n_gaps"),
    )
