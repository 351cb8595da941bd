"""Building label records from what was drawn and what a second reader read, and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions import match


def expectations(drawn: DataFrame, reads: DataFrame) -> DataFrame:
    """drawn (id, doc_type, tier, field, field_pos, value) with the expectation and label of each field.

    A record is unreadable if it was read again and no field was legible; then all its fields must be
    abstained from. A field that alone was illegible is grey; one not read again must be extracted.
    """
    r = reads.select("id", "field", F.lit(True).alias("was_read"), "legible", F.col("value").alias("second_read"))
    joined = drawn.join(r, ["id", "field"], "left").withColumn("was_read", F.coalesce("was_read", F.lit(False)))
    w = Window.partitionBy("id")
    sampled = F.bool_or("was_read").over(w)
    legible = F.bool_or(F.coalesce("legible", F.lit(False))).over(w)
    joined = joined.withColumn("sampled", sampled).withColumn("readable", ~(sampled & ~legible))
    kind = (
        F.when(~F.col("readable"), S.MUST_ABSTAIN)
        .when(~F.col("was_read"), S.MUST_EXTRACT)
        .when(F.col("legible"), S.MUST_EXTRACT)
        .otherwise(S.GREY)
    )
    return joined.withColumn("expectation", kind).withColumn("label", F.when(F.col("readable"), F.col("value")))


def unreadable_records(expected: DataFrame) -> DataFrame:
    return expected.where(~F.col("readable")).select("id").distinct()


def _second_reads(expected: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Legible, written second reads under the rules that judge the model."""
    compared = expected.where(F.col("legible") & (F.trim("second_read") != ""))
    rows = compared.select("id", "field", F.col("value").alias("label"), F.col("second_read").alias("model"), "kind", F.lit(False).alias("infra"))
    return match.with_verdict(rows, kinds, similarity=False)


def agreement(expected: DataFrame, kinds: tuple[str, ...] = tuple(match.RULES)) -> DataFrame:
    """How often a second read matches what was drawn."""
    n, right = F.count(F.lit(1)), F.count_if(match.is_correct())
    return _second_reads(expected, kinds).agg(n.alias("n_compared"), right.alias("n_match"), F.try_divide(right, n).alias("agreement"))


def disagreements(expected: DataFrame, kinds: tuple[str, ...] = tuple(match.RULES)) -> DataFrame:
    """(id, field, drawn, read) of second reads that don't match."""
    return _second_reads(expected, kinds).where(~match.is_correct()).select("id", "field", F.col("label").alias("drawn"), F.col("model").alias("read"))


def records(expected: DataFrame) -> DataFrame:
    """Label records again: one row each, its fields in order."""
    field = F.struct("field_pos", "field", "label", "expectation", "second_read")
    out = expected.groupBy("id", "doc_type", "tier", "readable", "sampled").agg(F.sort_array(F.collect_list(field)).alias("f"))
    return out.select("id", "doc_type", "tier", "readable", "sampled", F.transform("f", lambda x: x.dropFields("field_pos")).alias("fields"))


def plan_records(plan: DataFrame, truths: DataFrame, seed: int, step: int = 977) -> DataFrame:
    """A generation plan (plan_ord, doc_type, tier, n) as one row an item: running number, seed and the truth it draws in turn.

    The running number is a row's place in its cell plus the sizes of the cells before it, so no
    window runs over all items; the plan itself has a row a cell.
    """
    before = F.coalesce(F.sum("n").over(Window.orderBy("plan_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    items = plan.withColumn("before", before).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
    items = items.withColumn("number", (F.col("before") + F.col("k")).cast("long")).withColumn("seed", F.lit(seed) + F.col("number") * step)
    sizes = truths.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_truths"))
    items = items.join(sizes, "doc_type").withColumn("truth_ord", F.pmod(F.col("k") - 1, "n_truths"))
    return items.join(truths, ["doc_type", "truth_ord"]).select("number", "doc_type", "tier", "k", "seed", "truth_ord", "truth")
