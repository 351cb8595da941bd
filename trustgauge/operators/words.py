"""Word tables of recognised pages: lines, offsets, tails, anchors. Every window is inside one page or line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words below this confidence at the end of a line are noise of printed rules.
TAIL_CONFIDENCE = 40
#: A page with fewer words or a lower mean confidence is not read.
LEAST_WORDS, LEAST_CONFIDENCE = 8, 30
#: Share of dark pixels the best box must have, and its least lead.
LEAST_INK, LEAST_MARGIN = 0.16, 0.02


def usable(words: DataFrame) -> DataFrame:
    return words.where((F.trim("word") != "") & (F.col("conf") >= 0))


def page_stats(words: DataFrame) -> DataFrame:
    """Words, mean confidence and lines of each page."""
    return usable(words).groupBy("page").agg(F.count(F.lit(1)).alias("n_words"), F.avg("conf").alias("mean_conf"), F.count_distinct("line").alias("n_lines"))


def abstains(stats: DataFrame) -> DataFrame:
    return stats.withColumn("abstains", (F.col("n_words") < LEAST_WORDS) | (F.col("mean_conf") < LEAST_CONFIDENCE))


def lines(words: DataFrame) -> DataFrame:
    """Text of each line, words from left to right."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return usable(words).groupBy("page", "line").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("text"))


def with_next(line_table: DataFrame) -> DataFrame:
    return line_table.withColumn("next_text", F.lead("text").over(Window.partitionBy("page").orderBy("line")))


def offsets(words: DataFrame) -> DataFrame:
    """Place of each word's first character in its line's text."""
    w = Window.partitionBy("page", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return usable(words).withColumn("offset", F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0)).cast("long"))


def from_offset(placed: DataFrame, offset: Column | int) -> DataFrame:
    """Words that begin at an offset or one before it."""
    return placed.where(F.col("offset") >= offset - 1)


def trim_tail(words: DataFrame, least: float = TAIL_CONFIDENCE) -> DataFrame:
    """Lines without their low-confidence end; the first word always stays and the head is never cut."""
    w = Window.partitionBy("page", "line")
    u = usable(words)
    keep = F.greatest(F.coalesce(F.max(F.when(F.col("conf") >= least, F.col("pos"))).over(w), F.min("pos").over(w)), F.min("pos").over(w))
    return u.withColumn("_keep", keep).where(F.col("pos") <= F.col("_keep")).drop("_keep")


def look_after(line_table: DataFrame, anchor: Column, n_options: int) -> DataFrame:
    """The anchor's line and 2 * n_options after it, in pages that have the anchor; the first line that has it counts."""
    first = F.min(F.when(anchor, F.col("line"))).over(Window.partitionBy("page"))
    return line_table.withColumn("anchor_line", first).where((F.col("line") >= F.col("anchor_line")) & (F.col("line") < F.col("anchor_line") + 1 + 2 * n_options))


def top_margin(scores: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best row of each key and its lead over the next, 0 standing for none."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = scores.withColumn("place", F.row_number().over(w)).withColumn("runner_up", F.lead(score, 1, 0.0).over(w))
    return ranked.where("place = 1").select(key, tie, score, (F.col(score) - F.col("runner_up")).alias("margin"))


def ink_decision(best: DataFrame, score: str = "score") -> DataFrame:
    """Whether a box counts as ticked and with which confidence: capped, as counting ink is never certain."""
    fine = (F.col(score) >= LEAST_INK) & (F.col("margin") >= LEAST_MARGIN)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 0.55 + 3 * F.col("margin")))
    return best.withColumn("ticked", fine).withColumn("confidence", F.when(fine, conf))
