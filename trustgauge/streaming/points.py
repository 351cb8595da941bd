"""Verdicts over a stream of joined points, and counts kept up to date by foreachBatch.

An extension: flags and verdicts are row-local, so they run on a stream as they are; counts by
verdict are additive, so each micro-batch adds its own. A batch that is run again writes the same
folder again, so totals don't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustgauge.functions import match


def verdicts(stream: DataFrame, kinds: tuple[str, ...], similarity: bool = False) -> DataFrame:
    """stream (label, model, kind, infra, ...) with verdict, error_type and similarity."""
    return match.with_verdict(stream, kinds, similarity)


def count_batches(path: str):
    """A foreachBatch function that writes the verdict counts of each batch under its number."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("doc_type", "field", "verdict").agg(F.count(F.lit(1)).alias("n_points"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("doc_type", "field", "verdict").agg(F.sum("n_points").alias("n_points"))
