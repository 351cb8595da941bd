"""Corpus pipeline: stages over documents, each one a corpus operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. ``n_chars`` follows a text that a stage shortens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge.llm import common, jaccard_join, line_dedup, packing, passage_dedup, quality_rules


def _like(out: DataFrame, docs: DataFrame, gone: str) -> DataFrame:
    """out with the columns of docs; a document of which nothing is left goes too."""
    out = out.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or come from a rejected host go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go."""
    return _like(line_dedup.dedup(docs), docs, "n_deleted")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return jaccard_join.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-equal passages of 50 words or more go."""
    return _like(passage_dedup.remove_passages(docs), docs, "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("passage_dedup", passages),
    ("packing", pack),
]

#: Similarity joins, min-hash passages and optimal buckets are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is a table before the next one begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = common.Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(lambda d=docs, s=stage: s(spark, d, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
