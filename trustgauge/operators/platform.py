"""A platform under test: records are opened, processed and checked through one small contract."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions import match
from trustgauge.operators import connector, review
from trustgauge.operators import points as P
from trustgauge.operators.extraction import Extractor


class Platform(Protocol):
    """What scenarios need of any platform, be it a page, a screen or an extraction run."""

    def open(self, records: DataFrame) -> Platform: ...

    def process(self) -> DataFrame: ...

    def self_test(self, spark: SparkSession) -> tuple[bool, str]: ...


def doc_type_of_id(id_col: str = "id"):
    """Document type by the prefix of an identifier."""
    out = F.lit(S.OTHER_TYPE)
    for prefix, doc_type in S.ID_PREFIXES.items():
        out = F.when(F.startswith(F.col(id_col), F.lit(prefix)), doc_type).otherwise(out)
    return out


class Dossiers:
    """Dossiers read by an extractor. The extraction is costly and doesn't depend on the threshold, so it is kept; flags and status are made anew."""

    def __init__(self, extractor: Extractor, dimension: DataFrame, threshold: float):
        self.extractor, self.dimension, self.threshold = extractor, dimension, threshold
        self.records: DataFrame | None = None
        self.extracted: DataFrame | None = None

    def open(self, records: DataFrame) -> Dossiers:
        """records (id and what the extractor reads); a record without doc_type has that of its id."""
        self.close()
        kind = F.coalesce("doc_type", doc_type_of_id()) if "doc_type" in records.columns else doc_type_of_id()
        self.records = records.withColumn("doc_type", kind)
        return self

    def process(self, threshold: float | None = None) -> DataFrame:
        """The evidence ledger at a threshold, the configured one if none is given."""
        if self.records is None:
            raise RuntimeError("no dossiers are open")
        if self.extracted is None:
            self.extracted = self.extractor.extract(self.records).persist()
        return review.evidence_ledger(self.records.select("id", "doc_type"), self.extracted, self.dimension, self.threshold if threshold is None else threshold)

    def self_test(self, spark: SparkSession) -> tuple[bool, str]:
        return self.extractor.self_test(spark)

    def close(self) -> None:
        if self.extracted is not None:
            self.extracted.unpersist()
        self.records = self.extracted = None


@dataclass(frozen=True)
class Measurement:
    """What came of a run: without its canary there are no points, so there is no score to be mistaken for a poor one."""

    canary_ok: bool
    canary: str
    results: DataFrame | None = None
    points: DataFrame | None = None


def measure(
    spark: SparkSession, extractor: Extractor, labels: DataFrame, records: DataFrame, dimension: DataFrame, n_runs: int = 1, kinds: tuple[str, ...] = tuple(match.RULES), store=None
) -> Measurement:
    """The canary first, then all runs in one pass over the records, then check points with ``run``.

    Readings are costly and take another time whenever they are made again, so with a ``store`` (sources.runs.RunStore) they
    are written as a version of it and all that follows reads that.
    """
    fine, said = extractor.self_test(spark)
    if not fine:
        return Measurement(False, said)
    results = connector.of_runs(extractor.extract(connector.repeated(records, n_runs)))
    if store is not None:
        results = store.read("results", store.write({"results": results}, passed=False))
    points = P.check_points_of_runs(labels, results, dimension, n_runs, kinds)
    return Measurement(True, said, results, points)
