"""A store of runs: parts are only ever added, and a version counts from the moment its commit row is there.

A version's tables are written under a name of their own. Its commit, one row in one file, is written last; file
committers move a finished file into place in one step, so a reader sees a version whole or not at all, and a crash in
between leaves parts that no version names. Nothing is replaced, so older versions stay readable, also for queries that
began before a newer one was committed.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustgauge.sources import readers

COMMIT = "version long, run string, committed_at double, passed boolean, fingerprint string, tables array<string>"


class RunStore:
    """Runs under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, tables: dict[str, DataFrame], passed: bool = True, fingerprint: str | None = None) -> int:
        """Adds the tables as the next version and returns its number; passed: whether its gate was; fingerprint: of the data it was measured on."""
        run = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.mode("error").parquet(self._part(name, run))
        last = self.versions().agg(F.max("version")).first()[0]
        version = 1 + (last or 0)
        row = (version, run, time.time(), passed, fingerprint, sorted(tables))
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return version

    def _part(self, name: str, run: str) -> str:
        return f"{self.path}/tables/{name}/run={run}"

    def versions(self) -> DataFrame:
        """A row a committed version. Of two runs that were committed under one number at once the later one keeps it, then the larger name."""
        if not readers.exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMIT)
        rows = self.spark.read.schema(COMMIT).json(f"{self.path}/commits")
        latest = Window.partitionBy("version").orderBy(F.desc("committed_at"), F.desc("run"))
        return rows.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")

    def commit(self, version: int | None = None, passed_only: bool = False):
        """The commit row of a version, or of the last one, or of the last one that passed; None if there is none."""
        rows = self.versions()
        rows = rows.where(F.col("version") == version) if version is not None else rows
        rows = rows.where("passed") if passed_only else rows
        found = rows.orderBy(F.desc("version")).limit(1).collect()
        return found[0] if found else None

    def read(self, name: str, version: int | None = None, passed_only: bool = False) -> DataFrame:
        """A table of a version (the last if none is named)."""
        commit = self.commit(version, passed_only)
        if commit is None or name not in commit["tables"]:
            raise LookupError(f"no table {name!r} in {'any version' if commit is None else 'version ' + str(commit['version'])} of {self.path}")
        return self.spark.read.parquet(self._part(name, commit["run"]))

    def compare(self, fingerprint: str, version: int | None = None) -> str:
        """``no_baseline``, ``same`` or ``changed``: whether a version, or the last that passed, was measured on data of this fingerprint."""
        commit = self.commit(version, passed_only=version is None)
        if commit is None:
            return "no_baseline"
        return "same" if commit["fingerprint"] == fingerprint else "changed"
