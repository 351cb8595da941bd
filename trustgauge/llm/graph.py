"""Connected components of an edge table by contraction, in joins and minima only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): component is its least reachable id.

    Each round every vertex points to its least neighbour if that is smaller, pointers are
    followed twice, and the edges between what they lead to go on to the next round. Rounds are
    written to the shared folder, so a lost executor costs no earlier round; a table goes when no
    later one reads it. Edges of a vertex with itself, repeated edges and an empty table are plain
    cases; null ends are left out.
    """
    e = scratch.keep(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), f"{name}-edges"
    )
    labels = e.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    for k in count():
        if not e.take(1):
            if k:
                scratch.drop(f"{name}-edges{k - 1}")
            return labels
        up = (
            e.union(e.select("b", "a"))
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("b").alias("up"))
            .select("id", F.least("id", "up").alias("up"))
        )
        up = scratch.keep(up, f"{name}-up{k}")
        over = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
        top = scratch.keep(up.join(over, "up").select("id", "top"), f"{name}-top{k}")
        if k:
            fresh = labels.join(top.select(F.col("id").alias("component"), "top"), "component", "left")
            labels = scratch.keep(fresh.select("id", F.coalesce("top", "component").alias("component")), f"{name}-labels{k}")
        else:
            labels = top.withColumnRenamed("top", "component")
        a, b = top.select(F.col("id").alias("a"), F.col("top").alias("x")), top.select(F.col("id").alias("b"), F.col("top").alias("y"))
        rest = e.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = scratch.keep(rest, f"{name}-edges{k}")
        scratch.drop(f"{name}-up{k}", f"{name}-edges{k - 1}" if k else f"{name}-edges")
        if k:  # the first labels are the first top
            scratch.drop(f"{name}-top{k}", f"{name}-labels{k - 1}" if k > 1 else f"{name}-top0")
