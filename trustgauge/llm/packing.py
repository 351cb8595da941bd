"""Packing into length buckets of least padding, and batches of a token budget inside each.

A document's length is its number of words, or a given column. A document longer than the token
budget is a bucket and a batch of its own, without padding. The global histogram of all other
lengths, at most one row for each length up to the budget, goes to the driver; dynamic programming
over it chooses the bucket boundaries for which all these documents, each padded to its bucket's
boundary, waste least. A bucket's documents are dealt by hash to groups of about ``GROUP`` rows
and numbered there, so no task gets a whole bucket, and budget // boundary of them make a batch.

Defined results: a null or empty text has length 0 and takes part, as does a row without id;
repeated rows are packed as often as they occur; of equal costs the lower boundary wins; no rows
give no rows; other columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words

#: Buckets at most, and tokens of a padded batch at most.
BUCKETS = 16
BUDGET = 16_384
#: Rows of a bucket that are numbered together, about.
GROUP = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least sum of counts * (end - length); lengths ascend."""
    n = len(lengths)
    if not n:
        return []
    size = lengths.astype(np.float64)
    rows = np.r_[0, np.cumsum(counts.astype(np.float64))]
    total = np.r_[0, np.cumsum(counts * size)]
    best = np.r_[0.0, np.full(n, np.inf)]  # of the first i lengths
    choices: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        fresh, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        fresh[0] = 0.0
        # the best cut moves right with i, so halves of a range search halves of the cuts
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            cut = np.arange(first, min(last, mid - 1) + 1)
            cost = best[cut] + size[mid - 1] * (rows[mid] - rows[cut]) - (total[mid] - total[cut])
            at = int(cost.argmin())
            fresh[mid], choice[mid] = cost[at], cut[at]
            todo += [(lo, mid - 1, first, cut[at]), (mid + 1, hi, cut[at], last)]
        best = fresh
        choices.append(choice)
    ends, at = [], n
    for choice in reversed(choices):
        if not at:
            break
        ends.append(int(lengths[at - 1]))
        at = int(choice[at])
    return ends[::-1]


def histogram(lengths: DataFrame, col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths up to ``most``, ascending, and how many rows have them."""
    hist = lengths.where(F.col(col) <= most).groupBy(F.col(col).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    got = hist.select(F.col("len").cast("long"), "n").toPandas().to_numpy(dtype=np.int64)
    got = got[got[:, 0].argsort()]
    return got[:, 0], got[:, 1]


def _of_length(value: dict[int, int], length: Column, ends: list[int], beyond: Column) -> Column:
    out = beyond
    for e in reversed(ends):
        out = F.when(length <= e, F.lit(value[e]).cast("long")).otherwise(out)
    return out


def with_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens, the number of words."""
    return docs.withColumn("n_tokens", F.size(words(F.col(text))).cast("long"))


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs with n_tokens, bucket_end, bucket_group, batch (its number in the group) and padding."""
    scratch = Scratch(docs.sparkSession)
    added = ("n_tokens", "bucket_end", "bucket_group", "batch", "padding")
    docs = docs.drop(*(c for c in added if c != length))
    docs = with_length(docs, text) if length is None else docs.withColumn("n_tokens", F.coalesce(F.col(length), F.lit(0)).cast("long"))
    sized = scratch.keep(docs, "sized")
    lens, counts = histogram(sized, "n_tokens", budget)
    ends = boundaries(lens, counts, buckets)
    rows = np.bincount(np.searchsorted(ends, lens), weights=counts, minlength=len(ends))
    groups = {e: max(1, -(-int(r) // GROUP)) for e, r in zip(ends, rows, strict=True)}
    beyond = max(1, -(-sized.where(F.col("n_tokens") > budget).count() // GROUP))
    size = {e: max(1, budget // max(e, 1)) for e in ends}
    n = F.col("n_tokens")
    out = sized.withColumn("bucket_end", _of_length({e: e for e in ends}, n, ends, n)).withColumn(
        "bucket_group", F.pmod(F.xxhash64(id_col, "n_tokens"), _of_length(groups, n, ends, F.lit(beyond).cast("long")))
    )
    w = Window.partitionBy("bucket_end", "bucket_group").orderBy("n_tokens", id_col)
    number = F.row_number().over(w) - 1
    return out.withColumn("batch", F.floor(number / _of_length(size, n, ends, F.lit(1).cast("long"))).cast("long")).withColumn("padding", F.col("bucket_end") - n)
