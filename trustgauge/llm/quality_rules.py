"""Quality rules with host-level verdicts, in DataFrame functions only.

Text rules are counted per document, failures are summed per host (the ``source``
column), each host's failure rate is shrunk with a beta prior fitted to all hosts by
the moments of the beta-binomial distribution, so that the noise of small hosts doesn't pass
for spread, and hosts whose shrunk rate is too high are rejected with all their documents.

Defined results: a null or empty text has no words, so it fails; a null host is no host
and its documents are judged by their own rules alone; no rows give no rows; repeated
rows are counted as often as they occur; other columns pass through untouched, and
columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free, join_sized, let, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1000.0)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice."""
    grams = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    ordered = F.sort_array(F.transform(grams, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("g"), i.alias("i"))))

    def same(a, b):
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    def starts(s):
        twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    return let(
        ordered,
        lambda s: F.aggregate(
            starts(s),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        ),
    )


def _counts(text: Column) -> Column:
    """Struct of n_words and n_repeat_words, what the base rules need."""
    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))


def measures(text: Column, counts: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": counts["n_words"],
        "word_chars": F.length(F.regexp_replace(full, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": counts["n_repeat_words"],
    }


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five measures and base_failed."""
    (own,) = free(docs, "_counts")  # a column of its own, so that it is evaluated once
    out = docs.withColumn(own, _counts(F.col(text))).withColumns(measures(F.col(text), F.col(own)))
    return out.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))).drop(own)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: its documents and how many of them failed."""
    return (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )


def host_verdicts(rates: DataFrame) -> DataFrame:
    """Shrunk rate of each host: (failed + mean * weight) / (docs + weight).

    Rates of hosts around the mean m vary by m (1 - m) (1 / n + (1 - 1 / n) / (weight + 1)), on average, which gives the weight.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    row = rates.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.avg(rate).alias("rate"), F.avg(rate * rate).alias("square"), F.avg(1 / F.col("n_docs")).alias("noise")
    ).first()
    mean, least, most = row["mean"] or 0.0, *PRIOR_WEIGHT
    weight = most
    if 0 < mean < 1 and row["noise"] < 1:
        spread = row["square"] - 2 * mean * row["rate"] + mean * mean
        share = (spread / (mean * (1 - mean)) - row["noise"]) / (1 - row["noise"])
        weight = min(most, max(least, 1 / share - 1)) if share > 0 else most
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return rates.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > HOST_RATE)


def judge(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Join the host verdicts back: adds host_rate and kept."""
    measured = measured.drop("host_rate", "kept")
    own, rejected = free(measured, "_host", "_rejected")
    v = verdicts.select(F.col("host").alias(own), "host_rate", F.col("host_rejected").alias(rejected))
    out = join_sized(measured, v, F.col(host) == F.col(own), "left", 64)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).drop(own, rejected)


def score(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, measures, base_failed, host_rate and kept of every document; the texts are read once."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(with_measures(docs.select(id_col, host, text), text).drop(text), "measures")
    verdicts = scratch.keep(host_verdicts(host_rates(measured, host)), "hosts")
    return judge(measured, verdicts, host).drop(host)


def keep(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that neither fail the rules nor come from a rejected host; same columns."""
    scratch = Scratch(docs.sparkSession)
    flag, own = free(docs, "_failed", "_host")
    counts = _counts(F.col(text))
    judged = scratch.keep(docs.withColumn(flag, let(counts, lambda c: failed(c["n_words"], c["n_repeat_words"]))), "judged")
    rates = host_rates(judged.select(F.col(host).alias("host"), F.col(flag).alias("base_failed")), "host")
    verdicts = scratch.keep(host_verdicts(scratch.keep(rates, "rates")), "hosts")
    rejected = scratch.keep(verdicts.where("host_rejected").select(F.col("host").alias(own)), "rejected")
    return join_sized(judged.where(~F.col(flag)).drop(flag), rejected, F.col(host) == F.col(own), "left_anti", 64)
