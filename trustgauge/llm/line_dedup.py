"""Line dedup: suffix order of the line-ID sequences by distributed prefix doubling.

A text is a sequence of lines that have a word; a line's ID is its hash. A position's name stands for
the ``h`` lines from it on. First names, of ``MIN_LINES`` lines, are made inside the text's row. A round
doubles ``h``: a position's new name comes from its own and that of the position ``h`` lines further in
its text, so positions of one name are suffixes that share ``h`` lines, an interval of common prefixes.
Positions whose name occurs once share no more than they did in the round before and leave; rounds go on
until none is left. So every position gets the deepest of its intervals in which it isn't the first
(smaller document id, then earlier line): the length of what it repeats, at least.

The lines of these lengths are deleted; what touches or overlaps merges, so whole maximal runs go
and the first copy of each stays. Names are 128 bits of two hashes, so wrong equalities are out of reach;
texts are told apart by their id and a hash.

Defined results: a null or empty text has no lines and stays as it is; lines without a word
count for nothing and stay, but for those between two lines of one deleted run; a row without id stays
whole and is no copy's origin; rows of one id are told apart by their text, and rows equal in both are
one text, so none is a later copy of the other; no rows give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, free

#: Lines of the shortest run whose later copies go.
MIN_LINES = 3
#: A line with a word, as Python's re sees one; same class as SPACE.
_BLANK = " \t\n\x0b\x0c\r"
#: A text, a position's name, and what orders positions.
_TEXT, _NAME, _PLACE = ("id", "h"), ("x", "y"), ("id", "h", "at")


def later_runs(texts: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, h, at, n): the ``n`` lines from ``at`` on, numbered from 0 among a text's lines with a word, also start at an earlier place.

    texts is (id, h, text), each once; n is ``min_lines`` times a power of two, the largest for which it holds.
    """
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    both = F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("l"), F.xxhash64(F.lit(1), x).alias("m")))
    lines = scratch.keep(texts.select(*_TEXT, both.alias("lines")), "lines").where(F.size("lines") >= min_lines)
    starts = F.sequence(F.lit(0), F.size("lines") - min_lines)

    def first_name(i, part: str):
        return F.xxhash64(*(F.get("lines", i + k)[part] for k in range(min_lines)))

    named = F.transform(starts, lambda i: F.struct(i.alias("at"), first_name(i, "l").alias("x"), first_name(i, "m").alias("y")))
    names = lines.select(*_TEXT, F.inline(named))
    h, found = min_lines, None
    while True:  # a round is one job and one table: both uses of names share their shuffle
        twice = names.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1").drop("n")
        shared = scratch.keep(names.join(twice.hint("merge"), list(_NAME)), f"shared{h}")
        if not shared.take(1):
            break
        later = shared.where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE, F.lit(h).alias("n"))
        found = later if found is None else found.unionByName(later)
        w = Window.partitionBy(*_TEXT).orderBy("at").rangeBetween(h, h)
        ahead = shared.select(*_PLACE, *_NAME, F.max(F.struct(*_NAME)).over(w).alias("next")).where("next is not null")
        names = ahead.select(*_PLACE, F.xxhash64("x", "next.x").alias("x"), F.xxhash64("y", "next.y").alias("y"))
        h *= 2
    if found is None:
        return names.select(*_PLACE, F.lit(h).alias("n")).limit(0)
    return found.groupBy(*_PLACE).agg(F.max("n").alias("n"))


def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    def one(text: str, starts) -> tuple[str, int]:
        gone: set[int] = set()
        for s in starts:
            gone.update(range(s["at"], s["at"] + s["n"]))
        out, blank, at, last = [], [], 0, False
        for line in text.split("\n"):
            if not line.strip(_BLANK):
                blank.append(line)
                continue
            this = at in gone
            if not (this and last):
                out += blank
            if not this:
                out.append(line)
            blank, last, at = [], this, at + 1
        return "\n".join(out + blank), len(gone)

    return pd.DataFrame([(None, 0) if s is None else one(t, s) for t, s in zip(texts, runs, strict=True)], columns=["kept", "n"])


def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, runs in batches:
        yield _cut(texts, runs)


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_lines: int = MIN_LINES) -> DataFrame:
    """docs without the lines of later copies, and n_deleted, how many lines with a word went; a column of that name is replaced."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_deleted")
    own_h, own_id, own_runs, own_cut = free(docs, "_h", "_id", "_runs", "_short")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    many = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if many.take(1):  # rows equal in id and text are one
        texts = texts.dropDuplicates(["id", "h"])
    runs = later_runs(texts, scratch, min_lines).groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    gone = scratch.last(runs.select(F.col("id").alias(own_id), F.col("h").alias(own_h), F.col("runs").alias(own_runs)), "gone")
    on = (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text) == F.col(own_h))
    out = docs.join(gone.hint("merge"), on, "left")  # as for large tables, where what goes is too much to broadcast
    some = F.col(own_runs).isNotNull()
    without = F.pandas_udf(_without, "kept string, n long")
    out = out.withColumn(own_cut, without(F.when(some, F.col(text)), F.col(own_runs)))
    kept = F.coalesce(F.col(own_cut)["kept"], F.col(text))
    return out.withColumns({"n_deleted": F.coalesce(F.col(own_cut)["n"], F.lit(0)).cast("long"), text: kept}).select(*docs.columns, "n_deleted")
