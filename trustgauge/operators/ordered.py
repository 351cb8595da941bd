"""Running sums in the order of a column, with no task that holds all rows of a group."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that the values are cut into at most, and how many different numbers the cuts are placed by.
RANGES, PICKED = 256, 8192


def order_number(df: DataFrame, by: str) -> Column:
    """A number that never falls where the column rises: itself, its time in microseconds, or the first eight bytes of a text."""
    kind = df.schema[by].dataType
    if isinstance(kind, T.NumericType):
        return F.col(by).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(by).cast("double")
    return F.conv(F.rpad(F.hex(F.col(by).cast("binary")), 16, "0"), 16, 10).cast("double")


def cuts(numbers: DataFrame, number: str) -> DataFrame:
    """One row with the numbers that cut the rows into ranges of about one size.

    They depend on the rows alone, not on how these are dealt or on which task ends first: a plan may work them out more than
    once, and a row must fall into the same range each time. All rows are counted by number; the numbers with the greatest
    ratios of rows to a hash between 0 and 1 are picked, each standing for its rows or for the least ratio if that is more.
    """
    counted = numbers.where(F.col(number).isNotNull()).groupBy(number).agg(F.count(F.lit(1)).alias("_n"))
    part = F.greatest(F.xxhash64(number) / F.lit(2.0**64) + F.lit(0.5), F.lit(1e-9))
    picked = counted.withColumn("_ratio", F.col("_n") / part).orderBy(F.desc("_ratio"), number).limit(PICKED)
    whole = Window.partitionBy()  # PICKED rows at most, here and below
    weighed = picked.withColumn("_n", F.greatest(F.col("_n"), F.min("_ratio").over(whole).cast("long")))
    upto = F.sum("_n").over(whole.orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = weighed.withColumn("_upto", upto).withColumn("_step", F.ceil(F.col("_upto") * RANGES / F.sum("_n").over(whole)))
    return placed.where(F.col("_step") < RANGES).groupBy("_step").agg(F.max(number).alias("_cut")).agg(F.collect_set("_cut").alias("_cuts"))


def running(df: DataFrame, by: str, within: tuple[str, ...] = (), keep: bool = True, **sums: Column) -> DataFrame:
    """df with, for each name, the sum over the rows up to this one in ascending order of ``by``, and as name_all that over all rows of its group.

    A window runs inside one range of one group; what the ranges before it add comes from a table of at most RANGES rows a group.
    Cuts and ranges are part of the plan, so nothing runs before the result is asked for. With ``keep`` df is held from the
    first use of its rows to the last (in memory, else on disk), so that it is evaluated once; leave it out for a plain scan.
    Nulls of ``by`` come first; rows with one value are in any order, as with row_number.
    """
    columns = df.columns
    df = df.withColumn("_number", order_number(df, by))
    df = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df
    at = F.broadcast(cuts(df, "_number"))  # one row
    range_of = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_number"))), F.lit(0))
    df = df.crossJoin(at).withColumn("_range", F.when(F.col("_number").isNull(), 0).otherwise(range_of)).drop("_cuts", "_number")
    group = F.struct(*within) if within else F.lit(0)
    cut = df.withColumns({"_group": group, **{f"_{n}": c for n, c in sums.items()}})
    ranges = cut.groupBy("_group", "_range").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    ranges = ranges.select(
        "_group", "_range", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums), *(F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums)
    )
    ranges = ranges if within else F.broadcast(ranges)  # RANGES rows at most
    inside = Window.partitionBy("_group", "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in sums}).join(ranges, ["_group", "_range"])
    return out.select(*columns, *((F.col(f"_{n}") + F.col(f"_{n}_before")).alias(n) for n in sums), *(f"{n}_all" for n in sums))
