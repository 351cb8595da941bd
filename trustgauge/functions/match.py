"""Matching rules by field type and the verdict of a check point.

A rule takes normalised-on-entry label and model texts (NFC) and returns a struct of verdict,
error_type and similarity. Similarity is difflib's ratio with the label first, which is not
symmetric; it needs Python, gets nulls for rows that don't want it, and can be left out.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustgauge import schemas as S
from trustgauge.functions import normalize as N

#: Addresses match from this similarity on; from the second they are near.
ADDRESS_MATCH, ADDRESS_NEAR = 0.90, 0.6
NAME_NEAR = 0.7


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length of Ratcliff and Obershelp; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


similarity_ratio = F.pandas_udf(_ratio, T.DoubleType())
#: So declared that its column stays one of its own, whatever is made of it.
_ratio_once = F.pandas_udf(_ratio, T.DoubleType()).asNondeterministic()

#: Longest common prefix that is looked for, and the length of the second text from which difflib leaves frequent characters out.
LONGEST_PREFIX, JUNK_FROM = 1024, 200


def common_characters(a: Column, b: Column) -> Column:
    """How many characters two texts share, each as often as both have it: no matching can have more."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    every = lambda t: F.aggregate(F.array_distinct(F.split(t["a"], "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(t["a"], c), count(t["b"], c))))
    return N.bind(F.struct(a.alias("a"), b.alias("b")), every)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, up to about LONGEST_PREFIX, by halving."""

    def further(step: int) -> Callable[[Column], Column]:
        def one(t: Column) -> Column:
            to = t["p"] + step
            fits = (to <= F.least(F.length(t["a"]), F.length(t["b"]))) & (F.left(t["a"], to) == F.left(t["b"], to))
            return F.struct(t["a"].alias("a"), t["b"].alias("b"), F.when(fits, to).otherwise(t["p"]).alias("p"))

        return one

    state = F.struct(a.alias("a"), b.alias("b"), F.lit(0).alias("p"))
    step = LONGEST_PREFIX // 2
    while step:
        state = N.bind(state, further(step))
        step //= 2
    return state["p"]


def ratio_bounds(a: Column, b: Column) -> Column:
    """Struct of lower and upper, between which ``similarity_ratio`` lies; equal ones are its value. Null if either text is.

    Above: characters in common. Below: the longest common block is matched first and is at least the common prefix or suffix
    (of a second text of JUNK_FROM characters or more difflib may leave the block out, so nothing is known from below).
    """

    def bounds(t: Column) -> Column:
        a, b = t["a"], t["b"]
        total = F.length(a) + F.length(b)
        block = F.greatest(common_prefix(a, b), common_prefix(F.reverse(a), F.reverse(b)))
        same = F.when(a == b, 1.0)
        lower = same.when(F.length(b) >= JUNK_FROM, 0.0).otherwise(2.0 * block / F.greatest(total, F.lit(1)))
        upper = F.when(a == b, 1.0).otherwise(2.0 * common_characters(a, b) / F.greatest(total, F.lit(1)))
        return F.struct(lower.alias("lower"), upper.alias("upper"))

    return N.bind(F.struct(a.alias("a"), b.alias("b")), lambda t: F.when(t["a"].isNotNull() & t["b"].isNotNull(), bounds(t)))


def decided(bounds: Column, *thresholds: float) -> Column:
    """Whether the bounds say for every threshold on which side of it the ratio lies."""
    out = F.lit(True)
    for t in thresholds:
        out = out & ((bounds["lower"] >= t) | (bounds["upper"] < t))
    return out


def with_similarity(df: DataFrame, a: Column, b: Column, out: str = "similarity", thresholds: tuple[float, ...] = ()) -> DataFrame:
    """df with ``similarity_ratio`` where it is needed, else a value on its side of every threshold: Python gets only pairs that the bounds leave open.

    Without thresholds the value is exact for every pair. Texts and bounds are columns of their own before Python is called, so each is made once.
    """
    texts = N.bind(F.struct(a.alias("a"), b.alias("b")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), ratio_bounds(t["a"], t["b"]).alias("bounds")))
    bound = df.withColumn("_t", F.explode(F.array(texts)))  # one row each: no projection above it repeats what is in it
    bounds = F.col("_t.bounds")
    open_ = ~decided(bounds, *thresholds) if thresholds else bounds["lower"] < bounds["upper"]
    return bound.withColumn(out, F.coalesce(_ratio_once(F.when(open_, F.col("_t.a")), F.col("_t.b")), bounds["lower"])).drop("_t")


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for unequal lengths."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))))


def _result(right: Column, error: Column, similarity: Column | None) -> Column:
    right = F.coalesce(right, F.lit(False))
    close = F.lit(None).cast("double") if similarity is None else similarity
    return F.struct(
        F.when(right, S.CORRECT).otherwise(S.WRONG).alias("verdict"),
        F.when(~right, error).alias("error_type"),
        F.when(right, F.lit(1.0)).otherwise(close).alias("similarity"),
    )


def _judged(a: Column, b: Column, body: Callable[[Column, Column, Column], Column], close: Column | None = None) -> Column:
    """body(a, b, similarity) with each in the plan once. Python can't run inside it, so the similarity is computed before."""
    close = F.lit(None).cast("double") if close is None else close
    return N.bind(F.struct(a.alias("a"), b.alias("b"), close.alias("close")), lambda t: body(t["a"], t["b"], t["close"]))


def match_id(label: Column, model: Column, similarity: bool = False) -> Column:
    a, b = N.digits(label), N.digits(model)

    def body(a, b, close):
        error = F.when(F.length(a) != F.length(b), "wrong_length").when(hamming(a, b) == 1, "one_digit").otherwise("many_digits")
        return _result(a == b, error, close)

    return _judged(a, b, body, similarity_ratio(F.when(a != b, a), b) if similarity else None)


def match_name(label: Column, model: Column, similarity: bool = False) -> Column:
    """The last two error types need a similarity; without it both are ``some_or_all_characters``."""
    a, b = N.person_name(label), N.person_name(model)
    close = None
    if similarity:
        bare = similarity_ratio(F.when(a != b, N.strip_diacritics(a)), N.strip_diacritics(b))
        close = F.struct(similarity_ratio(F.when(a != b, a), b).alias("whole"), bare.alias("bare"))

    def body(a, b, close):
        bare_equal = N.strip_diacritics(a) == N.strip_diacritics(b)
        error = F.when(bare_equal, "diacritics").when(hamming(a, b) == 1, "one_character").when(F.contains(a, b) | F.contains(b, a), "part_missing_or_added")
        if similarity:
            error = error.when(close["bare"] >= NAME_NEAR, "some_characters").otherwise("all_wrong")
        else:
            error = error.otherwise("some_or_all_characters")
        return _result(a == b, error, close["whole"] if similarity else None)

    return _judged(a, b, body, close)


def match_date(label: Column, model: Column, similarity: bool = False) -> Column:
    a, b = N.date(label), N.date(model)

    def body(a, b, close):
        error = F.when(b.isNull(), "not_a_date").otherwise("wrong_date")
        return _result(a == b, error, F.when(b.isNull(), 0.0).otherwise(close) if similarity else None)

    return _judged(a, b, body, similarity_ratio(F.coalesce(a, F.lit("")), b) if similarity else None)


def match_money(label: Column, model: Column, similarity: bool = False) -> Column:
    """By digits: separators are presentation."""
    a, b = N.digits(label), N.digits(model)

    def body(a, b, close):
        error = (
            F.when(b == "", "not_a_number").when(F.length(a) != F.length(b), "wrong_digit_count").when(hamming(a, b) == 1, "one_digit").otherwise("many_digits")
        )
        return _result((a != "") & (a == b), error, F.when(b == "", 0.0).otherwise(close) if similarity else None)

    return _judged(a, b, body, similarity_ratio(a, b) if similarity else None)


def match_quantity(label: Column, model: Column, similarity: bool = False) -> Column:
    """By value: a decimal separator is information."""

    def body(a, b, _):
        rounded = (a != 0) & (b != 0) & (F.abs(F.try_divide(b, a) - 1) < 0.001)
        shifted = (a != 0) & ((b == a * 1000) | (b == a / 1000) | (b == a * 1e6) | (b == a / 1e6))
        error = F.when(b.isNull(), "not_a_number").when(rounded, "rounding").when(shifted, "unit_scale").otherwise("wrong_value")
        return N.bind(error, lambda e: _result(F.abs(a - b) < 1e-9, e, F.when(e == "rounding", 0.99).when(e == "unit_scale", 0.5).otherwise(0.0)))

    return _judged(N.number(label), N.number(model), body)


def match_address(label: Column, model: Column, similarity: bool = True, close: Column | None = None) -> Column:
    """By similarity; ``close`` is one that ``with_similarity`` has made before."""
    close = similarity_ratio(N.address(label), N.address(model)) if close is None else close
    error = F.when(close >= ADDRESS_NEAR, "beyond_threshold").otherwise("all_wrong")
    right = close >= ADDRESS_MATCH
    value = close if similarity else F.lit(None).cast("double")
    return F.struct(F.when(right, S.CORRECT).otherwise(S.WRONG).alias("verdict"), F.when(~right, error).alias("error_type"), value.alias("similarity"))


def with_address_match(df: DataFrame, label: Column, model: Column, similarity: bool = True, out: str = "match") -> DataFrame:
    """df with the verdict on two addresses; its similarity is exact if it is asked for, else it is only computed as far as the verdict needs it."""
    close = with_similarity(df, N.address(label), N.address(model), "_close", () if similarity else (ADDRESS_MATCH, ADDRESS_NEAR))
    return close.withColumn(out, match_address(label, model, similarity, F.col("_close"))).drop("_close")


def match_enum(label: Column, model: Column, similarity: bool = False) -> Column:
    a, b = N.option(label), N.option(model)
    return _result(a == b, F.when(b.isNull(), "outside_options").otherwise("wrong_option"), F.lit(0.0))


def match_exact(label: Column, model: Column, similarity: bool = False) -> Column:
    """Equal after white space is collapsed; for fields that are codes."""
    return _result(N.collapse(label) == N.collapse(model), F.lit("wrong_value"), None)


RULES: dict[str, Callable[..., Column]] = {
    "id": match_id,
    "name": match_name,
    "date": match_date,
    "money": match_money,
    "quantity": match_quantity,
    "address": match_address,
    "enum": match_enum,
    "exact": match_exact,
}


def verdict(label: Column, model: Column, infra: Column, compared: Column) -> Column:
    """Struct of verdict, error_type and similarity: infrastructure errors first, then who gave a value, then the rule's own."""
    no_label, no_model = N.blank(label), N.blank(model)

    def fixed(v: str, error: str | None) -> Column:
        return F.struct(F.lit(v).alias("verdict"), F.lit(error).cast("string").alias("error_type"), F.lit(None).cast("double").alias("similarity"))

    return (
        F.when(infra, fixed(S.SYSTEM_ERROR, "call_failed"))
        .when(no_label & no_model, fixed(S.ABSTAIN_OK, None))
        .when(no_label, fixed(S.FABRICATED, "fabricated_on_unreadable"))
        .when(no_model, fixed(S.MISSED, "silent_on_readable"))
        .otherwise(compared)
    )


def with_verdict(df: DataFrame, kinds: tuple[str, ...] = tuple(RULES), similarity: bool = True) -> DataFrame:
    """df (label, model, kind, infra) with verdict, error_type and similarity; a kind outside ``kinds`` raises.

    Only the rules of ``kinds`` are in the plan, so a run without text fields has no Python in it.
    """
    label, model = F.col("label"), F.col("model")
    both = ~N.blank(label) & ~N.blank(model) & ~F.col("infra")
    given: dict[str, dict] = {}
    if "address" in kinds:
        wanted = both & (F.col("kind") == "address")
        own = (F.when(wanted, label), F.when(wanted, model))
        df = with_similarity(df, N.address(own[0]), N.address(own[1]), "_close", () if similarity else (ADDRESS_MATCH, ADDRESS_NEAR))
        given["address"] = {"close": F.col("_close")}
    compared = F.raise_error(F.concat(F.lit("no matching rule for field type "), F.coalesce("kind", F.lit("null"))))
    compared = compared.cast("struct<verdict:string,error_type:string,similarity:double>")
    for kind in kinds:
        wanted = both & (F.col("kind") == kind)
        compared = F.when(F.col("kind") == kind, RULES[kind](F.when(wanted, label), F.when(wanted, model), similarity, **given.get(kind, {}))).otherwise(compared)
    return df.withColumn("_v", verdict(label, model, F.col("infra"), compared)).select("*", "_v.verdict", "_v.error_type", "_v.similarity").drop("_v", "_close")


def is_correct(v: Column | str = "verdict") -> Column:
    return (F.col(v) if isinstance(v, str) else v).isin(*S.GOOD)
