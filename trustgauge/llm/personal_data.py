"""Personal data: patterns propose spans, checksums and ranges confirm them, words nearby adjust a score.

DataFrame functions only, within the row of a text. A text is split at the matches of a kind's pattern; running sums over
the lengths of its pieces and matches, by doubling steps, give the places of matches in code points, so a text with very
many matches costs its length times a logarithm. Patterns are written without backtracking: a run of characters that can
only be entered at its start is entered there alone, or where the match before it ended.

Kinds and what confirms them, in the order of ``KINDS``. The first four are the base kinds, whose confirmed spans always stay:
email; ip (parts at most 255); card (16 to 19 digits, Luhn); phone (8 to 15 digits). Further spans stay if their score
reaches ``STRONG``: iban (mod-97 and no letter or digit around it), short_card (13 to 15 digits, Luhn), national_id
(3-2-4 digits, its parts in range). A score begins at the kind's own, rises by ``NEAR`` if one of its words stands within
``BEFORE`` code points before it, or ``AFTER`` behind it, and falls by ``NEAR`` if a word against it stands before it;
what lies beyond a neighbouring match of the same kind isn't looked at.

Defined results: a null or empty text has no spans; ids are only passed through, so null and repeated ones are rows of
their own; other columns pass through, and one named like an added column is replaced; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let

BEFORE, AFTER, NEAR, STRONG = 40, 20, 0.35, 0.5

#: Kind: pattern, score without context, words for it, words against it.
KINDS: dict[str, tuple[str, float, str, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|kontakt|contacto|correo|courriel", r"example|sample"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server|adresse|direcci", r"version|release|section|(?:^|[^a-z])v$"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.7, r"card|credit|visa|karte|carte|tarjeta", r"order|invoice|isbn|serial"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|(?:^|[^a-z])tel(?:[^a-z]|$)|call|mobile|telefon|t[ée]l[ée]phone|tel[ée]fono", r"order|invoice|serial"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", 0.8, r"iban|account|konto|compte|cuenta", r"serial|order"),
    "short_card": ("", 0.3, r"card|credit|amex|karte|carte|tarjeta", r"order|invoice|isbn|serial"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"(?:^|[^a-z])ssn(?:[^a-z]|$)|social security|tax id|national id", r"order|invoice|serial"),
}
BASE = ("email", "ip", "card", "phone")
#: Doublings of the running sums: 2^26 pieces of a text at most.
DOUBLINGS = 26


def running(lengths: Column) -> Column:
    """Sums of an array up to each place, in steps that double."""


    def step(k: int):
        return lambda a: F.when(F.size(a) > 1 << k, F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - (1 << k)), F.lit(0)))).otherwise(a)

    out = lengths
    for k in range(DOUBLINGS):
        out = let(out, step(k))
    return out


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after, edge) of the leftmost matches that don't overlap; edge is the characters on both sides."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(t: Column) -> Column:
        both = F.zip_with(t["p"], t["m"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        return let(
            running(both),
            lambda ends: F.transform(
                t["m"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("value"),
                    F.right(F.get(t["p"], i), F.lit(BEFORE)).alias("before"),
                    F.left(F.get(t["p"], i + 1), F.lit(AFTER)).alias("after"),
                ),
            ),
        )

    return let(F.struct(pieces.alias("p"), matches.alias("m")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check: every second one from the right doubled, its digits summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 by 97."""
    bare = F.regexp_replace(value, "[^A-Z0-9]+", "")
    turned = let(bare, lambda b: F.concat(F.substr(b, F.lit(5)), F.left(b, F.lit(4))))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: let(F.regexp_replace(x, "^0+(?=.)", ""), lambda d: (F.length(d) < 4) & (F.right(d, F.lit(3)).cast("int") <= 255)))
    if kind in ("card", "short_card"):
        least, most = (16, 19) if kind == "card" else (13, 15)
        return let(_digits(value), lambda d: F.length(d).between(least, most) & F.when(F.length(d).between(least, most), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        alone = ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]")
        return alone & F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    if kind == "national_id":
        alone = ~s["before"].rlike("[0-9-]$") & ~s["after"].rlike("^[0-9-]")
        return alone & ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, s: Column) -> Column:
    _, own, good, bad = KINDS[kind]
    near = let(F.lower(s["before"]), lambda b: F.when(b.rlike(good) | F.lower(s["after"]).rlike(good), NEAR).otherwise(0.0) - F.when(b.rlike(bad), NEAR).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near + own)), 2)


def _spans(kind: str, proposed: Column) -> Column:
    kept = F.filter(proposed, lambda s: _confirmed(kind, s))
    out = F.transform(
        kept,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _score(kind, s).alias("score")),
    )
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= STRONG)


#: What a text must hold for a kind's pattern to match at all.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "national_id": "-"}


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with the array of (kind, start, end, value, score) of the personal data in each text, by kind, then start."""
    own = dict(zip(KINDS, free(docs, *(f"_{k}" for k in KINDS)), strict=True))
    (full,) = free(docs, "_full")
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    proposed = {}
    for kind, (pattern, *_) in KINDS.items():
        if pattern:
            need = F.contains(F.col(full), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col(full).rlike("[0-9]")
            proposed[own[kind]] = F.when(need, found(F.col(full), pattern)).otherwise(none)
    # one column a kind, so that each is made once
    df = docs.withColumn(full, F.coalesce(F.col(text), F.lit(""))).withColumns(proposed)
    every = [_spans(kind, F.col(own["card" if kind == "short_card" else kind])) for kind in KINDS]
    return df.withColumn(out, F.concat(*every)).drop(full, *proposed)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", strong: float = STRONG) -> DataFrame:
    """docs with each span of a score of ``strong`` or more replaced by its kind in angle brackets; of overlapping ones the first goes, the longest of several."""
    spans, cut = free(docs, "_spans", "_cut")
    ordered = F.array_sort(
        F.transform(F.filter(F.col(spans), lambda s: s["score"] >= strong), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))
    )
    # a span counts if it begins behind all that begin before it
    most = lambda a: F.transform(a, lambda s, i: F.coalesce(F.array_max(F.transform(F.slice(a, F.lit(1), i), lambda x: -x["end"])), F.lit(0)))
    free_ones = let(ordered, lambda a: let(most(a), lambda m: F.filter(a, lambda s, i: s["start"] >= F.get(m, i))))
    full = F.coalesce(F.col(text), F.lit(""))

    def replaced(a: Column) -> Column:
        between = F.transform(
            a, lambda s, i: F.concat(F.substr(full, F.coalesce(-F.get(a, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(-F.get(a, i - 1)["end"], F.lit(0))), F.lit("<"), s["kind"], F.lit(">"))
        )
        return F.concat(F.array_join(between, ""), F.substr(full, F.coalesce(-F.element_at(a, -1)["end"], F.lit(0)) + 1))

    out = with_spans(docs, text, spans).withColumn(cut, free_ones)
    return out.withColumn(text, F.when(F.size(cut) > 0, replaced(F.col(cut))).otherwise(F.col(text))).drop(spans, cut)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts of the base kinds, digest of their spans, all spans, and how many of these have a score of STRONG or more."""
    (spans,) = free(docs, "_spans")
    rows = with_spans(docs.select(id_col, text), text, spans)
    count = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(F.col(spans), lambda s: s["kind"].isin(*BASE))
    return rows.select(
        F.col(id_col),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
        F.size(F.filter(F.col(spans), lambda s: s["score"] >= STRONG)).cast("long").alias("n_strong"),
    )
