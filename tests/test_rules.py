"""Matching rules and normalisers, row by row."""

import difflib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.functions import match as M
from trustgauge.functions import normalize as N

CORRECT, WRONG, MISSED, ABSTAIN_OK, FABRICATED, SYSTEM_ERROR = "CORRECT", "WRONG", "MISSED", "ABSTAIN_OK", "FABRICATED", "SYSTEM_ERROR"

#: Own cases: each rule's branches, not a published table.
RULES = [
    ("name", "ĐỖ KHÁNH LINH", "Đỗ  Khánh\tLinh", CORRECT, None),
    ("name", "ĐỖ KHÁNH LINH", "(Đỗ Khánh Linh)", CORRECT, None),
    ("name", "ĐỖ KHÁNH LINH", "do khanh linh", WRONG, "diacritics"),
    ("name", "PHAN VĂN KHẢI", "PHAN VĂN", WRONG, "part_missing_or_added"),
    ("name", "PHAN VĂN", "ÔNG PHAN VĂN", WRONG, "part_missing_or_added"),
    ("name", "QRST", "QRSU", WRONG, "one_character"),
    ("name", "MNOPQRSTUV", "MNXPQRSTZV", WRONG, "some_characters"),
    ("name", "PHAN VĂN KHẢI", "XYZ", WRONG, "all_wrong"),
    ("date", "07/11/2003", "7.11.2003", CORRECT, None),
    ("date", "07/11/2003", "2003/11/7", CORRECT, None),
    ("date", "07/11/2003", "ngày 07-11-2003", CORRECT, None),
    ("date", "07/11/2003", "07/12/2003", WRONG, "wrong_date"),
    ("date", "07/11/2003", "07/11/03", WRONG, "not_a_date"),
    ("date", "07/11/2003", "7/11/1899", WRONG, "not_a_date"),
    ("date", "30/02/2003", "2003-02-30", CORRECT, None),
    ("id", "000777", "00 07 77", CORRECT, None),
    ("id", "000777", "0007777", WRONG, "wrong_length"),
    ("id", "000777", "000778", WRONG, "one_digit"),
    ("id", "000777", "100778", WRONG, "many_digits"),
    ("money", "2.750.000 đồng", "2,750,000 VND", CORRECT, None),
    ("money", "2.750.000 đồng", "2.750.001", WRONG, "one_digit"),
    ("money", "2.750.000 đồng", "27.500.000", WRONG, "wrong_digit_count"),
    ("money", "2.750.000 đồng", "?", WRONG, "not_a_number"),
    ("quantity", "22,4 m²", "22.4 m^2", CORRECT, None),
    ("quantity", "22,4 m²", "224", WRONG, "wrong_value"),
    ("quantity", "22,4 m²", "22400", WRONG, "unit_scale"),
    ("quantity", "20000", "20002", WRONG, "rounding"),
    ("quantity", "3,2 triệu đồng", "3.200.000", CORRECT, None),
    ("quantity", "5 tr/người", "5000000", CORRECT, None),
    ("quantity", "22,4 m²", "m²", WRONG, "not_a_number"),
    ("enum", "mua", "  MUA.", CORRECT, None),
    ("enum", "mua", "thuê", WRONG, "wrong_option"),
    ("enum", "thuê", "mượn", WRONG, "outside_options"),
    ("address", "Số nhà 5, Xã An Bình, Huyện Ba, Tỉnh Sơn", "SN 5, X An Bình, H Ba, T Sơn", CORRECT, None),
    ("address", "Số nhà 5, Xã An Bình, Huyện Ba, Tỉnh Sơn", "SN 5, X An Bình, H", WRONG, "beyond_threshold"),
    ("address", "kkk", "zzz", WRONG, "all_wrong"),
    ("exact", "a  b", "a b", CORRECT, None),
    ("exact", "ab", "a b", WRONG, "wrong_value"),
    ("date", "07/11/2003", None, MISSED, "silent_on_readable"),
    ("date", "07/11/2003", " \t", MISSED, "silent_on_readable"),
    ("money", None, None, ABSTAIN_OK, None),
    ("money", "", "12", FABRICATED, "fabricated_on_unreadable"),
]


def test_rules(spark):
    rows = [(i, k, a, b, False) for i, (k, a, b, _, _) in enumerate(RULES)] + [(len(RULES), "id", None, None, True)]
    df = spark.createDataFrame(rows, "i int, kind string, label string, model string, infra boolean")
    df = df.withColumn("label", N.nfc(F.col("label"))).withColumn("model", N.nfc(F.col("model")))
    got = {r["i"]: r for r in M.with_verdict(df).collect()}
    for i, (kind, a, b, verdict, error) in enumerate(RULES):
        assert (got[i]["verdict"], got[i]["error_type"]) == (verdict, error), (kind, a, b, got[i])
    assert got[len(RULES)]["verdict"] == SYSTEM_ERROR


def test_unknown_kind_raises(spark):
    df = spark.createDataFrame([("a", "b", "colour", False)], "label string, model string, kind string, infra boolean")
    with pytest.raises(Exception, match="no matching rule"):
        M.with_verdict(df, ("id",)).collect()


def test_numbers(spark):
    cases = [("15 m²", 15.0), ("8.500.000 đồng", 8.5e6), ("8,5 triệu", 8.5e6), ("1.234,5", 12345.0), ("15 m 20", 150.0), ("", None), ("x", None), ("2 nghìn", 2000.0)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string").select(N.number(F.col("s")).alias("v"))
    assert [r["v"] for r in df.collect()] == [b for _, b in cases]


def test_post_processing(spark):
    cases = [
        ("id", " 0003 01 ", "000301"),
        ("id", "abc", None),
        ("date", "ngày 1 / 3 / 1990 x", "1/3/1990"),
        ("quantity", "khoảng 18,5 m²", "18,5"),
        ("quantity", "x", None),
        ("money", "= 8.500.000 đồng", "8.500.000"),
        ("name", "TRẦN | 9 B MAI A", "TRẦN MAI A"),
        ("text", "  ", None),
    ]
    df = spark.createDataFrame([(k, s) for k, s, _ in cases], "kind string, s string").select(N.post_process(F.col("kind"), F.col("s")).alias("v"))
    assert [r["v"] for r in df.collect()] == [x for _, _, x in cases]


TEXTS = st.text(alphabet="ab cdéĐ", max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=60))
def test_bounds_hold_the_ratio(spark, pairs):
    """Also for second texts so long that difflib leaves characters out."""
    pairs = pairs + [(a * 20, b * 20) for a, b in pairs[:10]] + [("x" * 300, "x" * 300), ("ab" * 120, "ba" * 120), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", M.ratio_bounds(F.col("a"), F.col("b")))
    df = M.with_similarity(M.with_similarity(df, F.col("a"), F.col("b"), "exact"), F.col("a"), F.col("b"), "near", (0.9, 0.6))
    for r in df.collect():
        truth = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["r"]["lower"] <= truth + 1e-12 and truth <= r["r"]["upper"] + 1e-12
        assert r["exact"] == pytest.approx(truth) and all((r["near"] >= t) == (truth >= t) for t in (0.9, 0.6))


def test_verdicts_by_bounds_are_those_by_ratio(spark):
    """All pairs of parts' addresses in four forms; few of them reach Python."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_partkey as id", "concat_ws(' ', 'Thành phố', p_name, p_type) as label", "p_name", "p_type")
    forms = parts.withColumn("model", F.explode(F.array(F.upper("label"), F.left("label", F.length("label") - 4), F.concat_ws(" ", "p_type", "p_name"), F.col("p_type"))))
    rows = M.with_address_match(forms, F.col("label"), F.col("model"), similarity=False, out="fast")
    rows = M.with_address_match(rows, F.col("label"), F.col("model"), out="full")
    rows = rows.withColumn("open", ~M.decided(M.ratio_bounds(N.address(F.col("label")), N.address(F.col("model"))), M.ADDRESS_MATCH, M.ADDRESS_NEAR))
    got = rows.collect()
    for r in got:
        truth = difflib.SequenceMatcher(None, address(r["label"]), address(r["model"])).ratio()
        want = (S.CORRECT, None) if truth >= 0.9 else (S.WRONG, "beyond_threshold" if truth >= 0.6 else "all_wrong")
        assert (r["fast"]["verdict"], r["fast"]["error_type"]) == (r["full"]["verdict"], r["full"]["error_type"]) == want
        assert r["full"]["similarity"] == pytest.approx(truth) and r["fast"]["similarity"] is None
    assert sum(r["open"] for r in got) < 0.3 * len(got)


def address(text):
    return " ".join(re.sub("[.,]", " ", text.lower().replace("thành phố", "tp")).split())


def test_a_date_with_words_in_it_is_none(spark):
    """Letters go, the spaces around them stay."""
    texts = {"ngày 01 tháng 03 năm 1990": None, "ngày 01/03/1990": "1990-03-01", "  01 03  1990": "1990-03-01", "01 / 03 / 1990": None, "1990. 3.1": None, "(1990-3-1)": "1990-03-01"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == texts
