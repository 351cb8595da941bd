"""Properties of metrics, sources, reports, extraction and streaming on small tables."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators import calibration as C
from trustgauge.operators import extraction as X
from trustgauge.operators import gate as G
from trustgauge.operators import metrics as A
from trustgauge.operators import ordered
from trustgauge.operators import points as P
from trustgauge.operators import quality as Q
from trustgauge.operators import review as R
from trustgauge.operators.platform import Dossiers
from trustgauge.sources import readers, report, writers
from trustgauge.streaming import points as stream

POINT = "id long, doc_type string, tier string, tier_ord int, field string, severity string, weight double, expectation string, label string, model string, confidence double, verdict string, error_type string, abstain_reason string, no_anchor boolean"


def points(spark, rows):
    """rows: (verdict, confidence, severity)"""
    kinds = {S.ABSTAIN_OK: S.MUST_ABSTAIN, S.FABRICATED: S.MUST_ABSTAIN}
    data = [
        (i, "en", "clean", 0, "f", sev, S.WEIGHTS[sev], kinds.get(v, S.MUST_EXTRACT), "a", None if c is None else "b", c, v, None, None, False)
        for i, (v, c, sev) in enumerate(rows)
    ]
    return spark.createDataFrame(data, POINT)


rows = st.lists(
    st.tuples(st.sampled_from(S.VERDICTS), st.one_of(st.none(), st.integers(0, 20).map(lambda i: i / 20)), st.sampled_from(["critical", "medium", "light"])), max_size=12
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_invariants(spark, data):
    p = points(spark, data)
    head = A.headline(p).first()
    for name in ("trust_score", "accuracy_readable", "abstain_ok_rate", "fabricated_rate"):
        assert head[name] is None or 0 <= head[name] <= 1
    assert sum(r["n_points"] for r in A.population_split(p).collect()) == len(data)
    a, b = C.auc(p).first()["auc"], C.auc_pairs(p).first()["auc"]
    right = [c for v, c, _ in data if v == S.CORRECT and c is not None]
    wrong = [c for v, c, _ in data if v == S.WRONG and c is not None]
    want = sum((x > y) + 0.5 * (x == y) for x in right for y in wrong) / (len(right) * len(wrong)) if right and wrong else None
    assert a == pytest.approx(b) == pytest.approx(want) if want is not None else a is None and b is None
    sweep, suffix = (sorted(map(tuple, f(p).collect())) for f in (C.threshold_sweep, C.threshold_sweep_suffix))
    assert sweep == suffix
    assert [r[2] for r in sweep] == sorted((r[2] for r in sweep), reverse=True)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 5.0), ("b", None)], "k string, elapsed_ms double")
    got = {(r["key"], r["overall"]): (r["n"], r["upper_median"], r["least"], r["most"]) for r in A.timing(df, "k").collect()}
    assert got == {("a", 0): (4, 3.0, 1.0, 4.0), ("b", 0): (1, 5.0, 5.0, 5.0), (None, 1): (5, 3.0, 1.0, 5.0)}


def test_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", 5)
    data = [(["a", "b", None][i % 3], float("nan") if i == 7 else None if i == 11 else (i * 37 % 101) / 8, i) for i in range(90)]
    df = spark.createDataFrame(data, "k string, v double, n int")
    numbered = df.withColumn("v_", ordered.order_number(df, "v"))
    assert len(ordered.cuts(numbered, "v_").first()["_cuts"]) == 4
    got = {(r["k"], r["n"]): (r["upto"], r["upto_all"]) for r in ordered.running(df, "v", ("k",), upto=F.col("n")).collect()}
    order = lambda r: (r[1] is not None, r[1] != r[1], r[1])
    want = {}
    for k in ("a", "b", None):
        own, total = sorted((r for r in data if r[0] == k), key=order), 0
        for r in own:
            total += r[2]
            want[k, r[2]] = (total, sum(x[2] for x in own))
    assert got == want
    numbers = P.case_ids(spark.createDataFrame([(f"r{i:03d}", "x", "t") for i in range(120)], "id string, doc_type string, tier string")).collect()
    assert {r["id"]: r["case_id"] for r in numbers} == {f"r{i:03d}": f"TC-X-T-{i + 1:02d}" for i in range(120)}
    assert ordered.running(df.limit(0), "v", upto=F.col("n")).collect() == []


def test_cuts_depend_on_the_rows_alone(spark, monkeypatch):
    rows = spark.range(200_000).select((F.col("id") * F.col("id") % 1_000_003).cast("double").alias("v"))
    dealt = [rows.repartition(n, *by) for n, by in ((2, ()), (5, ("v",)), (13, ()))]
    found = {tuple(sorted(ordered.cuts(d, "v").first()["_cuts"])) for d in dealt}
    assert len(found) == 1  # a plan that works them out twice must find the same
    assert ordered.RANGES / 2 <= len(found.pop()) <= ordered.RANGES
    sizes = sorted(r["count"] for r in ordered.running(rows, "v", c=F.lit(1)).groupBy(F.floor(F.col("c") / 10_000)).count().collect())
    assert sizes[-1] <= 10_000 and sum(sizes) == 200_000
    skewed = rows.select(F.when(F.col("v") % 2 == 0, 7.0).otherwise(F.col("v")).alias("v"))  # half of the rows have one number
    at = ordered.cuts(skewed, "v").first()["_cuts"]
    assert ordered.RANGES / 4 < len(at) < ordered.RANGES * 3 / 4
    monkeypatch.setattr(ordered, "PICKED", 10)
    assert 2 <= len(ordered.cuts(rows, "v").first()["_cuts"]) <= 10


def test_running_sums_start_no_job_before_they_are_asked_for(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "v int, n int").groupBy("v").agg(F.sum("n").alias("n"))
    spark.sparkContext.setJobGroup("building", "")
    out = ordered.running(df, "v", upto=F.col("n"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs and [r["upto"] for r in out.orderBy("v").collect()][-1] == 1225


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "decimal(20,2)", "long"])
def test_running_sums_over_any_order(spark, monkeypatch, kind):
    monkeypatch.setattr(ordered, "RANGES", 4)
    days = spark.range(40).select(F.expr("date_add(date'1960-01-01', cast(id * 397 % 41 * 333 as int))").alias("d"))
    value = {"string": "concat('ä', cast(d as string))", "long": "unix_date(d) * 300000000000001", "decimal(20,2)": "cast(unix_date(d) as decimal(20,2)) / 7"}.get(kind, f"cast(d as {kind})")
    got = [r["place"] for r in ordered.running(days.selectExpr(f"{value} as v"), "v", place=F.lit(1)).orderBy("v").collect()]
    assert got == list(range(1, 41))


def test_tolerance_of_runs_is_that_of_pairs(spark):
    schema = "run int, trust_score double, accuracy_readable double, critical_accuracy double, abstain_ok_rate double, fabricated_rate double"
    runs = spark.createDataFrame([(0, 0.5, 0.9, None, 0.2, 0.1), (1, 0.3, 0.8, 0.1, 0.3, 0.3), (2, 0.6, None, 0.4, 0.4, 0.2)], schema)
    now, before = (G.metric_rows(runs.where(F.col("run") == r)) for r in (1, 0))
    pairs = G.tolerance(now, before, A.run_stability(runs, tuple(G.WATCHED))).collect()
    assert sorted(G.tolerance_of_runs(runs, 1, 0).collect()) == sorted(pairs) and len(pairs) == 4


def test_missing_result_is_infra_and_first_value_wins(spark):
    dim = S.field_dimension(spark)
    labels = spark.createDataFrame(
        [("r1", "cccd", "clean", [("ho_ten", "MAI", S.MUST_EXTRACT)]), ("r2", "cccd", "clean", [("ho_ten", None, S.MUST_ABSTAIN)])],
        "id string, doc_type string, tier string, fields array<struct<field:string,label:string,expectation:string>>",
    )
    results = spark.createDataFrame(
        [("r1", "cccd", 1.0, None, None, None, [("ho_ten", "Mai", 0.9, "ocr"), ("ho_ten", "other", 0.8, "ocr")])],
        "id string, doc_type string, elapsed_ms double, error string, abstain_reason string, no_anchor boolean, fields array<struct<field:string,value:string,confidence:double,source:string>>",
    )
    got = {r["id"]: r for r in P.check_points(labels, results, dim, ("name",), similarity=False).collect()}
    assert (got["r1"]["verdict"], got["r1"]["model"]) == (S.CORRECT, "Mai")
    assert (got["r2"]["verdict"], got["r2"]["note"]) == (S.SYSTEM_ERROR, "no result for this record")
    assert [r["model"] for r in P.first_values(results).collect()] == ["Mai"]
    bad = labels.withColumn("fields", F.transform("fields", lambda f: f.withField("field", F.lit("nosuch"))))
    with pytest.raises(Exception, match="no field nosuch"):
        P.check_points(bad, results, dim, ("name",), similarity=False).collect()
    ledger = {r["id"]: r for r in R.evidence_ledger(labels, results, dim, 0.9).collect()}
    assert ledger["r1"]["reason"] == "missing critical: so_dinh_danh" and ledger["r2"]["dossier_status"] == S.NEEDS_SUPPLEMENT
    assert [r["needs_review"] for r in R.review_flags(results, 0.9).collect()] == [False, True]


def test_gate_and_exit(spark):
    p = points(spark, [(S.CORRECT, 0.9, "critical"), (S.WRONG, 0.9, "critical"), (S.ABSTAIN_OK, None, "medium")])
    gate = G.gate_rows(A.headline(p), 1)
    assert {r["metric"] for r in gate.where("not ok").collect()} == {"critical_accuracy"}
    code, said = report.gate_exit(spark, X.extractor("always_abstain"), gate)
    assert code == 1 and len(said) == 1
    assert report.gate_exit(spark, X.extractor("always_abstain"), gate, only_regression=True)[0] == 0
    assert report.gate_exit(spark, X.extractor("always_abstain"), None)[0] == 1
    with pytest.raises(KeyError):
        X.extractor("nosuch")
    text = report.markdown(p, 0.8)
    assert "## By tier" in text and "| clean |" in text
    assert report.percent(None) == "—" and report.shortened("a|b") == r"a\|b" and len(report.shortened("x" * 60)) == 42


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(
        json.dumps({"id": "a", "tep": "p", "doc_type": "cccd", "muc_chat_luong": "sach", "anh_doc_duoc": True, "lay_mau_luot2": False,
                    "fields": [{"ten_truong": "ho_ten", "gia_tri": None, "ky_vong": "vung_xam", "nguon_nhan": "x", "gia_tri_luot2": None, "ghi_chu_luot2": ""}]}) + "\n\n"
    )
    r = readers.labels(spark, str(tmp_path / "l.jsonl")).first()
    assert (r["tier"], r["fields"][0]["expectation"], r["fields"][0]["label"]) == ("clean", S.GREY, None)
    csv = "# note\nid,ten_truong,doc_duoc,gia_tri_doc_lai,ghi_chu\n# more\na,ho_ten,1,\"x, y\",\n ,ho_ten,1,z,\na,ngay_sinh,0,,\n"
    (tmp_path / "r.csv").write_text(csv)
    got = {x["field"]: (x["legible"], x["value"]) for x in readers.second_reads(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"ho_ten": (True, "x, y"), "ngay_sinh": (False, "")}
    (tmp_path / "r.csv").write_text(csv + "a,ho_ten,1,again,\n")
    with pytest.raises(ValueError, match="a.ho_ten"):
        readers.second_reads(spark, str(tmp_path / "r.csv"))
    assert readers.snapshot(spark, str(tmp_path / "none.json")) is None
    assert readers.known_failures(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"meta": {"model": "m"}, "dau_van_tay_du_lieu": "ff", "chi_so": {"diem_tin_cay": 0.5}, "so_ro_ri_nghiem_trong": 6, "sigma": {"diem_tin_cay": 0.0},
                                                 "so_lan_do_sigma": 1, "phan_quyet_tung_truong": {"a::b": "DUNG", "a::c": "BIA"}}, indent=1))
    snap = readers.snapshot(spark, str(tmp_path / "s.json"))
    assert {tuple(x) for x in readers.snapshot_verdicts(snap).collect()} == {("a::b", S.CORRECT), ("a::c", S.FABRICATED)}
    assert readers.snapshot_metrics(snap).first()["metric"] == "trust_score"
    (tmp_path / "x.jpg").write_bytes(b"abc")
    assert readers.files(spark, str(tmp_path)).first()["n_bytes"] == 3


def test_writers(spark, tmp_path):
    p = points(spark, [(S.CORRECT, 0.9, "critical"), (S.WRONG, None, "medium")])
    writers.points(p, str(tmp_path / "p"))
    assert readers.points(spark, str(tmp_path / "p")).count() == 2
    print_row = G.fingerprint(p.select(F.col("id").alias("ord"), F.col("verdict").alias("text")))
    writers.snapshot(p, A.headline(p), C.review_gate(p, 0.8), print_row, None, str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s/snapshot")).first()
    assert len(row["fingerprint"]) == 16 and row["critical_leaks"] == 0
    assert spark.read.parquet(str(tmp_path / "s/verdicts")).count() == 2
    writers.log(R.log_lines(spark.createDataFrame([(1, "eligible", 2, 0, None)], "id int, dossier_status string, n_fields int, n_flagged int, reason string"), "now"), str(tmp_path / "log"), ("# head",))
    assert spark.read.text(str(tmp_path / "log/lines")).first()[0] == "now | 1 | - | - | eligible | 2 | 0 | -"
    writers.json_lines(p.select("id", "label", "error_type"), str(tmp_path / "j"))
    assert '"error_type":null' in spark.read.text(str(tmp_path / "j")).first()[0]
    assert G.compare_fingerprints(print_row, None) == "no_baseline" and G.compare_fingerprints(print_row, "0" * 16) == "changed"
    assert G.compare_fingerprints(print_row, print_row.first()[0]) == "same"


def test_extraction(spark):
    text = [(1, 0, "Họ và tên: TRẦN THỊ MAI ~~"), (1, 1, "Ngay sinh:"), (1, 2, "01/03/1990"), (2, 0, "nothing here at all")]
    data = [(p, line, i + 1, w, 10.0 if w == "~~" else 90.0) for p, line, t in text for i, w in enumerate(t.split())]
    words = spark.createDataFrame(data, "page int, line int, pos int, word string, conf double")
    fields = S.field_dimension(spark).where("doc_type = 'cccd' and field in ('ho_ten', 'ngay_sinh')").select("field", "kind", "anchors")
    got = {(r["page"], r["field"]): (r["value"], r["confidence"]) for r in X.read_fields(words, fields).collect()}
    assert got == {(1, "ho_ten"): ("TRẦN THỊ MAI", 0.9), (1, "ngay_sinh"): ("01/03/1990", 0.9)}


def page_words(spark, lines):
    data = [(1, n, i + 1, w, 10.0 if w == "~~" else 90.0) for n, t in enumerate(lines) for i, w in enumerate(t.split())]
    return spark.createDataFrame(data, "page int, line int, pos int, word string, conf double")


def test_second_address_line(spark):
    """The next line belongs to an address, unless it holds another field's anchor."""
    fields = S.field_dimension(spark).where("doc_type = 'cccd'").select("field", "kind", "anchors")
    read = lambda *lines: {r["field"]: r["value"] for r in X.read_fields(page_words(spark, lines), fields).collect()}
    assert read("Nơi thường trú: Số 5 Phố Mới", "Xã An Bình ~~", "nothing more")["noi_thuong_tru"] == "Số 5 Phố Mới Xã An Bình"
    got = read("Nơi thường trú: Số 5 Phố Mới", "Ngày sinh: 07/11/2003")
    assert (got["noi_thuong_tru"], got["ngay_sinh"]) == ("Số 5 Phố Mới", "07/11/2003")
    assert read("Noi thuong tru:", "Xã An Bình", "and then")["noi_thuong_tru"] == "Xã An Bình"


def test_anchors_and_options(spark):
    rows = [("ho va ten: mai", "ho va ten:", 10), ("xx ho va tem mai", "ho va ten:", 11), ("zzzzzzzzzzzzz", "so:", None), ("", "so:", None), ("so", ": ", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, norm string, anchor_norm string")
    got = {r["i"]: (r["score"], r["offset"]) for r in X.with_anchor(df).collect()}
    assert {i: got[i][1] for i in got} == {i: o for i, (_, _, o) in enumerate(rows) if o is not None}
    assert got[0][0] == 1.0 and 0.7 <= got[1][0] < 1
    names = ["mua", "thuê", "thuê mua"]
    lines = [("x thuê mua", "thuê mua"), ("x mua ", "mua"), ("x thuê nua", "thuê mua"), ("nothing", None), ("", None)]
    df = spark.createDataFrame([(i, t, names) for i, (t, _) in enumerate(lines)], "i int, t string, o array<string>")
    assert {r["i"]: r["option"] for r in X.with_option(df, "t", "o").collect()} == {i: o for i, (_, o) in enumerate(lines)}


def test_platform(spark):
    """Extraction runs once, flags follow the threshold."""
    calls = []

    class Fixed:
        name, version = "fixed", "1"

        def extract(self, records):
            calls.append(1)
            given = F.array(F.struct(F.lit("ho_ten").alias("field"), F.lit("Mai").alias("value"), F.lit(0.5).alias("confidence"), F.lit("ocr").alias("source")))
            return X.AlwaysAbstain().extract(records).withColumn("fields", given).withColumn("abstain_reason", F.lit(None).cast("string"))

        def self_test(self, spark):
            return True, "fine"

    p = Dossiers(Fixed(), S.field_dimension(spark), 0.8)
    with pytest.raises(RuntimeError):
        p.process()
    p.open(spark.createDataFrame([("cccd_1",), ("form_2",)], "id string"))
    assert {(r["doc_type"], r["n_flagged"]) for r in p.process().collect()} == {("cccd", 1), ("mau_01", 1)}
    assert {r["n_flagged"] for r in p.process(0.5).collect()} == {0} and len(calls) == 1
    assert p.self_test(spark)[0]
    p.close()


def test_quality_rows(spark):
    labels = spark.createDataFrame([("cccd", [("ho_ten",)])], "doc_type string, fields array<struct<field:string>>")
    got = {(r["doc_type"], r["violation"]) for r in Q.label_set_violations(labels, S.field_dimension(spark)).collect()}
    assert got == {("cccd", "other fields"), (None, "too few records")}
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y"], ["y"]))
    assert [r["k"] for r in Q.unbound(a, b, "k").collect()] == ["x"]
    drop = spark.createDataFrame([("trust_score", 0.6, 0.5, -0.1, 0.0, 0.05, True)], "metric string, baseline double, value double, delta double, sigma double, allowed double, over boolean")
    assert report.regression_messages(drop) == ["tolerance: trust_score fell by 0.1000, more than 0.0500"]
    cases = spark.createDataFrame([("TC-1", "f", "a", "b", "0.90", "FAIL")], "case_id string, field string, label string, model string, confidence string, outcome string")
    assert "## TC-1" in report.case_dossiers(cases)


def test_small_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"seed_goc": 1, "so_anh": 1, "anh": [{"id": "a", "tep": "p", "doc_type": "cccd", "muc_chat_luong": "nang", "seed": 3, "bien_dang": ["x"],
                                                 "kich_thuoc": [1, 2], "noi_dung_da_ve": {"ho_ten": "Mai"}}]}))
    assert tuple(readers.manifest(spark, str(tmp_path / "m.json")).first()) == ("a", "cccd", "heavy", 3, "ho_ten", "Mai")
    gate = {"diem_tin_cay_toi_thieu": 0.5, "accuracy_truong_nghiem_trong_toi_thieu": 0.6, "ac3_ty_le_bia_toi_da": 0.0, "so_ro_ri_nghiem_trong_toi_da": 2, "bien_do_tut_cho_phep": 0.05}
    (tmp_path / "c.json").write_text(json.dumps({"nguong_hitl": 0.8, "cong_chat_luong": gate}))
    assert readers.config(spark, str(tmp_path / "c.json")).limits()["critical_leaks_most"] == 2
    (tmp_path / "l.json").write_text(json.dumps({"gioi_han": [{"ma": "G", "tieu_de": "t", "muc_do": "thu_hep", "chan_cac_chi_so": ["x"], "trang_thai": "mo"}]}))
    row = readers.limits(spark, str(tmp_path / "l.json")).first()
    assert (row["code"], row["level"], row["status"]) == ("G", "narrows", "open")


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = spark.createDataFrame([("en", "f", "a", "a", "exact", False), ("en", "f", "a", "b", "exact", False), ("en", "f", None, None, "exact", False)],
                                 "doc_type string, field string, label string, model string, kind string, infra boolean")
    data.write.parquet(src)
    live = stream.verdicts(spark.readStream.schema(data.schema).parquet(src), ("exact",))
    q = live.writeStream.foreachBatch(stream.count_batches(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["verdict"]: r["n_points"] for r in stream.totals(spark, out).collect()} == {S.CORRECT: 1, S.WRONG: 1, S.ABSTAIN_OK: 1}


def test_hash_trees_find_what_changed(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 4)
    rows = [(i, f"r{i}") for i in range(100) if i != 50] + [(7, "again")]
    other = [(i, "x" if i in (3, 98) else t) for i, t in rows if i not in (10, 7)] + [(50, "new"), (7, "again"), (7, "r7")]
    trees = [G.hash_tree(spark.createDataFrame(r, "ord long, text string"), 4).cache() for r in (rows, other)]
    got = {(r["ord"], r["change"]) for r in G.tree_changes(trees[1], trees[0], 4).collect()}
    assert got == {(3, "changed"), (98, "changed"), (10, "removed"), (50, "added")}
    assert G.tree_changes(trees[0], trees[0], 4).count() == 0


def test_each_broken_rule_of_a_dossier_is_a_row(spark):
    dim = spark.createDataFrame([("t", "a", "critical"), ("t", "b", "light"), ("u", "c", "light")], "doc_type string, field string, severity string")
    fields = lambda *names: [(n, v) for n, v in names]
    ledger = spark.createDataFrame(
        [(1, "t", S.ELIGIBLE, None, fields(("a", "x"))), (2, "t", S.ELIGIBLE, None, fields(("a", " "), ("b", "x"))), (3, "t", S.ELIGIBLE, None, None), (4, "t", S.NEEDS_SUPPLEMENT, " ", None), (5, "u", S.ELIGIBLE, None, fields())],
        "id long, doc_type string, dossier_status string, reason string, fields array<struct<field:string,value:string>>",
    )
    labels = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True), (5, True)], "id long, readable boolean")
    got = {(r["id"], r["violation"]) for r in Q.abstain_violations(labels, ledger, dim).collect()}
    gap, stays = "eligible with a critical gap", "unreadable not returned"
    assert got == {(1, "value on unreadable"), (1, stays), (2, gap), (3, stays), (3, gap), (4, "no reason")}


def test_limits_as_a_set(spark):
    schema = "code string, level string, covers array<string>, status string, evidence string"
    rows = [("1", "blocks_conclusion", ["a"], "open", None), ("2", "narrows", ["b"], "open", None), ("3", "note", [], "resolved", "see x/y.csv and z.json"), ("4", "note", ["a"], "open", "no.csv")]
    limits, metrics = spark.createDataFrame(rows, schema), spark.createDataFrame([("a",), ("b",), ("b",)], "metric string")
    got = {(r["violation"], r["metric"]) for r in Q.limit_set_violations(limits, metrics).collect()}
    assert got == {("too few open limits", None), ("no blocking limit", "b")}
    files = spark.createDataFrame([("elsewhere/y.csv",)], "path string")
    assert [tuple(r) for r in Q.missing_evidence_files(limits, files).collect()] == [("3", "z.json")]


def test_anchors_with_an_index_lose_nothing(spark):
    """Against difflib on every span of every line, with long and short anchors."""
    import difflib
    import random

    rng, anchors = random.Random(2), ["Full name:", "No", "Place of permanent residence:", "Total", "Date of birth:"]
    lines = ["".join(rng.choice("abeflmnotu :") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    for a in anchors * 8:
        s = list(a.lower())
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("aeot ")
        lines.append(" " * rng.randint(0, 9) + "".join(s) + " value")
    table = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "page long, line long, text string")
    fields = spark.createDataFrame([("f", "text", anchors)], "field string, kind string, anchors array<string>")
    got = {(r["page"], r["anchor_ord"]): r["score"] for r in X.candidates(table, fields).collect()}
    want = {}
    for i, t in enumerate(lines):
        for k, a in enumerate(a.lower().rstrip(": ") for a in anchors):
            ratios = [difflib.SequenceMatcher(None, t[b : b + n], a).ratio() for b in range(min(8, len(t)) + 1) for n in range(max(3, len(a) - 2), max(3, len(a) + 2) + 1) if b + n <= len(t)]
            if max(ratios, default=0) >= 0.7:
                want[i, k] = max(ratios)
    assert got == want and len(want) > 25
    shares = X.span_shares(table, fields).agg(F.sum("n_scored"), F.sum("n_spans")).first()
    assert shares[0] < 0.5 * shares[1]


def test_manifest_in_parts(spark, tmp_path):
    rows = [(f"i{k}", f"{k}.jpg", "cccd", "heavy", k, ["blur"], [1, 2], {"ho_ten": f"n{k}", "ngay_sinh": None}) for k in range(50)]
    images = spark.createDataFrame(rows, "id string, file string, doc_type string, tier string, seed long, distortions array<string>, size array<int>, drawn map<string,string>")
    writers.manifest_parts(images, str(tmp_path), 7, "not real", part_images=10)
    got = {(r["id"], r["field"]): (r["tier"], r["seed"], r["value"]) for r in readers.manifest_parts(spark, str(tmp_path)).collect()}
    assert len(got) == 100 and got["i3", "ho_ten"] == ("heavy", 3, "n3") and got["i3", "ngay_sinh"] == ("heavy", 3, None)
    parts = sorted((tmp_path / "parts").glob("part=*/*.json"))
    assert len(parts) == 5 and all(len(json.loads(p.read_text())["anh"]) == json.loads(p.read_text())["so_anh"] for p in parts)
    whole = json.loads(parts[0].read_text())
    parts[0].write_text(json.dumps(whole | {"anh": whole["anh"][1:]}))
    for crc in parts[0].parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="of the manifest is not as it was written"):
        readers.manifest_parts(spark, str(tmp_path)).collect()


def test_logs_read_as_tables_and_streams(spark, tmp_path):
    lines = [
        "t | 1 | abc | 1.5 | eligible | 2 | 0 | -", "t | 2 | - | - | needs_supplement | 0 | 0 | missing: a | b", "t | 3 | abc | fast | eligible | 2 | 0 | -",
        "t | - | abc | 1.0 | eligible | 2 | 0 | -", "t | 4 | abc | 1.0 | fine | 2 | 0 | -", "", "no bars at all",
    ]
    writers.log(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), str(tmp_path), ("head",))
    got = {r["line"]: r for r in readers.log(spark, str(tmp_path)).collect()}
    assert [got[x]["problem"] for x in lines] == [None, None, "not a number", "no record", "unknown status", "columns missing", "columns missing"]
    assert (got[lines[1]]["id"], got[lines[1]]["sha256"], got[lines[1]]["reason"]) == ("2", None, "missing: a | b") and got[lines[2]]["id"] is None
    assert all(r["file"].endswith(".txt") for r in got.values())
    query = readers.log_stream(spark, str(tmp_path)).groupBy("problem").count().writeStream.format("memory").queryName("log_problems").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["problem"]: r["count"] for r in spark.table("log_problems").collect()} == {None: 2, "not a number": 1, "no record": 1, "unknown status": 1, "columns missing": 2}


def test_one_document_of_the_whole_score(spark):
    data = [(S.CORRECT, 0.9, "critical"), (S.WRONG, 0.95, "critical"), (S.MISSED, None, "medium"), (S.SYSTEM_ERROR, None, "medium"), (S.ABSTAIN_OK, None, "light")]
    full = points(spark, data).withColumns({"note": F.lit('said "no"'), "elapsed_ms": F.col("id").cast("double"), "type_ord": F.lit(0), "field_ord": F.lit(0)})
    doc = json.loads(writers.score_document(full, 0.8).first()["document"])
    assert doc["summary"]["n_infra"] == 1 and doc["gate"]["n_critical_leaks"] == 1 and doc["infra_errors"] == [{"id": 3, "field": "f", "note": 'said "no"'}]
    assert len(doc["sweep"]) == 21 and doc["by_tier"][0]["trust_score"] == pytest.approx(4 / 8.5) and doc["separation"] == {"auc": 0.0} and doc["grey"] == []
    empty = json.loads(writers.score_document(full.limit(0), 0.8).first()["document"])
    assert empty["n_scored"] == 0 and empty["summary"]["trust_score"] is None and empty["sweep"] == [] and empty["by_field"] == []


def test_boxes_are_decided_by_the_lead_that_is_not_rounded(spark, tmp_path):
    from trustgauge.plans.queries import top1_margin

    # lines of one word each: 0.70 and 0.68, whose lead is a little less than 0.02
    word = lambda turn, conf: "x" * next(n for n in range(1, 101) if (n * 13 + 7 + turn) % 100 == conf)
    spark.createDataFrame([(1, 0, "user", word(0, 70)), (1, 1, "user", word(1, 68))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = top1_margin(spark, str(tmp_path)).first()
    assert 0.7 - 0.68 < 0.02 and (got["score"], got["margin"], got["ticked"], got["confidence"]) == (0.7, 0.02, False, None)


def test_best_spans_are_those_of_every_span_with_few_calls_of_difflib(monkeypatch):
    import difflib
    import random

    import pandas as pd

    calls, ratio = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: calls.append(m.a) or ratio(m))
    rng, wants = random.Random(5), ["the thing", "no", "total", "place of permanent residence"]
    rows = [("".join(rng.choice("aehtoln g\0ä") for _ in range(rng.randint(0, 24))), rng.choice(wants)) for _ in range(300)]
    rows += [(" " * rng.randint(0, 9) + w[: rng.randint(1, len(w))] + rng.choice(["", ":", "x tail", w]), w) for w in wants * 30] + [(None, "no"), ("", "total")]
    lines, want = (pd.Series(x, dtype=object) for x in zip(*rows))
    best, counts, n_calls = X._best_spans(lines, want), X._span_counts(lines, want), len(calls)
    for (line, w), score, end, n_spans in zip(rows, best["score"], best["end"], counts["n_spans"], strict=True):
        line, sizes = line or "", range(max(3, len(w) - 2), max(3, len(w) + 2) + 1)
        spans = [(b, b + k) for b in range(9) for k in sizes if b + k <= len(line)]
        scores = [ratio(difflib.SequenceMatcher(None, line[b:e], w)) for b, e in spans]
        top = max(scores, default=0)
        assert n_spans == len(spans)
        assert (score, end) == ((top, spans[scores.index(top)][1]) if top >= 0.7 else (-1, 0))
    assert n_calls * 3 < counts["n_open"].sum()
