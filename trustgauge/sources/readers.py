"""Readers with explicit schemas: records as they lie on disk -> the library's names and values.

Bad rows fail a read instead of becoming nulls. A null that carries meaning stays null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators.points import duplicate_keys

# Key names of the files and the values of their closed sets.
LABEL_FILE = (
    "id string, tep string, doc_type string, muc_chat_luong string, anh_doc_duoc boolean, lay_mau_luot2 boolean, "
    "fields array<struct<ten_truong:string,gia_tri:string,ky_vong:string,nguon_nhan:string,gia_tri_luot2:string,ghi_chu_luot2:string>>"
)
MANIFEST_FILE = (
    "seed_goc long, so_anh long, anh array<struct<id:string,tep:string,doc_type:string,muc_chat_luong:string,seed:long,"
    "bien_dang:array<string>,kich_thuoc:array<int>,noi_dung_da_ve:map<string,string>>>"
)
READ_FILE = "id string, ten_truong string, doc_duoc string, gia_tri_doc_lai string, ghi_chu string"
SNAPSHOT_FILE = (
    "meta map<string,string>, dau_van_tay_du_lieu string, chi_so map<string,double>, so_ro_ri_nghiem_trong long, "
    "sigma map<string,double>, so_lan_do_sigma long, phan_quyet_tung_truong map<string,string>"
)
KNOWN_FILE = (
    "model string, phien_ban string, so_diem_kiem_hong long, theo_ma_loi map<string,long>, "
    "diem_kiem map<string,struct<loi:string,phan_quyet:string,loai_sai:string,nhan:string,model_tra:string>>"
)
LIMITS_FILE = (
    "gioi_han array<struct<ma:string,tieu_de:string,muc_do:string,chan_cac_chi_so:array<string>,khong_chung_minh_duoc:string,"
    "bang_chung_de_go:string,trang_thai:string,bang_chung_da_go:string,hau_qua_neu_bo_qua:string>>"
)
TIER_NAMES = {"sach": "clean", "nhe": "light", "trung_binh": "medium", "nang": "heavy", "khong_doc_duoc": "unreadable"}
EXPECTATION_NAMES = {"phai_trich_dung": S.MUST_EXTRACT, "phai_tu_choi": S.MUST_ABSTAIN, "vung_xam": S.GREY}
VERDICT_NAMES = {"DUNG": S.CORRECT, "SAI": S.WRONG, "BO_SOT": S.MISSED, "TU_CHOI_DUNG": S.ABSTAIN_OK, "BIA": S.FABRICATED, "LOI_HE_THONG": S.SYSTEM_ERROR}
ERROR_NAMES = {
    "sai_dau": "diacritics",
    "sai_1_ky_tu": "one_character",
    "thieu_hoac_thua_phan": "part_missing_or_added",
    "sai_vai_ky_tu": "some_characters",
    "sai_hoan_toan": "all_wrong",
    "sai_do_dai": "wrong_length",
    "sai_1_chu_so": "one_digit",
    "sai_nhieu_chu_so": "many_digits",
    "sai_so_chu_so": "wrong_digit_count",
    "khong_phai_so": "not_a_number",
    "khong_phai_ngay": "not_a_date",
    "sai_gia_tri_ngay": "wrong_date",
    "lech_lam_tron": "rounding",
    "sai_bac_don_vi": "unit_scale",
    "sai_gia_tri_so": "wrong_value",
    "lech_qua_nguong": "beyond_threshold",
    "ngoai_tap_gia_tri": "outside_options",
    "chon_sai_o": "wrong_option",
    "im_lang_tren_anh_doc_duoc": "silent_on_readable",
    "bia_tren_anh_khong_doc_duoc": "fabricated_on_unreadable",
    "loi_goi_model": "call_failed",
}
METRIC_NAMES = {
    "diem_tin_cay": "trust_score",
    "accuracy_truong_doc_duoc": "accuracy_readable",
    "accuracy_truong_nghiem_trong": "critical_accuracy",
    "ac3_ty_le_tu_choi_dung": "abstain_ok_rate",
    "ac3_ty_le_bia": "fabricated_rate",
}
LEVEL_NAMES = {"chan_ket_luan": "blocks_conclusion", "thu_hep": "narrows", "canh_bao": "note"}
STATUS_NAMES = {"mo": "open", "da_go": "resolved"}


def renamed(names: dict[str, str], c: Column) -> Column:
    """A value's name in the library; unknown ones stay."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), c)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of label records; blank lines are skipped, a broken line fails."""
    raw = spark.read.schema(LABEL_FILE).option("mode", "FAILFAST").json(path)
    field = lambda f: F.struct(
        f["ten_truong"].alias("field"), f["gia_tri"].alias("label"), renamed(EXPECTATION_NAMES, f["ky_vong"]).alias("expectation"),
        f["nguon_nhan"].alias("label_source"), f["gia_tri_luot2"].alias("second_read"), f["ghi_chu_luot2"].alias("second_note"),
    )
    return raw.select(
        "id", F.col("tep").alias("path"), "doc_type", renamed(TIER_NAMES, F.col("muc_chat_luong")).alias("tier"), F.col("anh_doc_duoc").alias("readable"),
        F.col("lay_mau_luot2").alias("sampled"), F.transform("fields", field).alias("fields"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an image and field drawn on it: id, doc_type, tier, seed, field, value."""
    raw = spark.read.schema(MANIFEST_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    images = raw.select(F.explode("anh").alias("i"))
    rows = images.select("i.id", "i.doc_type", renamed(TIER_NAMES, F.col("i.muc_chat_luong")).alias("tier"), "i.seed", F.explode("i.noi_dung_da_ve").alias("field", "value"))
    return rows


def manifest_parts(spark: SparkSession, path: str) -> DataFrame:
    """The same from a manifest in parts (``writers.manifest_parts``). A part that doesn't hold what the index says of it raises, also if it is gone."""
    raw = spark.read.schema(MANIFEST_FILE + ", part int").option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/parts")
    index = spark.read.schema("part int, n_images long, digest string").json(f"{path}/index")
    ids = F.array_join(F.array_sort(F.transform("anh", lambda i: i["id"])), "\n")
    held = raw.select("part", "anh", F.size("anh").cast("long").alias("n"), F.sha2(ids, 256).alias("d"))
    joined = index.join(held, "part", "left")
    whole = F.coalesce((F.col("n") == F.col("n_images")) & (F.col("d") == F.col("digest")), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("part "), F.col("part").cast("string"), F.lit(" of the manifest is not as it was written"))).cast(raw.schema["anh"].dataType)
    images = joined.select(F.explode(F.when(whole, F.col("anh")).otherwise(broken)).alias("i"))
    return images.select("i.id", "i.doc_type", renamed(TIER_NAMES, F.col("i.muc_chat_luong")).alias("tier"), "i.seed", F.explode("i.noi_dung_da_ve").alias("field", "value"))


#: Columns of a log line and what stands between them.
LOG_COLUMNS = ("run_at", "id", "sha256", "elapsed_ms", "dossier_status", "n_fields", "n_flagged", "reason")
LOG_BAR = " | "


def parsed_log(lines: DataFrame) -> DataFrame:
    """Log lines (line, and whatever else) with their columns, a dash as null, and ``problem``, null for a good line; of a bad line no column is trusted.

    The reason comes last and may hold bars of its own.
    """
    parts = F.split("line", " \\| ", len(LOG_COLUMNS))
    text = {c: F.nullif(F.get("_parts", F.lit(i)), F.lit("-")) for i, c in enumerate(LOG_COLUMNS)}
    typed = text | {"elapsed_ms": text["elapsed_ms"].try_cast("double")} | {c: text[c].try_cast("long") for c in ("n_fields", "n_flagged")}
    odd = lambda c: text[c].isNotNull() & typed[c].isNull()
    problem = (
        F.when(F.size("_parts") < len(LOG_COLUMNS), "columns missing")
        .when(odd("elapsed_ms") | odd("n_fields") | odd("n_flagged"), "not a number")
        .when(text["id"].isNull(), "no record")
        .when(~F.coalesce(text["dossier_status"].isin(S.ELIGIBLE, S.NEEDS_SUPPLEMENT), F.lit(False)), "unknown status")
    )
    out = lines.withColumn("_parts", parts).withColumn("problem", problem)
    return out.withColumns({c: F.when(F.col("problem").isNull(), v) for c, v in typed.items()}).drop("_parts")


def log(spark: SparkSession, path: str) -> DataFrame:
    """A worker log as a table; lines that can't be read stay as rows, with the file they stand in and their problem."""
    return parsed_log(spark.read.text(f"{path}/lines").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files that are added to the log's folder are read once each."""
    return parsed_log(spark.readStream.text(f"{path}/lines").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")))


def second_reads(spark: SparkSession, path: str) -> DataFrame:
    """CSV with # comments; rows without an id are skipped and a key that occurs twice fails the load."""
    raw = spark.read.schema(READ_FILE).option("header", True).option("comment", "#").option("quote", '"').option("mode", "FAILFAST").csv(path)
    rows = raw.where(F.trim(F.coalesce("id", F.lit(""))) != "").select(
        "id", F.col("ten_truong").alias("field"), (F.trim("doc_duoc") == "1").alias("legible"),
        F.trim(F.coalesce("gia_tri_doc_lai", F.lit(""))).alias("value"), F.trim(F.coalesce("ghi_chu", F.lit(""))).alias("note"),
    )
    twice = [f"{r['id']}.{r['field']}" for r in duplicate_keys(rows, "id", "field").orderBy("id", "field").limit(10).collect()]
    if twice:
        raise ValueError(f"{path}: these keys are read twice: {', '.join(twice)}")
    return rows


@dataclass(frozen=True)
class Config:
    review_threshold: float
    trust_score_least: float
    critical_accuracy_least: float
    fabricated_rate_most: float
    critical_leaks_most: int
    tolerance: float

    def limits(self) -> dict:
        return {k: getattr(self, k) for k in ("trust_score_least", "critical_accuracy_least", "fabricated_rate_most", "critical_leaks_most", "tolerance")}


def config(spark: SparkSession, path: str) -> Config:
    """A small JSON file of limits, read by Spark so that any store will do."""
    raw = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    gate = raw["cong_chat_luong"]
    return Config(
        raw["nguong_hitl"], gate["diem_tin_cay_toi_thieu"], gate["accuracy_truong_nghiem_trong_toi_thieu"], gate["ac3_ty_le_bia_toi_da"],
        gate["so_ro_ri_nghiem_trong_toi_da"], gate["bien_do_tut_cho_phep"],
    )


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The frozen run, None if there is none yet: a legal state."""
    if not exists(spark, path):
        return None
    raw = spark.read.schema(SNAPSHOT_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    named = lambda c: F.transform_keys(c, lambda k, _: renamed(METRIC_NAMES, k))
    verdicts = F.transform_values("phan_quyet_tung_truong", lambda _, v: renamed(VERDICT_NAMES, v))
    return raw.select(
        "meta", F.col("dau_van_tay_du_lieu").alias("fingerprint"), named("chi_so").alias("metrics"), F.col("so_ro_ri_nghiem_trong").alias("critical_leaks"),
        named("sigma").alias("sigma"), F.col("so_lan_do_sigma").alias("sigma_runs"), verdicts.alias("verdicts"),
    )


def snapshot_verdicts(snap: DataFrame) -> DataFrame:
    return snap.select(F.explode("verdicts").alias("key", "verdict"))


def snapshot_metrics(snap: DataFrame, of: str = "metrics") -> DataFrame:
    return snap.select(F.explode(of).alias("metric", "value" if of == "metrics" else of))


def known_failures(spark: SparkSession, path: str) -> DataFrame:
    """(key, code, verdict, error_type, label, model) of the ledger, empty if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, code string, verdict string, error_type string, label string, model string")
    raw = spark.read.schema(KNOWN_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.select(F.explode("diem_kiem").alias("key", "v"))
    return rows.select(
        "key", F.col("v.loi").alias("code"), renamed(VERDICT_NAMES, F.col("v.phan_quyet")).alias("verdict"), renamed(ERROR_NAMES, F.col("v.loai_sai")).alias("error_type"),
        F.col("v.nhan").alias("label"), F.col("v.model_tra").alias("model"),
    )


def limits(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(LIMITS_FILE).option("multiLine", True).json(path)
    g = raw.select(F.explode("gioi_han").alias("g"))
    return g.select(
        F.col("g.ma").alias("code"), F.col("g.tieu_de").alias("title"), renamed(LEVEL_NAMES, F.col("g.muc_do")).alias("level"), F.col("g.chan_cac_chi_so").alias("covers"),
        F.col("g.khong_chung_minh_duoc").alias("unproved"), F.col("g.bang_chung_de_go").alias("evidence_needed"), renamed(STATUS_NAMES, F.col("g.trang_thai")).alias("status"),
        F.col("g.bang_chung_da_go").alias("evidence"), F.col("g.hau_qua_neu_bo_qua").alias("consequence"),
    )


def files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """(path, sha256, n_bytes) of binary files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """Check points that ``writers.points`` stored."""
    return spark.read.parquet(path)
