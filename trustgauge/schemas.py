"""Explicit schemas, closed value sets and the field dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECT, WRONG, MISSED = "CORRECT", "WRONG", "MISSED"
ABSTAIN_OK, FABRICATED, SYSTEM_ERROR = "ABSTAIN_OK", "FABRICATED", "SYSTEM_ERROR"
VERDICTS = (CORRECT, WRONG, MISSED, ABSTAIN_OK, FABRICATED, SYSTEM_ERROR)
GOOD = (CORRECT, ABSTAIN_OK)

MUST_EXTRACT, MUST_ABSTAIN, GREY = "must_extract", "must_abstain", "grey"
SOURCES = ("ocr", "cross_validate", "human", "barcode", "registry", "default")
WEIGHTS = {"critical": 3.0, "medium": 1.5, "light": 1.0}
TIERS = ("clean", "light", "medium", "heavy", "unreadable")
NEEDS_SUPPLEMENT, ELIGIBLE = "needs_supplement", "eligible"
LIMIT_LEVELS = ("blocks_conclusion", "narrows", "note")

#: Upper ends of the confidence bins; the last lies above 1 so that 1.0 is inside.
CONFIDENCE_EDGES = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)
SWEEP_STEPS = 20


@dataclass(frozen=True)
class Field:
    doc_type: str
    name: str
    title: str
    severity: str
    kind: str
    anchors: tuple[str, ...] = ()
    options: tuple[str, ...] = ()


# The two document types, their fields, printed anchors and options.
FIELDS = (
    Field("cccd", "so_dinh_danh", "Số định danh", "critical", "id", ("Số:", "So:")),
    Field("cccd", "ho_ten", "Họ và tên", "critical", "name", ("Họ và tên:", "Ho va ten:")),
    Field("cccd", "ngay_sinh", "Ngày sinh", "medium", "date", ("Ngày sinh:", "Ngay sinh:")),
    Field("cccd", "noi_thuong_tru", "Nơi thường trú", "medium", "address", ("Nơi thường trú:", "Noi thuong tru:")),
    Field("mau_01", "ho_ten_nguoi_viet_don", "Họ tên người viết đơn", "critical", "name", ("Họ và tên người viết đơn:", "Ho va ten nguoi viet don:")),
    Field("mau_01", "hinh_thuc", "Hình thức đăng ký", "medium", "enum", ("Hình thức đăng ký:",), ("mua", "thuê", "thuê mua")),
    Field("mau_01", "dien_tich_binh_quan", "Diện tích bình quân (m²/người)", "medium", "quantity", ("Diện tích bình quân:", "Dien tich binh quan:")),
    Field("mau_01", "thu_nhap_hang_thang", "Thu nhập hàng tháng (đồng)", "medium", "money", ("Thu nhập hàng tháng:", "Thu nhap hang thang:")),
)

#: Document types by the prefix of an identifier, and that of all others.
ID_PREFIXES, OTHER_TYPE = {"cccd": "cccd"}, "mau_01"

LABELS = (
    "id string, path string, doc_type string, tier string, readable boolean, sampled boolean, "
    "fields array<struct<field:string,label:string,expectation:string,label_source:string,second_read:string,second_note:string>>"
)
RESULTS = (
    "id string, doc_type string, elapsed_ms double, error string, abstain_reason string, no_anchor boolean, "
    "fields array<struct<field:string,value:string,confidence:double,source:string>>"
)
MANIFEST = (
    "seed long, images array<struct<id:string,path:string,doc_type:string,tier:string,seed:long,degradations:array<string>,size:array<int>,drawn:map<string,string>>>"
)
SECOND_READ = ("id string, field string, legible string, value string, note string")
SNAPSHOT = (
    "meta map<string,string>, fingerprint string, metrics map<string,double>, critical_leaks long, "
    "sigma map<string,double>, sigma_runs long, verdicts map<string,string>"
)
KNOWN_FAILURES = (
    "model string, version string, n_failing long, by_code map<string,long>, "
    "points map<string,struct<code:string,verdict:string,error_type:string,label:string,model:string>>"
)
LIMITS = (
    "limits array<struct<code:string,title:string,level:string,covers:array<string>,unproved:string,evidence_needed:string,"
    "status:string,evidence:string,consequence:string>>"
)


def field_dimension(spark: SparkSession, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """One row a field: doc_type, type_ord, field, field_ord, title, severity, weight, kind, anchors, options."""
    types = list(dict.fromkeys(f.doc_type for f in fields))
    rows = [
        (f.doc_type, types.index(f.doc_type), f.name, i, f.title, f.severity, WEIGHTS[f.severity], f.kind, list(f.anchors), list(f.options))
        for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(
        rows,
        "doc_type string, type_ord int, field string, field_ord int, title string, severity string, weight double, kind string, anchors array<string>, options array<string>",
    )


def tier_ordinal(tier):
    """Place of a tier in TIERS, from 0; null for another value."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    return F.when(at > 0, (at - 1).cast("int"))
