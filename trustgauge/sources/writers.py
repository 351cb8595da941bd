"""Writers: tables as files, and small documents assembled from aggregates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators.points import key
from trustgauge.sources import readers

#: Infrastructure errors that a score document names.
FIRST_ERRORS = 20


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which a cluster's machines share; where all runs on one machine and it is unset, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="files-")
        atexit.register(shutil.rmtree, top, True)
    return f"{top}/files-{uuid.uuid4().hex}"


def _file_name(names: dict[str, str], c: Column) -> Column:
    """The name that a value has in files."""
    return readers.renamed({v: k for k, v in names.items()}, c)


def labels(df: DataFrame, path: str) -> None:
    """Label records as JSON lines with the files' key names."""

    def field(f: Column) -> Column:
        kind = _file_name(readers.EXPECTATION_NAMES, f["expectation"])
        return F.struct(f["field"].alias("ten_truong"), f["label"].alias("gia_tri"), kind.alias("ky_vong"))

    tier = _file_name(readers.TIER_NAMES, F.col("tier"))
    out = df.select(F.col("id").cast("string").alias("id"), "doc_type", tier.alias("muc_chat_luong"), F.col("readable").alias("anh_doc_duoc"), F.transform("fields", field).alias("fields"))
    json_lines(out, path)


#: Images of a manifest part, about.
PART_IMAGES = 5000


def manifest_parts(images: DataFrame, path: str, seed: int, warning: str, part_images: int = PART_IMAGES) -> None:
    """A manifest of images (id, file, doc_type, tier, seed, distortions, size, drawn) as documents of the one-document form, each with a share of the images.

    Images are dealt to parts by a hash of their id, so no array grows with the data; an index has the number and a digest of
    the ids of every part.
    """
    tier = _file_name(readers.TIER_NAMES, F.col("tier"))
    image = F.struct(
        "id", F.col("file").alias("tep"), "doc_type", tier.alias("muc_chat_luong"), "seed", F.col("distortions").alias("bien_dang"), F.col("size").alias("kich_thuoc"), F.col("drawn").alias("noi_dung_da_ve")
    )
    n_parts = max(1, -(-images.count() // part_images))
    parts = images.select(F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), image.alias("i")).groupBy("part").agg(F.collect_list("i").alias("anh"))
    written = parts.select("part", F.lit(seed).alias("seed_goc"), F.lit(warning).alias("canh_bao"), F.size("anh").alias("so_anh"), "anh")
    written.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("part").json(f"{path}/parts")
    ids = F.array_join(F.array_sort(F.transform("anh", lambda i: i["id"])), "\n")
    parts.select("part", F.size("anh").alias("n_images"), F.sha2(ids, 256).alias("digest")).write.mode("overwrite").json(f"{path}/index")


def score_document(points: DataFrame, threshold: float) -> DataFrame:
    """One row with the whole score as one JSON document: summary, breakdowns, calibration, sweep, gate, times, and the first infrastructure errors.

    All of these have a row a tier, type, field, error, bin or threshold; single points grow with the data and are a table of
    their own. The points are held while the parts are made, so that they are made once.
    """
    from trustgauge.operators import calibration as C
    from trustgauge.operators import metrics as A
    from trustgauge.operators.points import scored

    points = points.persist()
    grey = points.where((F.col("expectation") == S.GREY) & (F.col("verdict") != S.SYSTEM_ERROR))
    broken = points.where(F.col("verdict") == S.SYSTEM_ERROR).orderBy("id", "field").limit(FIRST_ERRORS).select("id", "field", "note")
    parts = {
        "by_tier": A.score_by(points, "tier", "tier_ord"),
        "by_doc_type": A.score_by(points, "doc_type"),
        "by_field": A.by_field(points).join(A.error_map(points), ["doc_type", "field"], "left"),
        "errors": A.error_histogram(points),
        "calibration": C.bins(points),
        "sweep": C.threshold_sweep_suffix(points),
        "times": A.timing(points.select("id", "doc_type", "elapsed_ms").distinct(), "doc_type"),
        "infra_errors": broken,
        "grey": grey.groupBy("doc_type", "field", "verdict").agg(F.count(F.lit(1)).alias("n_points")),
    }
    singles = {"summary": A.headline(points), "silence": A.silent_kinds(points), "separation": C.auc(points), "ece": C.expected_error(points), "gate": C.review_gate(points, threshold)}
    one = scored(points).agg(F.count(F.lit(1)).alias("n_scored"), F.lit(threshold).alias("threshold"))
    for name, df in parts.items():
        rows = F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))
        one = one.crossJoin(df.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias(name)))  # one row each
    for name, df in singles.items():
        one = one.crossJoin(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name)))  # one row each
    pieces = [F.concat(F.lit(f'"{name}":'), F.col(name)) for name in (*singles, *parts)]
    head = F.concat(F.lit('"n_scored":'), F.col("n_scored").cast("string"), F.lit(',"threshold":'), F.col("threshold").cast("string"))
    return one.select(F.concat(F.lit("{"), F.concat_ws(",", head, *pieces), F.lit("}")).alias("document"))


def second_reads(df: DataFrame, path: str) -> None:
    """Second reads (id, field, legible, value) as CSV with the files' column names, in parts that each begin with the header."""
    flag = F.when(F.col("legible"), "1").otherwise("0")
    out = df.select("id", F.col("field").alias("ten_truong"), flag.alias("doc_duoc"), F.col("value").alias("gia_tri_doc_lai"), F.lit(None).cast("string").alias("ghi_chu"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def points(df: DataFrame, path: str) -> None:
    """Check points as Parquet, a folder a document type, so that later queries read only the types they ask for."""
    df.write.mode("overwrite").partitionBy("doc_type").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Results, ledgers, label records: one JSON object a line, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def log(lines: DataFrame, path: str, head: tuple[str, ...] = ()) -> None:
    """Log lines as text after a few head lines; order within a part only."""
    spark = lines.sparkSession
    if head:
        spark.createDataFrame([(h,) for h in head], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    lines.select("line").write.mode("overwrite").text(f"{path}/lines")


def snapshot(points_df: DataFrame, headline: DataFrame, leaks: DataFrame, fingerprint: DataFrame, stability: DataFrame | None, path: str) -> None:
    """A frozen run: its metrics, deviations and fingerprint as one small JSON row, its verdicts as Parquet rows.

    Verdicts grow with the data, so they aren't put into the one document.
    """
    from trustgauge.operators.gate import metric_rows

    metrics = metric_rows(headline).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    row = metrics.crossJoin(leaks.select(F.col("n_critical_leaks").alias("critical_leaks"))).crossJoin(fingerprint)  # one row each
    if stability is not None:
        row = row.crossJoin(stability.agg(F.map_from_entries(F.collect_list(F.struct("metric", "sigma"))).alias("sigma"), F.max("n_runs").alias("sigma_runs")))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/snapshot")
    points_df.select(key().alias("key"), "verdict").write.mode("overwrite").parquet(f"{path}/verdicts")


def known_failures(failing: DataFrame, path: str) -> None:
    """Failing points (key, code, verdict, error_type, label, model), sorted by key over the whole output."""
    failing.select("key", "code", "verdict", "error_type", "label", "model").orderBy("key").write.mode("overwrite").json(path)
