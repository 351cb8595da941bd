"""Deterministic relations over the driver's tables, by arithmetic on keys only.

R1: documents and labels as a run of an extractor over two fields. R2: pairs of a label and a
reading by field type. R3: three runs of R1. R4: conversations as pages of words. R5: events as timings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgauge import schemas as S
from trustgauge.operators import points as P

R1_FIELDS = (
    S.Field("en", "quality", "Quality", "critical", "exact"),
    S.Field("en", "toxic", "Toxic", "medium", "exact"),
)
THRESHOLD = 0.80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension(spark: SparkSession) -> DataFrame:
    """The two R1 fields for each of the four languages that stand for document types."""
    fields = tuple(S.Field(lang, f.name, f.title, f.severity, f.kind) for lang in ("de", "en", "es", "fr") for f in R1_FIELDS)
    return S.field_dimension(spark, fields)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"), "quality", "toxic")
    out = docs.join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    n = F.col("n_chars")
    tier = F.when(n < 300, "clean").when(n < 800, "light").when(n < 1300, "medium").when(n < 2000, "heavy").otherwise("unreadable")
    return out.withColumn("tier", tier)


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 labels: id, doc_type, tier, readable, fields."""
    b = _base(spark, sf_dir)
    kind = F.when(~F.col("labelled"), S.MUST_ABSTAIN).when(F.col("doc_id") % 29 == 0, S.GREY).otherwise(S.MUST_EXTRACT)
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("label"), kind.alias("expectation"))
    fields = F.array(*(field(f.name) for f in R1_FIELDS))
    return b.select(F.col("doc_id").alias("id"), F.col("lang").alias("doc_type"), "tier", F.col("labelled").alias("readable"), fields.alias("fields"))


def _value(run, i: int):
    """run: a number or a column."""
    run_part = F.when(F.col("doc_id") % 11 == 0, run if isinstance(run, Column) else F.lit(run)).otherwise(F.lit(0))
    silent = ((F.col("doc_id") * 7 + F.col("n_chars") + i * 3 + run_part) % 5 == 0) | (~F.col("labelled") & (F.col("n_chars") % 8 != 0))
    return F.when(~silent, F.when((F.col("doc_id") + F.col("n_chars") + i) % 4 == 0, "0").otherwise("1"))


def result_records(spark: SparkSession, sf_dir: str, run: int = 0, n_runs: int = 0) -> DataFrame:
    """R1 results: every 97th document failed, half of those without leaving a result. R3 with ``n_runs``: those of all runs, with ``run``."""
    b = _base(spark, sf_dir).where(F.col("doc_id") % 194 != 0)
    keys = ["run"] if n_runs else []
    if n_runs:
        b, run = P.of_runs(b, n_runs), F.col("run")
    failed = F.col("doc_id") % 97 == 0

    def field(i: int, name: str):
        conf = ((F.col("doc_id") * 37 + F.col("n_chars") * 11 + i * 17) % 101) / 100
        source = F.when((F.col("doc_id") + i) % 3 == 0, "cross_validate").otherwise("ocr")
        return F.struct(F.lit(name).alias("field"), _value(run, i).alias("value"), conf.alias("confidence"), source.alias("source"))

    given = F.filter(F.array(*(field(i, f.name) for i, f in enumerate(R1_FIELDS))), lambda f: f["value"].isNotNull())
    none = F.size(given) == 0
    return b.select(
        *keys,
        F.col("doc_id").alias("id"),
        F.col("lang").alias("doc_type"),
        F.when(~failed, (F.col("doc_id") % 1000 + F.col("n_chars") / 10)).alias("elapsed_ms"),
        F.when(failed, "call failed").alias("error"),
        F.when(~failed & none & (F.col("n_chars") % 2 == 0), F.concat(F.lit("unreadable: "), F.col("n_chars").cast("string"), F.lit(" characters"))).alias("abstain_reason"),
        (~failed & none & (F.col("n_chars") % 2 == 1)).alias("no_anchor"),
        F.when(failed, F.array().cast(given_type())).otherwise(given).alias("fields"),
    )


def given_type() -> str:
    return "array<struct<field:string,value:string,confidence:double,source:string>>"


def check_points(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    return P.check_points(label_records(spark, sf_dir), result_records(spark, sf_dir, run), dimension(spark), kinds=("exact",), similarity=False)


def check_points_of_runs(spark: SparkSession, sf_dir: str, n_runs: int = 3) -> DataFrame:
    """R3: the check points of all runs in one table."""
    return P.check_points_of_runs(label_records(spark, sf_dir), result_records(spark, sf_dir, n_runs=n_runs), dimension(spark), n_runs, kinds=("exact",), similarity=False)


#: The check points of R1 in DuckDB SQL, as the common table ``pts``; {run} is the run's number.
POINTS_SQL = """
base AS (
  SELECT d.doc_id AS id, d.lang AS doc_type, d.n_chars, l.doc_id IS NOT NULL AS labelled, l.quality, l.toxic, d.doc_id % 97 = 0 AS infra,
         CASE WHEN n_chars < 300 THEN 0 WHEN n_chars < 800 THEN 1 WHEN n_chars < 1300 THEN 2 WHEN n_chars < 2000 THEN 3 ELSE 4 END AS tier_ord
  FROM documents d LEFT JOIN labels l USING (doc_id)),
cells AS (
  SELECT b.*, ['clean', 'light', 'medium', 'heavy', 'unreadable'][tier_ord + 1] AS tier, i,
         CASE i WHEN 0 THEN 'quality' ELSE 'toxic' END AS field, CASE i WHEN 0 THEN 'critical' ELSE 'medium' END AS severity,
         CASE i WHEN 0 THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END AS weight,
         CASE WHEN NOT labelled THEN 'must_abstain' WHEN id % 29 = 0 THEN 'grey' ELSE 'must_extract' END AS expectation,
         CASE i WHEN 0 THEN quality ELSE toxic END::VARCHAR AS label,
         CASE WHEN infra OR (id * 7 + n_chars + i * 3 + CASE WHEN id % 11 = 0 THEN {run} ELSE 0 END) % 5 = 0 OR (NOT labelled AND n_chars % 8 <> 0) THEN NULL
              WHEN (id + n_chars + i) % 4 = 0 THEN '0' ELSE '1' END AS model
  FROM base b, (SELECT unnest([0, 1]) AS i)),
pts AS (
  SELECT *, CASE WHEN model IS NOT NULL THEN ((id * 37 + n_chars * 11 + i * 17) % 101) / 100.0::DOUBLE END AS confidence,
         CASE WHEN model IS NOT NULL THEN CASE WHEN (id + i) % 3 = 0 THEN 'cross_validate' ELSE 'ocr' END END AS source,
         CASE WHEN infra THEN 'SYSTEM_ERROR' WHEN label IS NULL AND model IS NULL THEN 'ABSTAIN_OK' WHEN label IS NULL THEN 'FABRICATED'
              WHEN model IS NULL THEN 'MISSED' WHEN label = model THEN 'CORRECT' ELSE 'WRONG' END AS verdict,
         CASE WHEN infra THEN 'call_failed' WHEN label IS NULL AND model IS NULL THEN NULL WHEN label IS NULL THEN 'fabricated_on_unreadable'
              WHEN model IS NULL THEN 'silent_on_readable' WHEN label = model THEN NULL ELSE 'wrong_value' END AS error_type,
         count(model) OVER (PARTITION BY id) AS n_given,
         CASE WHEN NOT infra THEN id % 1000 + n_chars / 10.0::DOUBLE END AS elapsed_ms
  FROM cells),
full_pts AS (
  SELECT *, NOT infra AND n_given = 0 AND n_chars % 2 = 1 AS no_anchor,
         CASE WHEN NOT infra AND n_given = 0 AND n_chars % 2 = 0 THEN 'unreadable: ' || n_chars || ' characters' END AS abstain_reason FROM pts),
scored AS (SELECT * FROM full_pts WHERE NOT infra AND expectation <> 'grey'),
dossier AS (
  SELECT id, doc_type, tier, labelled AS readable, infra, any_value(abstain_reason) AS abstain_reason, any_value(n_given) AS n_given,
         bool_or(i = 0 AND model IS NOT NULL) AS has_critical, count_if(model IS NOT NULL AND confidence < 0.8) AS n_flagged
  FROM full_pts GROUP BY ALL),
ledger AS (
  SELECT *, CASE WHEN id % 194 = 0 THEN 'no result for this record' WHEN infra THEN 'cannot process: call failed' WHEN abstain_reason IS NOT NULL THEN abstain_reason
                 WHEN n_given = 0 THEN 'text read but no field found' WHEN NOT has_critical THEN 'missing critical: quality' END AS reason
  FROM dossier)
"""


def points_sql(select: str, run: int = 0) -> str:
    return "WITH " + POINTS_SQL.replace("{run}", str(run)).strip() + "\n" + select


#: Metrics that a limit may cover; four of nine cover none.
COVERED = ("trust_score", "accuracy_readable", "abstain_ok_rate", "ece", "auc")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7: a limit a supplier, with texts of all lengths."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    level = F.get(F.array(*map(F.lit, (*S.LIMIT_LEVELS, "severe"))), (k % 4).cast("int"))
    metric = F.get(F.array(*map(F.lit, COVERED)), (n % 9).cast("int"))
    evidence = F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("see data/"), "s_name", F.lit(".csv "), F.repeat(F.lit("x"), (n * 2).cast("int")))).otherwise(F.lit("none at all")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L-"), k.cast("string")).alias("code"),
        level.alias("level"),
        F.array_compact(F.array(metric)).alias("covers"),
        F.repeat("s_name", (k % 5).cast("int")).alias("unproved"),
        F.repeat(F.lit("e"), (k % 10 + 25).cast("int")).alias("evidence_needed"),
        F.when(k % 3 == 0, "resolved").otherwise("open").alias("status"),
        evidence.alias("evidence"),
        F.when(F.col("s_acctbal") > 0, "c").otherwise(" ").alias("consequence"),
    )


#: R7 in DuckDB SQL, as the common table ``lim``.
LIMITS_SQL = f"""
lim AS (SELECT 'L-' || s_suppkey AS code, ['blocks_conclusion', 'narrows', 'note', 'severe'][s_suppkey % 4 + 1] AS level, {list(COVERED)}[s_nationkey % 9 + 1] AS metric,
  repeat(s_name, s_suppkey % 5) AS unproved, repeat('e', s_suppkey % 10 + 25) AS evidence_needed, CASE WHEN s_suppkey % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
  CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'see data/' || s_name || '.csv ' || repeat('x', s_nationkey * 2) ELSE 'none at all' END END AS evidence,
  CASE WHEN s_acctbal > 0 THEN 'c' ELSE ' ' END AS consequence FROM supplier)
"""


PAGE_FIELDS = (
    S.Field("page", "page_title", "Title", "critical", "exact"),
    S.Field("page", "page_heading", "Heading", "medium", "exact"),
    S.Field("page", "page_language", "Language", "light", "exact"),
)


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6: pages as records of one document type; every 50th has no page, so that its call fails, every 70th an empty one."""
    html = F.when(F.col("page_id") % 50 == 0, None).when(F.col("page_id") % 70 == 0, " ").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("doc_type"), html.alias("html"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 labels: the language that the address names, the title and heading by their tags; every ninth title as if it had a last character more."""
    html, readable = F.col("html"), F.col("page_id") % 70 != 0
    plain = lambda c: F.trim(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    title = plain(F.regexp_extract(html, "<title>([^<]*)</title>", 1))
    values = {
        "page_title": F.when(F.col("page_id") % 9 == 0, F.concat(title, F.lit("x"))).otherwise(title),
        "page_heading": plain(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)),
        "page_language": F.regexp_extract("url", "^[^/]*//[^/]*/([a-z]{2})/", 1),
    }
    kind = F.when(readable, S.MUST_EXTRACT).otherwise(S.MUST_ABSTAIN)
    cell = lambda n: F.struct(F.lit(n).alias("field"), F.when(readable, F.nullif(values[n], F.lit(""))).alias("label"), kind.alias("expectation"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("doc_type"), F.lit("clean").alias("tier"), readable.alias("readable"), F.array(*(cell(f.name) for f in PAGE_FIELDS)).alias("fields")
    )


def page_points(spark: SparkSession, sf_dir: str, extractor) -> DataFrame:
    """The check points of a run of an extractor over the pages."""
    fields = S.field_dimension(spark, PAGE_FIELDS)
    return P.check_points(page_labels(spark, sf_dir), extractor.extract(page_records(spark, sf_dir)), fields, ("exact",), similarity=False)


#: R6 in DuckDB SQL, as the common tables ``read`` (what markup gives) and ``page_pts``.
PAGES_SQL = r"""
p AS (SELECT page_id AS id, url, html, page_id % 50 = 0 AS infra, page_id % 50 <> 0 AND page_id % 70 = 0 AS blank, page_id % 70 <> 0 AS readable,
       trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
       trim(regexp_replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS heading,
       regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages),
read AS (SELECT id, unnest(['page_title', 'page_heading', 'page_language']) AS field, unnest([title, heading, lang]) AS value,
       unnest([CASE WHEN title = heading THEN 0.95 ELSE 0.6 END, CASE WHEN title = heading THEN 0.95 ELSE 0.6 END, 0.9]::DOUBLE[]) AS confidence FROM p WHERE NOT infra AND NOT blank),
cell AS (SELECT id, infra, readable, unnest(['page_title', 'page_heading', 'page_language']) AS field, unnest([3.0, 1.5, 1.0]::DOUBLE[]) AS weight,
       unnest([CASE WHEN id % 9 = 0 THEN title || 'x' ELSE title END, heading, regexp_extract(url, '^[^/]*//[^/]*/([a-z]{2})/', 1)]) AS label FROM p),
page_pts AS (SELECT cell.*, value, confidence, CASE WHEN infra THEN 'SYSTEM_ERROR'
       WHEN NOT readable THEN CASE WHEN value IS NULL THEN 'ABSTAIN_OK' ELSE 'FABRICATED' END WHEN label = '' THEN CASE WHEN nullif(value, '') IS NULL THEN 'ABSTAIN_OK' ELSE 'FABRICATED' END
       WHEN nullif(value, '') IS NULL THEN 'MISSED' WHEN label = value THEN 'CORRECT' ELSE 'WRONG' END AS verdict FROM cell LEFT JOIN read USING (id, field))
"""


def pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """R2: (id, label, model) of one field type."""
    return {"id": _ids, "date": _dates, "money": _money, "quantity": _quantity, "enum": _enum, "name": _names, "address": _addresses}[kind](spark, sf_dir)


def _case(key, *values):
    out = values[-1]
    for i in reversed(range(len(values) - 1)):
        out = F.when(key == i, values[i]).otherwise(out)
    return out


def _ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 10, 100).alias("label"))
    x = F.col("label")
    last = F.concat(F.expr("substring(label, 1, length(label) - 1)"), F.when(F.expr("right(label, 1) = '7'"), "1").otherwise("7"))
    spaced = F.concat(F.expr("substring(label, 1, 4)"), F.lit(" "), F.expr("substring(label, 5)"))
    return c.withColumn("model", _case(F.col("id") % 5, x, F.expr("substring(label, 2)"), last, spaced, F.lit(None).cast("string")))


IDS_SQL = """
SELECT c_custkey AS id, substring(c_name, 10) AS label,
  CASE c_custkey % 5 WHEN 0 THEN substring(c_name, 10) WHEN 1 THEN substring(c_name, 11)
    WHEN 2 THEN left(substring(c_name, 10), -1) || CASE WHEN right(c_name, 1) = '7' THEN '1' ELSE '7' END
    WHEN 3 THEN substring(c_name, 10, 4) || ' ' || substring(c_name, 14) END AS model
FROM customer"""


def _dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    forms = [F.date_format("d", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d/M/yyyy")]
    return o.select("id", F.date_format("d", "dd/MM/yyyy").alias("label"), _case(F.col("id") % 3, *forms).alias("model"))


DATES_SQL = """
SELECT o_orderkey AS id, strftime(o_orderdate, '%d/%m/%Y') AS label,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
    ELSE day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) END AS model
FROM orders"""


def _money(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    plain = F.col("v").cast("string")
    grouped = F.regexp_replace(plain, r"(\d)(?=(\d{3})+$)", "$1.")
    changed = F.concat(F.expr("substring(cast(v as string), 1, length(cast(v as string)) - 1)"), ((F.col("v") % 10 + 1) % 10).cast("string"))
    short = F.expr("substring(cast(v as string), 1, length(cast(v as string)) - 1)")
    return x.select(
        "id", F.concat(grouped, F.lit(" đồng")).alias("label"),
        _case(F.col("v") % 6, plain, F.translate(grouped, ".", " "), changed, short, F.lit("abc"), grouped).alias("model"),
    )


MONEY_SQL = r"""
SELECT id, reverse(regexp_replace(reverse(p), '(\d{3})(\d)', '\1.\2', 'g')) AS g0, p, v FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, floor(l_extendedprice * 100)::BIGINT AS v, floor(l_extendedprice * 100)::BIGINT::VARCHAR AS p FROM lineitem)"""


def _quantity(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("int").alias("q"))
    q = F.col("q").cast("string")
    return x.select(
        "id", F.concat(q, F.lit(",5 m²")).alias("label"),
        _case(F.col("id") % 6, F.concat(q, F.lit(".5")), F.concat(q, F.lit(",5 m2")), F.concat(q, F.lit("5")), F.concat(q, F.lit("500")), F.lit("m²"), q).alias("model"),
    )


QUANTITY_SQL = """
SELECT id, q + 0.5::DOUBLE AS a,
  CASE id % 6 WHEN 0 THEN q + 0.5 WHEN 1 THEN q + 0.5 WHEN 2 THEN q * 10 + 5 WHEN 3 THEN q * 1000 + 500 WHEN 4 THEN NULL ELSE q END::DOUBLE AS b
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::INT AS q FROM lineitem)"""


def _enum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    label = F.when(F.col("s") == "P", "mua").when(F.col("s") == "O", "thuê").otherwise("thuê mua")
    return o.select("id", label.alias("label"), _case(F.col("id") % 5, F.initcap(label), F.concat(F.lit("  "), F.upper(label), F.lit(".")), F.lit("thue  mua"), F.lit("bán"), label).alias("model"))


ENUM_SQL = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'mua' WHEN 'O' THEN 'thuê' ELSE 'thuê mua' END AS a,
  CASE o_orderkey % 5 WHEN 2 THEN 'thuê mua' WHEN 3 THEN NULL ELSE CASE o_orderstatus WHEN 'P' THEN 'mua' WHEN 'O' THEN 'thuê' ELSE 'thuê mua' END END AS b
FROM orders"""


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    marked = F.translate("label", "aeiou", "áéíóú")
    return p.withColumn(
        "model",
        _case(F.col("id") % 5, F.upper("label"), F.concat(F.lit(" "), F.regexp_replace("label", " ", ",  "), F.lit(".")), marked, F.expr("substring(label, 1, length(label) - 2)"), F.concat(F.lit("#"), F.expr("substring(label, 2)"))),
    )


NAMES_SQL = """
SELECT p_partkey AS id, p_name AS label,
  CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || replace(p_name, ' ', ',  ') || '.' WHEN 2 THEN translate(p_name, 'aeiou', 'áéíóú')
    WHEN 3 THEN left(p_name, -2) ELSE '#' || substring(p_name, 2) END AS model
FROM part"""


def _addresses(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(", ", F.lit("Thành phố"), "p_name", "p_type").alias("label"))
    return p.withColumn("model", _case(F.col("id") % 3, F.regexp_replace("label", "Thành phố", "TP"), F.expr("substring(label, 1, length(label) div 2)"), F.col("label")))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4: a conversation is a page; words of its turns in lines of eight."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("p", "word"))
    pos = F.col("p") + 1
    return c.select(
        "page",
        (F.col("turn") * 1000 + F.floor((pos - 1) / 8)).cast("long").alias("line"),
        pos.cast("long").alias("pos"),
        "word",
        ((F.length("word") * 13 + pos * 7 + F.col("turn")) % 100).cast("double").alias("conf"),
    )


WORDS_SQL = """
w0 AS (
  SELECT conv_id AS page, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations),
w AS (
  SELECT page, turn * 1000 + (pos - 1) // 8 AS line, pos, word, ((length(word) * 13 + pos * 7 + turn) % 100)::DOUBLE AS conf FROM w0
  WHERE trim(word) <> '')
"""
