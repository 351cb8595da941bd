"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_clusters, bpe, collocations, jaccard_join, language_id, line_dedup, packing, passage_dedup, personal_data, quality_rules, sql, suffix_dedup, token_counts, vector_dedup
from .common import table

try:  # the installed vocabulary files
    from public_tokenizers import path as vocabulary_file
except ImportError:  # their documented folder

    def vocabulary_file(name: str) -> str:
        return f"/opt/tokenizers/{name}"


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), each_length=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary or vocabulary_file("word_bpe_49k.json"))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = packing.with_length(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    packed = packing.pack(sized, length="n_tokens")
    return packed.select("doc_id", "n_tokens", "bucket_end", "bucket_group", "batch", "padding")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score(table(spark, sf_dir, "documents"))
    return out.select(*(c for c in out.columns if c != "host_rate"), F.round("host_rate", 6).alias("host_rate"))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_merge_counts(docs, vocabulary or vocabulary_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(table(spark, sf_dir, "documents"))


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_personal_data": op11_personal_data,
    "op12_ball_clusters": op12_ball_clusters,
    "op13_collocations": op13_collocations,
}

_OP9 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, t, source, w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
grams AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (
    SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT row_number() OVER () AS r, w FROM base))),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
numbered AS (SELECT row_number() OVER () AS r, * FROM lines),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, avg(f / n) AS rate, avg((f / n) * (f / n)) AS square, avg(1 / n) AS noise FROM h),
q AS (
  SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND noise < 1 THEN ((square - 2 * mean * rate + mean * mean) / (mean * (1 - mean)) - noise) / (1 - noise) END AS share FROM p),
prior AS (SELECT mean, CASE WHEN share > 0 THEN least(1000.0, greatest(1.0, 1 / share - 1)) ELSE 1000.0 END AS k FROM q),
v AS (SELECT source, (f + mean * k) / (n + k) AS rate FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate <= 0.5, true) AS kept, round(rate, 6) AS host_rate
FROM b LEFT JOIN v USING (source)
"""

_OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line FROM l),
r AS (SELECT *, CASE WHEN full_line THEN sum(full_line::INT) OVER (PARTITION BY doc_id ORDER BY i) END AS n FROM f),
g AS (
  SELECT doc_id, n, line, lead(line, 1) OVER p AS second, lead(line, 2) OVER p AS third FROM r WHERE full_line
  WINDOW p AS (PARTITION BY doc_id ORDER BY n)),
later AS (SELECT doc_id, n FROM g WHERE third IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, n) > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, (SELECT unnest([0, 1, 2]) AS k)),
m AS (SELECT r.*, gone.n IS NOT NULL AS cut FROM r LEFT JOIN gone ON r.doc_id = gone.doc_id AND r.n = gone.n),
b AS (
  SELECT *, CASE WHEN full_line THEN cut ELSE
    coalesce(last_value(CASE WHEN full_line THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AND coalesce(first_value(CASE WHEN full_line THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) END AS goes
  FROM m)
SELECT doc_id, count_if(full_line AND goes)::BIGINT AS n_deleted, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM b GROUP BY doc_id
"""

ORACLE_SQL = {
    "op7_line_dedup": _OP7,
    "op9_quality_rules": _OP9,
    "op11_personal_data": sql.op11(),
    "op12_ball_clusters": sql.op12(),
    "op13_collocations": sql.op13(),
}
