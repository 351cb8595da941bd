"""All operators over odd tables: empty, null ids, clashing columns, repeated rows, ties and a very long text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustgauge.llm import bpe, jaccard_join, language_id, line_dedup, packing, passage_dedup, personal_data, quality_rules, suffix_dedup, token_counts, vector_dedup
from trustgauge.llm.queries import vocabulary_file

CLASH = ("_id", "_key", "_spans", "_starts", "_gone", "_host", "_cut", "_h", "_runs", "_short", "_other", "_failed", "_counts", "_rejected", "id", "text_", "n", "first", "_full", "_email", "_card", "kind")


def _language(docs):
    model = language_id.train(docs)
    return language_id.predict(docs, model)


#: Operator, and whether every row comes back.
OPERATORS = {
    "suffix_dedup": (suffix_dedup.remove_repeats, True),
    "bpe": (lambda d: bpe.encode(d, vocabulary_file("word_bpe_49k.json")), True),
    "passage_dedup": (passage_dedup.remove_passages, True),
    "jaccard_join": (jaccard_join.keep_one, False),
    "packing": (packing.pack, True),
    "line_dedup": (line_dedup.dedup, True),
    "language_id": (_language, True),
    "quality_rules": (quality_rules.keep, False),
    "quality_rules judged": (lambda d: quality_rules.judge(quality_rules.with_measures(d), quality_rules.host_verdicts(quality_rules.host_rates(quality_rules.with_measures(d)))), True),
    "personal_data": (personal_data.with_spans, True),
    "personal_data redacted": (personal_data.redacted, True),
    "token_counts": (lambda d: token_counts.with_merge_counts(d, vocabulary_file("piece_bpe_32k.model")), True),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    prose = " ".join(f"w{rng.integers(0, 10**6)}" for _ in range(120))
    long = "\n".join(" ".join(f"x{rng.integers(0, 10**7)}" for _ in range(12)) for _ in range(45_000))  # about 5 MB
    lines = "one two\nthree four\nfive six\nseven"
    rows = [(1, prose), (1, prose), (2, prose), (2, "another text of this id"), (None, prose), (None, None), (3, None), (4, ""), (5, " \n\t\n "), (6, long), (7, lines), (8, lines), (9, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3).cache()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, table, name):
    run, whole = OPERATORS[name]
    out = run(table)
    if name != "language_id":
        assert set(table.columns) <= set(out.columns)
        got = out.select("doc_id", F.length("text").alias("size"), *CLASH).collect()
        assert all(r[c] == c for r in got for c in CLASH)
    else:
        got = out.collect()
    assert len(got) == table.count() if whole else 0 < len(got) <= table.count()
    empty = run(table.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_mixed_lengths(spark):
    """Vectors of another length than most don't crash and link with nothing."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(9)] + [(20, [1.0, 0.0, 0.0]), (21, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit("y"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert got[0] == (2, 0) and got[20] == (0, 20) and got[None] == (0, None) and len(got) == 12
