"""The pipeline's stages on a small table: what each must catch and keep."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trustgauge.llm import common


def prose(rng, n):
    return " ".join(f"v{rng.integers(0, 10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    clean = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 70)
    lines = "\n".join(prose(rng, 12) for _ in range(6))
    near = clean[1].split()
    near[60] = "edit"
    texts = {i: t for i, t in enumerate(clean)}
    texts |= {20: "too short", 21: "same words here " * 40, 30: f"{clean[2]}\n{lines}", 31: f"{prose(rng, 90)}\n{lines}\n{prose(rng, 90)}"}
    texts |= {40: clean[0], 41: " ".join(near), 50: f"{prose(rng, 90)} {passage} {prose(rng, 90)}", 51: f"{prose(rng, 90)} {passage} {prose(rng, 90)}", 60: None}
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in texts.items()], passage, lines


def test_stages(spark, rows, tmp_path):
    data, passage, lines = rows
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {20, 21, 60} & set(seen["quality_rules"]) and set(range(12)) <= set(seen["quality_rules"])
    assert lines.split("\n")[0] not in seen["line_dedup"][31] and lines.split("\n")[0] in seen["line_dedup"][30]
    assert {40, 41} & set(seen["jaccard_join"]) == set() and set(range(12)) <= set(seen["jaccard_join"])
    assert passage in seen["passage_dedup"][50] and passage.split()[5] not in seen["passage_dedup"][51]
    assert set(seen["packing"]) == set(seen["passage_dedup"])
    assert all(seen["packing"][i] == data[i][1] for i in range(12))


def test_run(spark, rows, tmp_path):
    """run() itself gives what the stages give one after the other, with nulls, repeated rows and columns that clash."""
    data, _, _ = rows
    data = [*data, data[3], (None, data[4][1], None, None, None), (70, "", "en", "src1", 0), (71, "word " * 30_000, "en", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_id", F.lit(1)).withColumn("_spans", F.lit("s"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_tokens"], r["bucket_end"]) for r in df.collect())
    got = key(corpus_pipeline.run(spark, str(tmp_path)))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(str(tmp_path / f"stage{k}"))
        step = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert got == key(step) and {r[0] for r in got} >= set(range(12))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


def test_tables_go(spark, rows):
    """A stage that is not yet written has left no table but the ones its result reads."""
    docs = spark.createDataFrame(rows[0], "doc_id long, text string, lang string, source string, n_chars long")
    top = common.shared_dir(spark).removeprefix("file://")
    for stage, left in ((corpus_pipeline.lines, {"gone"}), (corpus_pipeline.near_copies, {"gone"}), (corpus_pipeline.passages, {"spans"})):
        before = set(glob.glob(f"{top}/scratch-*/*"))
        out = stage(spark, docs, "unused")
        assert {os.path.basename(x) for x in set(glob.glob(f"{top}/scratch-*/*")) - before} == left
        assert out.count() > 0
