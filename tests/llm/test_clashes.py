"""Columns of the input that are named like outputs come out of every pipeline stage unchanged."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = ["size", "target", "source_size", "taken", "repetitions", "kept", "n_words", "n_lines", "n_removed", "p_good", "class_id", "root", "digest", "id", "th", "n", "h"]


@pytest.mark.parametrize("n_chars", [True, False])
def test_stages_carry_all_columns(spark, n_chars):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    docs = docs if n_chars else docs.drop("n_chars")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.cut(stage(spark, now, ""))
        assert now.columns == docs.columns
        wrong = F.lit(False)
        for c in NAMES:
            wrong = wrong | ~F.col(c).eqNullSafe(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
        assert now.filter(wrong).count() == 0
    assert now.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").filter("length < 1").count() == 0
