"""Texts are read, cleaned and counted once, whatever is made of what was found in them."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import corpus

NAMES = ["corpus_quota_fill", "corpus_source_stats", "source_balance", "char_budget_sample", "corpus_exact_dedup", "corpus_dedup_scope_global", "phase_routing", "block_packing", "tok_doc_metrics"]


@pytest.mark.parametrize("name", NAMES)
def test_texts_are_cleaned_once(spark, name):
    from lexforge.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "sha2" not in plan


def test_rows_are_made_once_for_both_sides(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    docs = spark.range(200).select(F.col("id").alias("seq"), F.lit("a").alias("source"), F.udf(count)(F.concat(F.lit("t"), F.col("id") % 30)).alias("fp"))
    got = corpus.without_duplicates(docs).collect()
    assert sorted(r["seq"] for r in got) == list(range(30)) and seen.value == 200
