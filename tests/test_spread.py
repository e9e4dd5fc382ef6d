"""Steps whose work lay in one task, or was done again for every row, at larger sizes."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import generators, retrieval


def one_part(spark, n, name):
    """A table as one file of few bytes gives it."""
    return spark.range(n).select(F.col("id").alias(name)).coalesce(1)


def test_needles_of_one_small_file_are_made_by_all_cores(spark):
    rows = retrieval.needles(spark, [64, 128], [0.0, 0.5, 1.0], one_part(spark, 40, "sample_index"), 3)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    counted = rows.withColumn("n", T.token_count(F.col("prompt"))).withColumn("at", T.token_count(F.element_at(F.split("prompt", "The access"), 1)))
    got = counted.collect()
    assert len(got) == 240 and all(r["n"] == r["actual_prompt_tokens"] and r["at"] == r["evidence_token_start"] for r in got)


def test_summaries_of_probes_make_no_prompts(spark):
    from lexforge.plans import catalog

    plan = catalog.queries()["summary_position"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]  # what is done for every example
    assert "Join" in plan and "Reference item" not in above and "regexp_extract_all(concat(before" not in above and "tail#" not in above


@pytest.mark.parametrize("name", ["score_token_budget", "minikv_examples", "summary_token_budget", "summary_minikv", "score_minikv"])
def test_short_record_examples_are_dealt_to_all_cores(spark, name):
    from lexforge.plans import catalog

    assert "Repartition" in catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_short_records_are_placed_and_counted(spark):
    rows = retrieval.mini(spark, [1, 4, 12], [0.0, 0.5, 1.0], one_part(spark, 20, "sample_index"), 3)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = rows.withColumn("n", T.token_count(F.col("prompt"))).withColumn("values", T.record_values(F.col("prompt"), r"\d+")).collect()
    assert len(got) == 180
    for r in got:
        assert r["n"] == r["actual_prompt_tokens"] and len(r["values"]) == r["num_records"] and r["values"].index(r["value"]) == r["target_index"]


def test_dense_examples_of_one_small_file_are_made_by_all_cores(spark):
    rows = generators.dense_examples(spark, one_part(spark, 2, "sample"), [64, 128], 5, most=20)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    tries = rows._jdf.queryExecution().optimizedPlan().toString()
    assert tries.count("array_distinct") == 1 and "coalesce(get(slice(array_distinct" not in tries  # near misses are made before the decoys, not within


def test_dense_examples_make_more_decoys_where_many_are_left_out(spark, monkeypatch):
    want = generators.dense_examples(spark, one_part(spark, 2, "sample"), [64, 128], 5, most=60).orderBy("example_id").collect()
    monkeypatch.setattr(generators, "SPARE", -10_000)  # none are made at first
    assert generators.dense_examples(spark, one_part(spark, 2, "sample"), [64, 128], 5, most=60).orderBy("example_id").collect() == want


def test_groups_of_one_small_file_are_made_by_all_cores(spark):
    groups = generators.groups(spark, one_part(spark, 3, "g"), 4, 1)
    assert groups.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_filler_has_as_many_tokens_as_asked_for(spark):
    rows = spark.range(60).select(F.col("id").cast("int").alias("n"), generators.filler(F.lit("x"), F.col("id").cast("int")).alias("f"))
    for r in rows.withColumn("m", T.token_count(F.col("f"))).collect():
        assert r["m"] == r["n"] and (r["f"].endswith("\n") if r["n"] else r["f"] == "")


def test_a_shared_filler_is_counted_once_for_a_group(spark):
    groups = generators.groups(spark, one_part(spark, 2, "g"), 3, 1)
    out = generators.with_shared_filler(generators.queries_of(groups), groups, 30)
    assert "__n" in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.withColumn("n", T.token_count(F.col("prompt"))).collect()
    assert got and all(r["n"] == r["prompt_tokens"] for r in got)


def test_fillers_of_all_groups_are_not_broadcast(spark):
    groups = generators.groups(spark, one_part(spark, 2, "g"), 3, 1)
    plan = generators.with_shared_filler(generators.queries_of(groups), groups, 30)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
