"""Candidate rankings, margins, their roll-ups and failure groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ("target_length", "evidence_position", "task_type", "answer_type")


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates with rank_sum (log-probability, highest first) and rank_mean (mean negative log-likelihood, lowest first);
    ties go to the smaller candidate_index, so to the gold one. An example has a handful of candidates."""
    by = Window.partitionBy("example_id")
    return candidates.withColumn("rank_sum", F.row_number().over(by.orderBy(F.desc("candidate_sum_logprob"), "candidate_index"))).withColumn(
        "rank_mean", F.row_number().over(by.orderBy("candidate_mean_nll", "candidate_index"))
    )


def answers(candidates: DataFrame) -> DataFrame:
    """One row for each example: gold scores, best wrong ones, margins and gold ranks. One aggregation, no window.

    The gold's rank is one more than the candidates that beat it; it is listed first, so it wins ties. Without wrong
    candidates the best wrong scores are infinite.
    """
    gold, wrong = F.col("candidate_kind") == "gold", F.col("candidate_kind") != "gold"
    rows = candidates.groupBy("example_id", *CELL).agg(
        F.max(F.when(gold, F.col("candidate_value"))).alias("gold_value"),
        F.max(F.when(gold, F.col("candidate_sum_logprob"))).alias("answer_sum_logprob"),
        F.max(F.when(gold, F.col("candidate_mean_nll"))).alias("answer_mean_nll"),
        F.collect_list(F.when(wrong, F.struct("candidate_sum_logprob", "candidate_mean_nll"))).alias("w"),
        F.max("evidence_to_answer_distance").alias("evidence_to_answer_distance"),
        F.count("*").alias("num_candidates"),
    )
    beat_sum = F.size(F.filter("w", lambda x: x["candidate_sum_logprob"] > F.col("answer_sum_logprob")))
    beat_mean = F.size(F.filter("w", lambda x: x["candidate_mean_nll"] < F.col("answer_mean_nll")))
    best_sum = F.coalesce(F.array_max(F.transform("w", lambda x: x["candidate_sum_logprob"])), F.lit(float("-inf")))
    best_mean = F.coalesce(F.array_min(F.transform("w", lambda x: x["candidate_mean_nll"])), F.lit(float("inf")))
    return (
        rows.withColumn("best_wrong_sum_logprob", best_sum)
        .withColumn("best_wrong_mean_nll", best_mean)
        .withColumn("sum_logprob_margin", F.col("answer_sum_logprob") - F.col("best_wrong_sum_logprob"))
        .withColumn("mean_nll_margin", F.col("best_wrong_mean_nll") - F.col("answer_mean_nll"))
        .withColumn("gold_rank_sum_logprob", beat_sum + 1)
        .withColumn("gold_rank_mean_nll", beat_mean + 1)
        .withColumn("rank_correct_sum_logprob", (F.col("gold_rank_sum_logprob") == 1).cast("int"))
        .withColumn("rank_correct_mean_nll", (F.col("gold_rank_mean_nll") == 1).cast("int"))
        .drop("w")
    )


def rollup(answer_rows: DataFrame) -> DataFrame:
    """Means over all, and by each prefix of length, position, task and answer type; `ALL` where a column is rolled up.

    level counts the columns that stand. Perplexity is of the mean, capped at e^80.
    """
    nll = F.avg("answer_mean_nll")
    out = answer_rows.rollup(*CELL).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        nll.alias("answer_mean_nll"),
        F.exp(F.least(F.lit(80.0), nll)).alias("answer_ppl"),
        F.avg("sum_logprob_margin").alias("mean_sum_logprob_margin"),
        F.avg("mean_nll_margin").alias("mean_mean_nll_margin"),
        F.avg("rank_correct_sum_logprob").alias("rank_acc_sum_logprob"),
        F.avg("rank_correct_mean_nll").alias("rank_acc_mean_nll"),
        F.avg("gold_rank_sum_logprob").alias("mean_gold_rank_sum_logprob"),
        F.avg("gold_rank_mean_nll").alias("mean_gold_rank_mean_nll"),
        F.avg("evidence_to_answer_distance").alias("mean_distance"),
    )
    named = [F.when(F.col("g").bitwiseAND(F.lit(1 << (3 - k))) != 0, "ALL").otherwise(F.col(c).cast("string")).alias(c) for k, c in enumerate(CELL)]
    level = F.lit(4) - F.bit_count("g")
    return out.select(*named, level.alias("level"), *[c for c in out.columns if c not in (*CELL, "g")])


#: The groupings of failure analysis; fixed values.
DIMENSIONS = (
    ("task_type",),
    ("target_length",),
    ("answer_type",),
    ("evidence_position",),
    ("task_type", "target_length"),
    ("task_type", "answer_type"),
    ("task_type", "target_length", "answer_type"),
)


def rollup_order(rolled: DataFrame) -> DataFrame:
    """A roll-up's rows by length as a number, ALL last, then by position, task and answer type as text."""
    length = F.when(F.col("target_length") == "ALL", 10**9).otherwise(F.try_to_number("target_length", F.lit("999999999999")).cast("long"))
    return rolled.orderBy(length, "evidence_position", "task_type", "answer_type")


def top_entries(values, k: int = 5):
    """Of an array of scores the k largest as (index, score), the first index of equals first."""
    each = F.transform(values, lambda x, i: F.struct((-x).alias("down"), i.alias("index"), x.alias("score")))
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda r: F.struct(r["index"].alias("index"), r["score"].alias("score")))


def failure_groups(answer_rows: DataFrame) -> DataFrame:
    """Failure rates in each of DIMENSIONS, one pass of grouping sets, labelled by `group_by`."""
    columns = [F.col(c) for c in ("target_length", "evidence_position", "task_type", "answer_type")]
    order = ["target_length", "evidence_position", "task_type", "answer_type"]
    rows = answer_rows.withColumn("failed", 1 - F.col("rank_correct_sum_logprob"))
    out = rows.groupingSets([[F.col(c) for c in d] for d in DIMENSIONS], *columns).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.sum("failed").alias("failures"),
        F.avg("failed").alias("failure_rate"),
        F.avg("sum_logprob_margin").alias("mean_margin"),
        F.avg("gold_rank_sum_logprob").alias("mean_gold_rank"),
        F.avg("evidence_to_answer_distance").alias("mean_distance"),
    )
    label = F.when(F.lit(False), "")
    for d in DIMENSIONS:
        gid = sum(1 << (3 - k) for k, c in enumerate(order) if c not in d)
        label = label.when(F.col("g") == gid, "+".join(d))
    return out.withColumn("group_by", label).drop("g")


def top_failures(groups: DataFrame, n: int = 30) -> DataFrame:
    """The n groups of the highest failure rate; ties by failures, then label, then the group itself."""
    return groups.orderBy(F.desc("failure_rate"), F.desc("failures"), "group_by", "task_type", "target_length", "answer_type", "evidence_position").limit(n)


def best_wrong(candidates: DataFrame) -> DataFrame:
    """(example_id, the wrong candidate of the highest log-probability, and that of the lowest mean loss)."""
    wrong = candidates.filter("candidate_kind <> 'gold'")
    return wrong.groupBy("example_id").agg(
        F.max_by("candidate_value", F.struct("candidate_sum_logprob", (-F.col("candidate_index")).alias("i"))).alias("best_wrong_value_sum"),
        F.min_by("candidate_value", F.struct("candidate_mean_nll", "candidate_index")).alias("best_wrong_value_mean"),
    )


def hard_negatives(candidates: DataFrame, k: int) -> DataFrame:
    """(example_id, negatives): the k wrong candidates of the highest score, the last repeated where there are fewer."""
    wrong = candidates.filter("candidate_kind <> 'gold'").groupBy("example_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("candidate_sum_logprob")).alias("s"), F.col("candidate_index").alias("i"), F.col("candidate_value").alias("v")))).alias("w")
    )
    top = F.transform(F.slice("w", 1, k), lambda x: x["v"])
    return wrong.withColumn("top", top).select("example_id", F.concat("top", F.array_repeat(F.element_at("top", -1), F.lit(k) - F.size("top"))).alias("negatives"))
