"""Scores of predictions and their grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T


def _flag(c):
    return F.coalesce(c.cast("int"), F.lit(0))


def score_kv(rows: DataFrame) -> DataFrame:
    """rows (generated_text, value, prompt, target_index, ...) with thirteen scores of UUID answers."""
    found = rows.withColumn("__u", T.uuids(F.col("generated_text"))).withColumn("__r", T.record_values(F.col("prompt")))
    first = F.coalesce(F.get("__u", F.lit(0)), F.lit(""))
    found = found.withColumn("first_extracted_value", first).withColumn("predicted_index", T.index_of(F.col("__r"), F.col("first_extracted_value")))
    index, n, value = F.col("predicted_index"), F.size("__r"), F.col("first_extracted_value")
    delta = F.when(index >= 0, index - F.col("target_index")).otherwise(0)
    return found.withColumns(
        {
            "exact_match": _flag(T.normalized(T.first_line(F.col("generated_text"))) == T.normalized(F.col("value"))),
            "contains_value": _flag(F.contains("generated_text", "value")),
            "first_value_match": _flag(value == F.col("value")),
            "num_extracted_values": F.size("__u"),
            "format_error": _flag(value == ""),
            "predicted_position_ratio": F.when((index >= 0) & (n > 1), index / F.greatest(F.lit(1), n - 1)).otherwise(-1.0),
            "predicted_in_context": _flag(index >= 0),
            "wrong_context_value": _flag((value != F.col("value")) & (index >= 0)),
            "hallucinated_value": _flag((value != "") & (index < 0)),
            "index_delta": delta,
            "abs_index_delta": F.abs(delta),
        }
    ).drop("__u", "__r")


def score_mini(rows: DataFrame, kind: str, gold_index: str | None = None) -> DataFrame:
    """rows with seven scores of one-token answers: `word` compares the first run of letters lower-cased, `digits` the first
    run of digits. gold_index: a column for where the value itself is listed first, or -1."""
    said = F.col("generated_text")
    if kind == "digits":
        predicted, listed, gold = F.regexp_extract(said, r"\d+", 0), T.record_values(F.col("prompt"), r"\d+"), F.col("value")
    else:
        predicted, listed, gold = F.lower(F.regexp_extract(said, "[A-Za-z]+", 0)), T.record_values(F.col("prompt"), "[A-Za-z]+"), F.lower("value")
    # the prompt's values in a step of their own: beside the scores they would be read again for every use of an index
    each = [c for c in rows.columns if c != "predicted_value"]
    out = rows.select(*each, predicted.alias("predicted_value"), F.explode(F.array(listed)).alias("__r"))
    places = {"predicted_index": T.index_of(F.col("__r"), F.col("predicted_value"))} | ({gold_index: T.index_of(F.col("__r"), F.col("value"))} if gold_index else {})
    out = out.withColumns(places).drop("__r")
    p, i = F.col("predicted_value"), F.col("predicted_index")
    return out.withColumns(
        {
            "exact_match": _flag(p == gold),
            "format_error": _flag(p == ""),
            "predicted_in_context": _flag(i >= 0),
            "wrong_context_value": _flag((p != "") & (p != gold) & (i >= 0)),
            "hallucinated_value": _flag((p != "") & (i < 0)),
        }
    )


def score_budget(rows: DataFrame) -> DataFrame:
    """rows of token-budget examples with the scores of digit answers and index_delta, how far from the value's first place
    the answer's is; 0 where either is not in the context."""
    i, gold = F.col("predicted_index"), F.col("__gold")
    return score_mini(rows, "digits", "__gold").withColumn("index_delta", F.when((i >= 0) & (gold >= 0), i - gold).otherwise(0)).drop("__gold")


def score_number(rows: DataFrame) -> DataFrame:
    """rows (generated_text, answer, ...) with the scores of number answers, by the first run of digits: those of position probes
    (exact_match of the first line, contains_answer, first_number, first_number_match) and of generations (num_numbers and
    format_error too)."""
    numbers = F.regexp_extract_all("generated_text", F.lit(r"\d+"), F.lit(0))
    first = F.coalesce(F.get(numbers, F.lit(0)), F.lit(""))
    return rows.withColumns(
        {
            "exact_match": _flag(T.normalized(T.first_line(F.col("generated_text"))) == T.normalized(F.col("answer"))),
            "contains_answer": _flag(F.contains("generated_text", "answer")),
            "first_number": first,
            "first_number_match": _flag(first == F.col("answer")),
            "num_numbers": F.size(numbers),
            "format_error": _flag(first == ""),
        }
    )


def score_aliases(rows: DataFrame) -> DataFrame:
    """rows (generated_text, aliases array<string>, ...) of questions over many documents: whether the text contains an alias
    (answer_contains), its first line is one (alias_match), it declines (no_answer) or is empty (format_error)."""
    said, line = T.normalized(F.col("generated_text")), T.normalized(T.first_line(F.col("generated_text")))
    none = said.rlike(r"\b(?:no answer|not (?:mentioned|given|stated|found)|unknown|cannot (?:answer|tell|find))\b")
    return rows.withColumns(
        {
            "answer_contains": _flag(F.exists("aliases", lambda a: (a != "") & F.contains(said, T.normalized(a)))),
            "alias_match": _flag(F.exists("aliases", lambda a: (a != "") & (line == T.normalized(a)))),
            "no_answer": _flag(none),
            "format_error": _flag(said == ""),
        }
    )


def score_values(rows: DataFrame, value: str = r"\d+") -> DataFrame:
    """rows (generated_text, values array<string>, others array<string>, ...) of retrieval with several values to name; others
    are values of keys that were not asked for. Scores: all and only the values (exact_match), the share of them named
    (partial_match), whether one is missing, one of another key is named, and one that is nowhere is."""
    said = F.array_distinct(F.regexp_extract_all("generated_text", F.lit(value), F.lit(0)))
    hit = F.size(F.array_intersect(said, F.array_distinct("values")))
    n = F.size(F.array_distinct("values"))
    return rows.withColumns(
        {
            "exact_match": _flag((hit == n) & (F.size(said) == n)),
            "partial_match": F.coalesce(F.try_divide(hit, n), F.lit(0.0)).cast("double"),
            "missing_value": _flag(hit < n),
            "wrong_key": _flag(F.size(F.array_intersect(F.array_except(said, F.col("values")), F.col("others"))) > 0),
            "wrong_value": _flag(F.size(F.array_except(F.array_except(said, F.col("values")), F.col("others"))) > 0),
        }
    )


def mean_summary(scored: DataFrame, keys: list[str], means: dict[str, str], first: dict[str, str] | None = None) -> DataFrame:
    """By keys: rows, the means of columns under new names, and of `first` the columns of the row that comes first by a column."""
    firsts = [F.min_by(c, F.col(order)).alias(c) for c, order in (first or {}).items()]
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), *firsts, *[F.avg(c).alias(n) for n, c in means.items()])


#: Columns of summaries: name -> column; fixed values.
POSITION_MEANS = {"mean_actual_prompt_tokens": "actual_prompt_tokens", "exact_match": "exact_match", "contains_answer": "contains_answer", "first_number_match": "first_number_match", "mean_latency_sec": "latency_sec"}
BUDGET_MEANS = {"mean_prompt_tokens": "actual_prompt_tokens", "mean_target_index": "target_index", "exact_match": "exact_match", "format_error_rate": "format_error", "wrong_context_value_rate": "wrong_context_value", "hallucinated_value_rate": "hallucinated_value", "mean_latency_sec": "latency_sec"}
GENERATION_MEANS = {"exact_match": "exact_match", "contains_answer": "contains_answer", "first_number_match": "first_number_match", "format_error_rate": "format_error", "mean_latency_sec": "latency_sec"}


def payload(rows: DataFrame, with_prompt: bool = False) -> DataFrame:
    """What a run writes: predictions without their prompts, which the examples have."""
    return rows if with_prompt else rows.drop("prompt")


def on_grid(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with position_ratio rounded to two digits; one whose cell (num_keys, position_ratio) is not on the grid fails."""
    rounded = rows.withColumn("position_ratio", F.round("position_ratio", 2))
    known = F.broadcast(cells.select("num_keys", F.round("position_ratio", 2).alias("position_ratio"), F.lit(True).alias("__on")).distinct())  # a literal table
    said = F.concat(F.lit("unexpected cell: "), F.col("num_keys").cast("string"), F.lit(", "), F.col("position_ratio").cast("string"))
    checked = F.when(F.col("__on"), F.col("num_keys")).otherwise(F.raise_error(said).cast("int"))
    return rounded.join(known, ["num_keys", "position_ratio"], "left").withColumn("num_keys", checked.cast(rows.schema["num_keys"].dataType)).drop("__on").select(*rows.columns)


RATES = {
    "exact_match": "exact_match",
    "contains_value": "contains_value",
    "first_value_match": "first_value_match",
    "format_error_rate": "format_error",
    "wrong_context_value_rate": "wrong_context_value",
    "hallucinated_value_rate": "hallucinated_value",
}


def _rates(names) -> list:
    return [F.avg(RATES[x]).alias(x) for x in names]


def cell_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rates by cell. mean_abs_index_delta_when_in_context is over rows whose answer is in the context."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("actual_prompt_tokens").alias("mean_prompt_tokens"),
        F.avg("target_index").alias("mean_target_index"),
        *_rates(RATES),
        (F.sum(F.when(F.col("predicted_in_context") == 1, F.col("abs_index_delta")).otherwise(0)) / F.greatest(F.lit(1), F.sum("predicted_in_context"))).alias("mean_abs_index_delta_when_in_context"),
        F.avg("latency_sec").alias("mean_latency_sec"),
    )


def official_summary(scored: DataFrame, cells: DataFrame, expected: int | None = None) -> DataFrame:
    """Rates over a fixed grid of cells (num_keys, position_ratio), missing metrics as 0; mean_abs_index_delta is over all
    rows. expected: the rows that each cell must have, else it fails."""
    agg = scored.groupBy("num_keys", "position_ratio").agg(F.count("*").alias("n"), *_rates(RATES), F.avg("abs_index_delta").alias("mean_abs_index_delta"))
    out = cells.join(agg, ["num_keys", "position_ratio"], "left").fillna(0)
    if expected is not None:
        out = out.withColumn("n", F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("rows in a cell: "), F.col("n").cast("string"))).cast("long")))
    return out


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last in order: the union of runs where a later row replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def classified(scored: DataFrame) -> DataFrame:
    return scored.withColumn("error_class", T.error_class(*[F.col(x) for x in ("first_value_match", "wrong_context_value", "hallucinated_value", "format_error")]))


def class_shares(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error_class, n, share): counts of each class and their share of the cell."""
    counts = classified(scored).groupBy(*keys, "error_class").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def index_pivot(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of wrong rows with the target first: counts and rates by bucket of the predicted index, 0 where nothing is wrong."""
    first = scored.filter(F.col("position_ratio") == 0.0)
    bucket = T.index_bucket(F.col("predicted_index"), F.col("num_keys"))
    wrong = F.col("exact_match") == 0
    out = first.withColumn("bucket", F.when(wrong, bucket)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("exact_match").alias("correct"), F.count_if(wrong).alias("error_n"), *[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in T.INDEX_BUCKET_NAMES]
    )
    return out.withColumns({f"{b}_rate": F.coalesce(F.try_divide(f"{b}_count", F.col("error_n")), F.lit(0.0)) for b in T.INDEX_BUCKET_NAMES})


def diagnosis(scored: DataFrame) -> DataFrame:
    """By cell: accuracy, mean of each row's share of the prompt before the target, and mean index error."""
    return scored.groupBy("num_keys", "position_ratio").agg(
        F.count("*").alias("n"),
        F.avg("first_value_match").alias("accuracy"),
        F.avg("target_index").alias("mean_target_index"),
        F.avg(F.col("target_record_token_start") / F.col("actual_prompt_tokens")).alias("mean_token_ratio"),
        F.avg("abs_index_delta").alias("mean_abs_index_delta"),
    )


def same_samples(rows: DataFrame) -> DataFrame:
    """By num_keys: whether every position has the same set of source rows, and how many positions there are.

    A source row is in all positions or not; counting positions by source row needs no set of all of them.
    """
    by = rows.select("num_keys", "source_index", "position_ratio").distinct()
    positions = rows.groupBy("num_keys").agg(F.count_distinct("position_ratio").alias("positions"))
    seen = by.groupBy("num_keys", "source_index").agg(F.count("*").alias("at"))
    return seen.join(positions, "num_keys").groupBy("num_keys").agg(F.max("positions").alias("positions"), F.count("*").alias("sources"), F.bool_and(F.col("at") == F.col("positions")).alias("consistent"))


def pending(examples: DataFrame, done: DataFrame) -> DataFrame:
    """Examples that have no prediction yet."""
    return examples.join(done.select("example_id"), "example_id", "left_anti")


def tagged_union(runs: dict[str, DataFrame]) -> DataFrame:
    """All rows of all runs with `model`, the run's name."""
    out = None
    for name, rows in runs.items():
        rows = rows.withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """By pair of error classes: examples of two runs, and those whose texts are equal."""
    left = classified(a).select("example_id", F.col("error_class").alias("class_a"), F.col("generated_text").alias("text_a"))
    right = classified(b).select("example_id", F.col("error_class").alias("class_b"), F.col("generated_text").alias("text_b"))
    return left.join(right, "example_id").groupBy("class_a", "class_b").agg(F.count("*").alias("n"), F.count_if(F.col("text_a") == F.col("text_b")).alias("equal_text"))


def mean_of_cells(summary: DataFrame) -> DataFrame:
    """Accuracy by num_keys as the plain mean of its cells."""
    return summary.groupBy("num_keys").agg(F.avg("first_value_match").alias("mean_accuracy"))


def matched(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Examples with their predictions; a prediction without an example fails."""
    own = predictions.select("example_id", *[c for c in predictions.columns if c not in examples.columns])
    known = examples.withColumn("__known", F.lit(True))
    out = own.join(known, "example_id", "left")
    return out.withColumn("example_id", F.when(F.col("__known"), F.col("example_id")).otherwise(F.raise_error(F.concat(F.lit("no example for "), F.col("example_id"))))).drop("__known")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def answer_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (match, answer_mean_nll, ...) -> accuracy, right and wrong answers apart, mean loss and its perplexity."""
    nll = F.avg("answer_mean_nll")
    right = F.col("match") == 1
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("match").alias("accuracy"),
        F.count_if(right).alias("right"),
        F.avg(F.when(right, F.col("answer_mean_nll"))).alias("nll_right"),
        F.avg(F.when(~right, F.col("answer_mean_nll"))).alias("nll_wrong"),
        nll.alias("answer_mean_nll"),
        F.exp(F.least(F.lit(80.0), nll)).alias("answer_ppl"),
    )
