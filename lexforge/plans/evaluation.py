"""Queries of retrieval examples, scores, summaries, rankings, attention and training logs.

The tables that models would fill are derived from the test tables: records from `orders`, answers from a digit of a
hash, candidates and weights from `embeddings`, logs from `events`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import attention, ranking, retrieval, scoring, trainlog
from lexforge.plans.common import Query, plain, table, tokens_sql, uuid_sql

GROUP, SAMPLES, SEED = 8, 50, 42
BUDGETS = [256, 1_024, 4_096, 16_384, 65_536]
SIZES, POSITIONS, CROPPED = [8], [0.0, 0.25, 0.5, 0.75, 1.0], [3, 5]
#: Candidates of an example, and examples' ids that are queried: every one.
NEXT = (1, 2, 3, 5, 8, 13)


# --- derived inputs ------------------------------------------------------------------------------------------------


def _sources(spark, d):
    """(source_index, key, value, records): groups of orders as key-value records; a hash picks the one asked for."""
    rows = table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / GROUP).alias("source_index"),
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"),
        T.uuid_of(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))).alias("value"),
        "o_orderkey",
    )
    groups = rows.groupBy("source_index").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "key", "value"))).alias("r"))  # GROUP orders at most
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("t"), F.col("source_index").cast("string"))), 1, 1), 16, 10).cast("int") % F.size("r")
    return groups.select(
        "source_index",
        F.get("r", pick)["key"].alias("key"),
        F.get("r", pick)["value"].alias("value"),
        F.transform("r", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("records"),
    )


def _examples(spark, d, sizes=SIZES, name="kv"):
    """Examples of all groups of orders; the sample's index is the group's."""
    return retrieval.examples(_sources(spark, d).withColumn("sample_index", F.col("source_index")), sizes, POSITIONS, name)


def _sampled_examples(spark, d, sizes=SIZES, name="kv"):
    return retrieval.examples(retrieval.sampled(_sources(spark, d), "source_index", SAMPLES, SEED), sizes, POSITIONS, name)


def _digit(c, salt: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 1), 16, 10).cast("int")


def _predictions(spark, d, salt: str = "p"):
    """Examples with an answer: the value, another record's, one that is nowhere, or none."""
    digit, value = _digit(F.col("example_id"), salt), F.col("value")
    values = T.record_values(F.col("prompt"))
    other = F.when(F.get(values, F.lit(0)) == value, F.get(values, F.lit(1))).otherwise(F.get(values, F.lit(0)))
    said = F.when(digit < 6, value).when(digit < 8, F.concat(F.lit("The value is "), value, F.lit("."))).when(digit < 12, other).when(digit < 14, T.uuid_of(F.concat(F.lit(salt), "example_id"))).otherwise(F.lit("I do not know.\nSorry"))
    return _examples(spark, d).withColumn("generated_text", said).withColumn("latency_sec", (digit + 1) / 16.0)


def _scored(spark, d, salt: str = "p"):
    return scoring.score_kv(_predictions(spark, d, salt))


def _asked(spark, d):
    """Every customer asks for a sample of its own."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample_index"))


def _mini_scored(spark, d):
    rows = retrieval.mini(spark, [4, 6], [0.0, 0.5, 1.0], _asked(spark, d), SEED)
    digit = _digit(F.col("example_id"), "m")
    listed = T.record_values(F.col("prompt"), r"\d+")
    said = F.when(digit < 8, F.concat(F.lit("value "), "value")).when(digit < 12, F.get(listed, F.lit(1))).when(digit < 14, F.lit("00000000")).otherwise(F.lit("none"))
    return scoring.score_mini(rows.withColumn("generated_text", said).withColumn("latency_sec", digit / 16.0), "digits")


def _candidates(spark, d):
    """For each vector the ones a few ids on, as candidates scored by dot product; the nearest id is the gold one."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    offsets = F.posexplode(F.array(*[F.lit(k) for k in NEXT])).alias("candidate_index", "k")
    asked = v.select(F.col("vec_id").alias("q"), F.col("label").alias("q_label"), F.col("e").alias("qe"), offsets).withColumn("vec_id", F.col("q") + F.col("k"))
    dot = F.aggregate(F.zip_with("qe", "e", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rows = asked.join(v, "vec_id").withColumn("s", F.round(dot, 9))
    return rows.select(
        F.concat(F.lit("ex"), F.col("q").cast("string")).alias("example_id"),
        F.when(F.col("candidate_index") == 0, "gold").otherwise("distractor").alias("candidate_kind"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("candidate_value"),
        "candidate_index",
        F.col("s").alias("candidate_sum_logprob"),
        (-F.col("s") / (1 + F.col("vec_id") % 3)).alias("candidate_mean_nll"),
        (1024 * (1 + F.col("q") % 2)).alias("target_length"),
        F.element_at(F.array(F.lit("front"), F.lit("middle"), F.lit("back")), (F.col("q") % 3 + 1).cast("int")).alias("evidence_position"),
        F.when(F.col("q_label") < 5, "kv").otherwise("word").alias("task_type"),
        F.when(F.col("q_label") % 2 == 0, "digit").otherwise("letter").alias("answer_type"),
        (F.col("q") % 100).cast("double").alias("evidence_to_answer_distance"),
    )


def _weights(spark, d):
    """Each vector as a distribution over its places, in layers and heads, for two methods."""
    v = table(spark, d, "embeddings")
    mass = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    all_of = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
    return v.select(
        F.when(F.col("vec_id") % 2 == 0, "base").otherwise("scaled").alias("method"),
        F.col("vec_id").alias("example"),
        (F.col("vec_id") % 4).alias("layer"),
        (F.floor(F.col("vec_id") / 4) % 3).alias("head"),
        (F.col("label") / 10.0).alias("position_ratio"),
        F.transform(mass, lambda x: x / all_of).alias("probs"),
        (F.lit(39) + F.col("vec_id") % 25).cast("int").alias("query"),
        F.when(F.col("label") < 8, F.col("label") * 4).cast("int").alias("evidence_start"),
        F.when(F.col("label") < 8, F.col("label") * 4 + 6).cast("int").alias("evidence_end"),
    )


def _attention(spark, d):
    return attention.query_metrics(_weights(spark, d), (8, 16, 32), (32, 48), 16)


ATTENTION = ("entropy", "entropy_norm", "top1_mass", "top5_mass", "sink_mass_first16", "local_mass_8", "local_mass_16", "local_mass_32", "far_mass_32_plus", "far_mass_48_plus", "evidence_mass", "effective_span_80")


def _log(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("step"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("loss")).withColumn("tokens_seen", F.col("step") * 4096)


# --- queries -------------------------------------------------------------------------------------------------------


def litm_grid(spark, d):
    """Every group of orders in every cell, and where its record goes."""
    rows = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / GROUP).alias("source_index")).distinct()
    return plain(retrieval.with_cells(rows, [75, 140, 300], POSITIONS).withColumn("target_index", T.target_index(F.col("position_ratio"), F.col("num_keys"))))


def _shown(rows):
    return plain(rows.select("example_id", "num_keys", "position_ratio", "sample_index", "source_index", "target_index", "key", "value", F.md5("prompt").alias("prompt_md5"), "actual_prompt_tokens", "target_record_token_start", "target_record_token_end"))


def litm_examples(spark, d):
    return _shown(_sampled_examples(spark, d))


def litm_cropped(spark, d):
    return _shown(_sampled_examples(spark, d, CROPPED, "crop"))


def minikv_examples(spark, d):
    return plain(retrieval.mini(spark, [4, 6], [0.0, 0.5, 1.0], _asked(spark, d), SEED).withColumn("prompt", F.md5("prompt")))


def minikv_reval(spark, d):
    return plain(retrieval.revalued(_examples(spark, d).select("example_id", "key", "prompt")).select("example_id", "key", "value", F.md5("prompt").alias("prompt_md5")))


def record_budget_fit(spark, d):
    """A line for each part, as long as its size says, and one for each of its digits."""
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("i"), (F.lit(8) + F.col("p_size") % 5 + F.length(F.col("p_partkey").cast("string"))).cast("long").alias("n"))
    return plain(retrieval.budget_fit(lines, 30, BUDGETS))


def needle_probe(spark, d):
    return plain(retrieval.needles(spark, [256, 512], POSITIONS, _asked(spark, d), SEED).withColumn("prompt", F.md5("prompt")))


SCORES = ("exact_match", "contains_value", "first_value_match", "first_extracted_value", "num_extracted_values", "format_error", "predicted_index", "predicted_position_ratio", "predicted_in_context", "wrong_context_value", "hallucinated_value", "index_delta", "abs_index_delta")


def score_litm(spark, d):
    return plain(_scored(spark, d).select("example_id", *SCORES))


def score_minikv(spark, d):
    return plain(_mini_scored(spark, d).select("example_id", "predicted_value", "exact_match", "format_error", "predicted_in_context", "wrong_context_value", "hallucinated_value", "predicted_index"))


def summary_cell(spark, d):
    return plain(scoring.cell_summary(_scored(spark, d), ["num_keys", "position_ratio"]))


def summary_official_merge(spark, d):
    """Two overlapping runs; the later one's rows replace the earlier one's."""
    a, b = _scored(spark, d, "p").withColumn("shard", F.lit(0)), _scored(spark, d, "q").filter(F.col("sample_index") % 2 == 0).withColumn("shard", F.lit(1))
    keep = ["example_id", "num_keys", "position_ratio", "sample_index", "abs_index_delta", *scoring.RATES.values(), "shard"]
    merged = scoring.latest(a.select(*keep).unionByName(b.select(*keep)), "example_id", ["shard", "sample_index"])
    return plain(scoring.official_summary(merged, retrieval.grid(spark, SIZES, [*POSITIONS, 0.9])))


def error_class_share(spark, d):
    return plain(scoring.class_shares(_scored(spark, d), ["num_keys", "position_ratio"]))


def error_bucket_pivot(spark, d):
    return plain(scoring.index_pivot(_scored(spark, d), ["num_keys", "position_ratio"]))


def cell_diagnosis(spark, d):
    return plain(scoring.diagnosis(_scored(spark, d)))


def resume_pending(spark, d):
    examples = _examples(spark, d).select("example_id", "sample_index")
    done = examples.filter(_digit(F.col("example_id"), "d") < 9)
    return plain(scoring.pending(examples, done))


def run_union(spark, d):
    runs = {name: scoring.cell_summary(_scored(spark, d, salt), ["num_keys", "position_ratio"]).select("num_keys", "position_ratio", F.col("exact_match").alias("accuracy"), F.col("format_error_rate").alias("format_error")) for name, salt in (("first", "p"), ("second", "q"))}
    return plain(scoring.tagged_union(runs))


def pair_compare(spark, d):
    return plain(scoring.compared(_scored(spark, d, "p"), _scored(spark, d, "q")))


def sample_consistency(spark, d):
    return plain(scoring.same_samples(_examples(spark, d)))


def mean_of_cells(spark, d):
    return plain(scoring.mean_of_cells(scoring.cell_summary(_scored(spark, d), ["num_keys", "position_ratio"])))


def candidate_ranks(spark, d):
    return plain(ranking.ranked(_candidates(spark, d)).select("example_id", "candidate_index", "rank_sum", "rank_mean"))


def answer_margins(spark, d):
    return plain(ranking.answers(_candidates(spark, d)))


def rank_rollup(spark, d):
    rows = ranking.answers(_candidates(spark, d)).filter("num_candidates > 1")
    return plain(ranking.rollup(rows))


def failure_groups(spark, d):
    return plain(ranking.failure_groups(ranking.answers(_candidates(spark, d)).filter("num_candidates > 1")))


def top_failures(spark, d):
    return plain(ranking.top_failures(ranking.failure_groups(ranking.answers(_candidates(spark, d)).filter("num_candidates > 1")), 10))


def best_wrong(spark, d):
    return plain(ranking.best_wrong(_candidates(spark, d)))


def hard_negatives(spark, d):
    return plain(ranking.hard_negatives(_candidates(spark, d), 4).withColumn("negatives", F.array_join("negatives", ",")))


def attention_metrics(spark, d):
    return plain(_attention(spark, d).select("example", *ATTENTION))


def attention_layer_head(spark, d):
    return plain(attention.means(_attention(spark, d), ["layer", "head"], ATTENTION))


def attention_method_position(spark, d):
    return plain(attention.means(_attention(spark, d), ["method", "position_ratio"], ATTENTION))


def trainlog_throughput(spark, d):
    return plain(trainlog.throughput(_log(spark, d)).select("run", "step", "tok_per_s"))


def trainlog_summary(spark, d):
    return plain(trainlog.summary(_log(spark, d), 10))


def lr_schedule(spark, d):
    """The rate of each event's step, warm-up and decay being a tenth and the most of a thousand steps."""
    step = F.col("event_id") % 1_200
    return plain(table(spark, d, "events").select("event_id", step.alias("step"), (trainlog.learning_rate(step, 3e-4, 3e-5, 100, 1000) * 1e6).alias("lr_millionths")))


def train_val_split(spark, d):
    return plain(trainlog.split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05, SEED))


# --- SQL -----------------------------------------------------------------------------------------------------------

_PREFIX = retrieval.PREFIX.replace("\n", "' || chr(10) || '")
_SOURCES = f"""r AS (SELECT o_orderkey // {GROUP} AS source_index, o_orderkey, 'k' || o_orderkey AS key, {uuid_sql("'v' || o_orderkey")} AS value FROM orders),
g AS (SELECT source_index, list({{{{'key': key, 'value': value}}}} ORDER BY o_orderkey) AS records, ('0x' || substr(md5('t' || source_index), 1, 1))::INT % count(*) + 1 AS pick FROM r GROUP BY source_index),
s AS (SELECT source_index, records[pick].key AS key, records[pick].value AS value, records, {{index}} FROM g{{cut}})"""
_ALL = _SOURCES.format(index="source_index AS sample_index", cut="")
_SAMPLED = _SOURCES.format(index=f"row_number() OVER (ORDER BY md5('{SEED}:' || source_index), source_index) - 1 AS sample_index", cut=f" QUALIFY sample_index < {SAMPLES}")


def _examples_sql(sizes: list[int], name: str, sources: str = _ALL) -> str:
    cells = ", ".join(f"({n}, {p}::DOUBLE)" for n in sizes for p in POSITIONS)
    line = "'Key: ' || x.key || ' | Value: ' || x.value || chr(10)"
    body = lambda r: f"array_to_string(list_transform({r}, lambda x: {line}), '')"
    return f"""{sources}, cells(num_keys, position_ratio) AS (VALUES {cells}),
e1 AS (SELECT s.*, num_keys, position_ratio, list_filter(records, lambda x: x.key = s.key) AS own, list_filter(records, lambda x: x.key <> s.key)[1:num_keys - 1] AS rest FROM s, cells),
e2 AS (SELECT *, greatest(0, least(len(rest), round_even(position_ratio * len(rest), 0)::INT)) AS target_index FROM e1),
e3 AS (SELECT * EXCLUDE (records), list_concat(list_concat(rest[1:target_index], own), rest[target_index + 1:]) AS records FROM e2),
ex AS (SELECT '{name}' || num_keys || '_pos' || printf('%.2f', position_ratio) || '_sample' || sample_index AS example_id, num_keys::BIGINT AS num_keys, position_ratio, sample_index, source_index, target_index::BIGINT AS target_index, key, value,
  '{_PREFIX}' || {body("records")} || chr(10) || 'Question: What is the value associated with key ' || key || '?' || chr(10) || 'Answer:' AS prompt,
  len({tokens_sql(f"'{_PREFIX}' || " + body("records[1:target_index]"))})::BIGINT AS target_record_token_start, len({tokens_sql(body("records[target_index + 1:target_index + 1]"))})::BIGINT AS own_n FROM e3)"""


_UUID = T.UUID
_EX = _examples_sql(SIZES, "kv")


def _scored_sql(salt: str, to: str) -> str:
    """CTEs from `ex` to the scored table `to`."""
    digit = f"('0x' || substr(md5('{salt}' || example_id), 1, 1))::INT"
    return f"""{to}_p AS (SELECT *, len({tokens_sql('prompt')})::BIGINT AS actual_prompt_tokens, regexp_extract_all(prompt, 'Value: ({_UUID})', 1) AS vals, {digit} AS digit FROM ex),
{to}_q AS (SELECT *, CASE WHEN digit < 6 THEN value WHEN digit < 8 THEN 'The value is ' || value || '.' WHEN digit < 12 THEN CASE WHEN vals[1] = value THEN vals[2] ELSE vals[1] END
  WHEN digit < 14 THEN {uuid_sql(f"'{salt}' || example_id")} ELSE 'I do not know.' || chr(10) || 'Sorry' END AS generated_text, (digit + 1) / 16.0::DOUBLE AS latency_sec FROM {to}_p),
{to}_r AS (SELECT *, regexp_extract_all(generated_text, '{_UUID}') AS found, coalesce(regexp_extract_all(generated_text, '{_UUID}')[1], '') AS first_extracted_value FROM {to}_q),
{to}_s AS (SELECT *, coalesce(list_position(vals, first_extracted_value), 0)::BIGINT - 1 AS predicted_index FROM {to}_r),
{to} AS (SELECT *, (lower(trim(string_split(generated_text, chr(10))[1])) = lower(value))::BIGINT AS exact_match, contains(generated_text, value)::BIGINT AS contains_value, (first_extracted_value = value)::BIGINT AS first_value_match,
  len(found)::BIGINT AS num_extracted_values, (first_extracted_value = '')::BIGINT AS format_error, CASE WHEN predicted_index >= 0 AND len(vals) > 1 THEN predicted_index / (len(vals) - 1)::DOUBLE ELSE -1.0::DOUBLE END AS predicted_position_ratio,
  (predicted_index >= 0)::BIGINT AS predicted_in_context, (first_extracted_value <> value AND predicted_index >= 0)::BIGINT AS wrong_context_value, (first_extracted_value <> '' AND predicted_index < 0)::BIGINT AS hallucinated_value,
  CASE WHEN predicted_index >= 0 THEN predicted_index - target_index ELSE 0 END AS index_delta, abs(CASE WHEN predicted_index >= 0 THEN predicted_index - target_index ELSE 0 END) AS abs_index_delta,
  CASE WHEN first_extracted_value = value THEN 'correct' WHEN predicted_index >= 0 THEN 'wrong_context_value' WHEN first_extracted_value <> '' THEN 'hallucinated_value' ELSE 'format_error' END AS error_class FROM {to}_s)"""


_SC = f"{_EX}, {_scored_sql('p', 'sc')}"
_SC2 = f"{_SC}, {_scored_sql('q', 'sq')}"
_RATES = ", ".join(f"round(avg({c}), 6) AS {n}" for n, c in scoring.RATES.items())
_SHOWN = "example_id, num_keys, position_ratio, sample_index, source_index, target_index, key, value, md5(prompt) AS prompt_md5, len({t})::BIGINT AS actual_prompt_tokens, target_record_token_start, target_record_token_start + own_n AS target_record_token_end"
_SHOWN = _SHOWN.replace("{t}", tokens_sql("prompt"))
_MINI_H = "md5('{seed}{what}:' || num_records || ':' || sample_index || ':' || i)"
_MINI = f"""m AS (SELECT n AS num_records, p AS position_ratio, x AS sample_index FROM (SELECT unnest([4, 6]) AS n), (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS p), (SELECT c_custkey AS x FROM customer)),
mr AS (SELECT *, list_transform(range(0, num_records), lambda i: {{
  'key': translate(substr({_MINI_H.format(seed=SEED, what="k")}, 1, 6), '0123456789', 'ghijklmnop') || lpad(translate(i::VARCHAR, '0123456789', 'qrstuvwxyz'), 3, 'q'),
  'value': (('0x' || substr({_MINI_H.format(seed=SEED, what="v")}, 1, 6))::BIGINT % 90000 + 10000)::VARCHAR || lpad(i::VARCHAR, 3, '0')}}) AS records FROM m),
mt AS (SELECT *, greatest(0, least(num_records - 1, round_even(position_ratio * (num_records - 1), 0)::INT)) AS target_index FROM mr),
mp AS (SELECT *, list_concat(list_concat(records[2:target_index + 1], records[1:1]), records[target_index + 2:]) AS placed FROM mt),
mini AS (SELECT 'mini' || num_records || '_pos' || printf('%.2f', position_ratio) || '_sample' || sample_index AS example_id, num_records::BIGINT AS num_records, position_ratio, sample_index::BIGINT AS sample_index, target_index::BIGINT AS target_index, records[1].key AS key, records[1].value AS value,
  '{_PREFIX}' || array_to_string(list_transform(placed, lambda x: 'Key: ' || x.key || ' | Value: ' || x.value || chr(10)), '') || chr(10) || 'Question: What is the value associated with key ' || records[1].key || '?' || chr(10) || 'Answer:' AS prompt FROM mp)"""
_CAND = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
o AS (SELECT unnest({list(NEXT)}) AS k, unnest(range(0, {len(NEXT)})) AS candidate_index),
cand AS (SELECT 'ex' || a.vec_id AS example_id, CASE WHEN candidate_index = 0 THEN 'gold' ELSE 'distractor' END AS candidate_kind, 'v' || b.vec_id AS candidate_value, candidate_index,
  round(list_inner_product(a.e, b.e), 9) AS candidate_sum_logprob, -round(list_inner_product(a.e, b.e), 9) / (1 + b.vec_id % 3) AS candidate_mean_nll, 1024 * (1 + a.vec_id % 2) AS target_length,
  ['front', 'middle', 'back'][a.vec_id % 3 + 1] AS evidence_position, CASE WHEN a.label < 5 THEN 'kv' ELSE 'word' END AS task_type, CASE WHEN a.label % 2 = 0 THEN 'digit' ELSE 'letter' END AS answer_type, (a.vec_id % 100)::DOUBLE AS evidence_to_answer_distance
  FROM v a, o, v b WHERE b.vec_id = a.vec_id + o.k),
gold AS (SELECT * FROM cand WHERE candidate_index = 0),
ans AS (SELECT g.example_id, any_value(g.target_length)::BIGINT AS target_length, any_value(g.evidence_position) AS evidence_position, any_value(g.task_type) AS task_type, any_value(g.answer_type) AS answer_type, any_value(g.candidate_value) AS gold_value,
  any_value(g.candidate_sum_logprob) AS answer_sum_logprob, any_value(g.candidate_mean_nll) AS answer_mean_nll, any_value(g.evidence_to_answer_distance) AS evidence_to_answer_distance, count(*) AS num_candidates,
  coalesce(max(c.candidate_sum_logprob) FILTER (WHERE c.candidate_index > 0), '-inf'::DOUBLE) AS best_wrong_sum_logprob, coalesce(min(c.candidate_mean_nll) FILTER (WHERE c.candidate_index > 0), 'inf'::DOUBLE) AS best_wrong_mean_nll,
  count(*) FILTER (WHERE c.candidate_index > 0 AND c.candidate_sum_logprob > g.candidate_sum_logprob) + 1 AS gold_rank_sum_logprob, count(*) FILTER (WHERE c.candidate_index > 0 AND c.candidate_mean_nll < g.candidate_mean_nll) + 1 AS gold_rank_mean_nll
  FROM gold g JOIN cand c USING (example_id) GROUP BY g.example_id),
answers AS (SELECT *, answer_sum_logprob - best_wrong_sum_logprob AS sum_logprob_margin, best_wrong_mean_nll - answer_mean_nll AS mean_nll_margin, (gold_rank_sum_logprob = 1)::BIGINT AS rank_correct_sum_logprob, (gold_rank_mean_nll = 1)::BIGINT AS rank_correct_mean_nll FROM ans)"""
_ROUND = lambda names: ", ".join(f"round({x}, 6) AS {x}" for x in names)
_FAIL = f"""{_CAND}, fg AS (SELECT CASE grouping_id(target_length, evidence_position, task_type, answer_type) {" ".join(f"WHEN {sum(1 << (3 - k) for k, c in enumerate(ranking.CELL) if c not in x)} THEN '{'+'.join(x)}'" for x in ranking.DIMENSIONS)} END AS group_by,
  target_length, evidence_position, task_type, answer_type, count(*) AS n, sum(1 - rank_correct_sum_logprob)::BIGINT AS failures, avg(1 - rank_correct_sum_logprob) AS failure_rate, avg(sum_logprob_margin) AS mean_margin, avg(gold_rank_sum_logprob) AS mean_gold_rank, avg(evidence_to_answer_distance) AS mean_distance
  FROM answers WHERE num_candidates > 1 GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(x) + ")" for x in ranking.DIMENSIONS)}))"""
_FAIL_OUT = "group_by, target_length, evidence_position, task_type, answer_type, n, failures, round(failure_rate, 6) AS failure_rate, round(mean_margin, 6) AS mean_margin, round(mean_gold_rank, 6) AS mean_gold_rank, round(mean_distance, 6) AS mean_distance"
_W = "a.raw"
_ATT = f"""w0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS m, (39 + vec_id % 25)::INT AS query FROM embeddings),
w1 AS (SELECT *, list_transform(m, lambda x: x / list_sum(m)) AS probs FROM w0),
w2 AS (SELECT *, probs[1:query + 1] AS raw, query + 1 AS n FROM w1),
w3 AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM w2),
w4 AS (SELECT *, list_reverse_sort(p) AS down, list_transform(range(1, n + 1), lambda k: list_sum(p[n - k + 1:n])) AS cum FROM w3),
att AS (SELECT vec_id AS example, CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'scaled' END AS method, vec_id % 4 AS layer, vec_id // 4 % 3 AS head, label / 10.0::DOUBLE AS position_ratio,
  -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-20)))) AS entropy, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-20)))) / ln(n) AS entropy_norm, down[1] AS top1_mass, list_sum(down[1:5]) AS top5_mass, list_sum(p[1:16]) AS sink_mass_first16,
  list_sum(raw[n - 7:n]) AS local_mass_8, list_sum(raw[n - 15:n]) AS local_mass_16, list_sum(raw[n - 31:n]) AS local_mass_32, coalesce(list_sum(raw[1:n - 32]), 0) AS far_mass_32_plus, CASE WHEN n > 48 THEN list_sum(raw[1:n - 48]) ELSE 0 END AS far_mass_48_plus,
  CASE WHEN label < 8 THEN coalesce(list_sum(raw[label * 4 + 1:least(n, label * 4 + 6)]), 0) ELSE 'nan'::DOUBLE END AS evidence_mass, coalesce(list_position(list_transform(cum, lambda x: x >= 0.8), true), n)::DOUBLE AS effective_span_80 FROM w4)"""
_ATT_MEANS = ", ".join(f"coalesce(avg({x}) FILTER (WHERE NOT isnan({x})), 'nan'::DOUBLE) AS {x}" for x in ATTENTION)


def _attention_sql(keys: str, cast: str) -> str:
    return f"WITH {_ATT}, am AS (SELECT {keys}, count(*) AS n, {_ATT_MEANS} FROM att GROUP BY {keys}) SELECT {cast}, n, {_ROUND(ATTENTION)}, round((1 - entropy_norm + top5_mass + sink_mass_first16) / 3, 6) AS collapse_score FROM am"


_LOG = "lg AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, epoch_us(ts) / 1e6::DOUBLE AS t, value AS loss FROM events), l2 AS (SELECT *, step * 4096 AS tokens_seen FROM lg), l3 AS (SELECT *, (tokens_seen - lag(tokens_seen) OVER w) / greatest(1e-6, t - lag(t) OVER w) AS tok_per_s, row_number() OVER w AS up, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS down FROM l2 WINDOW w AS (PARTITION BY run ORDER BY step))"
_BUCKET = "CASE WHEN predicted_index < 0 THEN 'not_in_context' WHEN predicted_index = 0 THEN 'target_0' " + " ".join(f"WHEN predicted_index / greatest(1, num_keys - 1)::DOUBLE < {b} THEN '{n}'" for b, n in T.INDEX_BUCKETS) + " ELSE 'end_90_100' END"
_NEEDLE = f"""c AS (SELECT l AS context_length_target, p AS position_ratio, x AS sample_index FROM (SELECT unnest([256, 512]) AS l), (SELECT unnest({POSITIONS}::DOUBLE[]) AS p), (SELECT c_custkey AS x FROM customer)),
n1 AS (SELECT *, lpad((('0x' || substr(md5('{SEED}:' || context_length_target || ':' || printf('%.2f', position_ratio) || ':' || sample_index), 1, 8))::BIGINT % 1000000)::VARCHAR, 6, '0') AS answer, greatest(2, (context_length_target - 15) // 7)::INT AS lines FROM c),
n2 AS (SELECT *, greatest(1, floor(lines * position_ratio)::INT) AS ahead FROM n1), n3 AS (SELECT *, greatest(1, lines - ahead) AS after FROM n2),
n4 AS (SELECT *, array_to_string(list_transform(range(1, ahead + 1), lambda i: 'Reference item ' || lpad(i::VARCHAR, 5, '0') || ' is on file.' || chr(10)), '') AS before, 'The access code is ' || answer || '.' || chr(10) AS evidence,
  array_to_string(list_transform(range(1, after + 1), lambda i: 'Reference item ' || lpad((i + ahead)::VARCHAR, 5, '0') || ' is on file.' || chr(10)), '') AS behind FROM n3),
n5 AS (SELECT *, before || evidence || behind || 'Question: What is the access code?' || chr(10) || 'Answer:' AS text FROM n4)"""

QUERIES: dict[str, Query] = {
    "litm_grid": (litm_grid, f"SELECT source_index, n::BIGINT AS num_keys, p AS position_ratio, round_even(p * (n - 1), 0)::BIGINT AS target_index FROM (SELECT DISTINCT o_orderkey // {GROUP} AS source_index FROM orders), (SELECT unnest([75, 140, 300]) AS n), (SELECT unnest({POSITIONS}::DOUBLE[]) AS p)"),
    "litm_examples": (litm_examples, f"WITH {_examples_sql(SIZES, 'kv', _SAMPLED)} SELECT {_SHOWN} FROM ex"),
    "litm_cropped": (litm_cropped, f"WITH {_examples_sql(CROPPED, 'crop', _SAMPLED)} SELECT {_SHOWN} FROM ex"),
    "minikv_examples": (minikv_examples, f"WITH {_MINI} SELECT * EXCLUDE (prompt), md5(prompt) AS prompt, len({tokens_sql('prompt')})::BIGINT AS actual_prompt_tokens FROM mini"),
    "minikv_reval": (
        minikv_reval,
        f"""WITH {_EX}, z AS (SELECT example_id, key, list_transform(string_split(prompt, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^Key: (.*?) \\| Value: (.+)$') THEN
  'Key: ' || regexp_extract(l, '^Key: (.*?) \\| Value: (.+)$', 1) || ' | Value: ' || (('0x' || substr(md5(example_id || ':' || regexp_extract(l, '^Key: (.*?) \\| Value: (.+)$', 1)), 1, 8))::BIGINT % 90000 + 10000) ELSE l END) AS l FROM ex)
SELECT example_id, key, (('0x' || substr(md5(example_id || ':' || key), 1, 8))::BIGINT % 90000 + 10000)::VARCHAR AS value, md5(array_to_string(l, chr(10))) AS prompt_md5 FROM z""",
    ),
    "record_budget_fit": (
        record_budget_fit,
        f"WITH l AS (SELECT p_partkey AS i, sum(8 + p_size % 5 + length(p_partkey::VARCHAR)) OVER (ORDER BY p_partkey) + 30 AS total FROM part), t AS (SELECT unnest({BUDGETS}) AS target_tokens) SELECT target_tokens::BIGINT AS target_tokens, i::BIGINT AS num_records, total::BIGINT AS tokens FROM l, t QUALIFY row_number() OVER (PARTITION BY target_tokens ORDER BY abs(total - target_tokens), i) = 1",
    ),
    "needle_probe": (
        needle_probe,
        f"WITH {_NEEDLE} SELECT 'needle' || context_length_target || '_pos' || printf('%.2f', position_ratio) || '_sample' || sample_index AS example_id, context_length_target::BIGINT AS context_length_target, position_ratio, sample_index::BIGINT AS sample_index, answer, md5(text) AS prompt, len({tokens_sql('before')})::BIGINT AS evidence_token_start, (len({tokens_sql('before')}) + len({tokens_sql('evidence')}))::BIGINT AS evidence_token_end, len({tokens_sql('text')})::BIGINT AS actual_prompt_tokens FROM n5",
    ),
    "score_litm": (score_litm, f"WITH {_SC} SELECT example_id, {', '.join(x if x != 'predicted_position_ratio' else 'round(predicted_position_ratio, 6) AS predicted_position_ratio' for x in SCORES)} FROM sc"),
    "score_minikv": (
        score_minikv,
        f"""WITH {_MINI}, a AS (SELECT *, ('0x' || substr(md5('m' || example_id), 1, 1))::INT AS digit, regexp_extract_all(prompt, 'Value: (\\d+)', 1) AS vals FROM mini),
b AS (SELECT *, regexp_extract(CASE WHEN digit < 8 THEN 'value ' || value WHEN digit < 12 THEN vals[2] WHEN digit < 14 THEN '00000000' ELSE 'none' END, '\\d+') AS predicted_value FROM a),
c AS (SELECT *, coalesce(list_position(vals, predicted_value), 0)::BIGINT - 1 AS predicted_index FROM b)
SELECT example_id, predicted_value, (predicted_value = value)::BIGINT AS exact_match, (predicted_value = '')::BIGINT AS format_error, (predicted_index >= 0)::BIGINT AS predicted_in_context,
  (predicted_value <> '' AND predicted_value <> value AND predicted_index >= 0)::BIGINT AS wrong_context_value, (predicted_value <> '' AND predicted_index < 0)::BIGINT AS hallucinated_value, predicted_index FROM c""",
    ),
    "summary_cell": (
        summary_cell,
        f"WITH {_SC} SELECT num_keys, position_ratio, count(*) AS n, round(avg(actual_prompt_tokens), 6) AS mean_prompt_tokens, round(avg(target_index), 6) AS mean_target_index, {_RATES}, round(sum(CASE WHEN predicted_in_context = 1 THEN abs_index_delta ELSE 0 END) / greatest(1, sum(predicted_in_context))::DOUBLE, 6) AS mean_abs_index_delta_when_in_context, round(avg(latency_sec), 6) AS mean_latency_sec FROM sc GROUP BY num_keys, position_ratio",
    ),
    "summary_official_merge": (
        summary_official_merge,
        f"""WITH {_SC2}, u AS (SELECT *, 0 AS shard FROM sc UNION ALL SELECT *, 1 FROM sq WHERE sample_index % 2 = 0), m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY shard DESC) = 1),
a AS (SELECT num_keys, position_ratio, count(*) AS n, {_RATES}, round(avg(abs_index_delta), 6) AS mean_abs_index_delta FROM m GROUP BY 1, 2), grid AS (SELECT {SIZES[0]}::BIGINT AS num_keys, unnest({[*POSITIONS, 0.9]}::DOUBLE[]) AS position_ratio)
SELECT num_keys, position_ratio, coalesce(n, 0)::BIGINT AS n, {", ".join(f"coalesce({x}, 0)::DOUBLE AS {x}" for x in [*scoring.RATES, "mean_abs_index_delta"])} FROM grid LEFT JOIN a USING (num_keys, position_ratio)""",
    ),
    "error_class_share": (error_class_share, f"WITH {_SC}, c AS (SELECT num_keys, position_ratio, error_class, count(*) AS n FROM sc GROUP BY 1, 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY num_keys, position_ratio), 6)::DOUBLE AS share FROM c"),
    "error_bucket_pivot": (
        error_bucket_pivot,
        f"WITH {_SC}, b AS (SELECT *, {_BUCKET} AS bucket FROM sc WHERE position_ratio = 0) SELECT num_keys, position_ratio, count(*) AS n, sum(exact_match)::BIGINT AS correct, count(*) FILTER (WHERE exact_match = 0) AS error_n, "
        + ", ".join(f"count(*) FILTER (WHERE exact_match = 0 AND bucket = '{x}') AS {x}_count, coalesce(round(count(*) FILTER (WHERE exact_match = 0 AND bucket = '{x}') / nullif(count(*) FILTER (WHERE exact_match = 0), 0)::DOUBLE, 6), 0) AS {x}_rate" for x in T.INDEX_BUCKET_NAMES)
        + " FROM b GROUP BY num_keys, position_ratio",
    ),
    "cell_diagnosis": (
        cell_diagnosis,
        f"WITH {_SC} SELECT num_keys, position_ratio, count(*) AS n, round(avg(first_value_match), 6) AS accuracy, round(avg(target_index), 6) AS mean_target_index, round(avg(target_record_token_start::DOUBLE / actual_prompt_tokens), 6) AS mean_token_ratio, round(avg(abs_index_delta), 6) AS mean_abs_index_delta FROM sc GROUP BY 1, 2",
    ),
    "resume_pending": (resume_pending, f"WITH {_EX} SELECT example_id, sample_index FROM ex WHERE ('0x' || substr(md5('d' || example_id), 1, 1))::INT >= 9"),
    "run_union": (
        run_union,
        f"WITH {_SC2} SELECT num_keys, position_ratio, round(avg(exact_match), 6) AS accuracy, round(avg(format_error), 6) AS format_error, 'first' AS model FROM sc GROUP BY 1, 2 UNION ALL SELECT num_keys, position_ratio, round(avg(exact_match), 6), round(avg(format_error), 6), 'second' FROM sq GROUP BY 1, 2",
    ),
    "pair_compare": (pair_compare, f"WITH {_SC2} SELECT sc.error_class AS class_a, sq.error_class AS class_b, count(*) AS n, count(*) FILTER (WHERE sc.generated_text = sq.generated_text) AS equal_text FROM sc JOIN sq USING (example_id) GROUP BY 1, 2"),
    "sample_consistency": (
        sample_consistency,
        f"WITH {_EX}, s2 AS (SELECT num_keys, position_ratio, list_sort(list(DISTINCT source_index)) AS x FROM ex GROUP BY 1, 2) SELECT num_keys, count(DISTINCT position_ratio) AS positions, max(len(x))::BIGINT AS sources, count(DISTINCT x) = 1 AS consistent FROM s2 GROUP BY num_keys",
    ),
    "mean_of_cells": (mean_of_cells, f"WITH {_SC}, c AS (SELECT num_keys, position_ratio, avg(first_value_match) AS a FROM sc GROUP BY 1, 2) SELECT num_keys, round(avg(a), 6) AS mean_accuracy FROM c GROUP BY num_keys"),
    "candidate_ranks": (
        candidate_ranks,
        f"WITH {_CAND} SELECT example_id, candidate_index::BIGINT AS candidate_index, row_number() OVER (PARTITION BY example_id ORDER BY candidate_sum_logprob DESC, candidate_index) AS rank_sum, row_number() OVER (PARTITION BY example_id ORDER BY candidate_mean_nll, candidate_index) AS rank_mean FROM cand",
    ),
    "answer_margins": (
        answer_margins,
        f"WITH {_CAND} SELECT example_id, target_length, evidence_position, task_type, answer_type, gold_value, gold_rank_sum_logprob, gold_rank_mean_nll, rank_correct_sum_logprob, rank_correct_mean_nll, num_candidates, {_ROUND(('answer_sum_logprob', 'answer_mean_nll', 'evidence_to_answer_distance', 'best_wrong_sum_logprob', 'best_wrong_mean_nll', 'sum_logprob_margin', 'mean_nll_margin'))} FROM answers",
    ),
    "rank_rollup": (
        rank_rollup,
        f"""WITH {_CAND} SELECT CASE WHEN grouping(target_length) = 1 THEN 'ALL' ELSE target_length::VARCHAR END AS target_length, CASE WHEN grouping(evidence_position) = 1 THEN 'ALL' ELSE evidence_position END AS evidence_position, CASE WHEN grouping(task_type) = 1 THEN 'ALL' ELSE task_type END AS task_type, CASE WHEN grouping(answer_type) = 1 THEN 'ALL' ELSE answer_type END AS answer_type,
  (4 - grouping(target_length) - grouping(evidence_position) - grouping(task_type) - grouping(answer_type))::BIGINT AS level, count(*) AS n, round(avg(answer_mean_nll), 6) AS answer_mean_nll, round(exp(least(80.0::DOUBLE, avg(answer_mean_nll))), 6) AS answer_ppl, round(avg(sum_logprob_margin), 6) AS mean_sum_logprob_margin, round(avg(mean_nll_margin), 6) AS mean_mean_nll_margin,
  round(avg(rank_correct_sum_logprob), 6) AS rank_acc_sum_logprob, round(avg(rank_correct_mean_nll), 6) AS rank_acc_mean_nll, round(avg(gold_rank_sum_logprob), 6) AS mean_gold_rank_sum_logprob, round(avg(gold_rank_mean_nll), 6) AS mean_gold_rank_mean_nll, round(avg(evidence_to_answer_distance), 6) AS mean_distance
FROM answers WHERE num_candidates > 1 GROUP BY ROLLUP (target_length, evidence_position, task_type, answer_type)""",
    ),
    "failure_groups": (failure_groups, f"WITH {_FAIL} SELECT {_FAIL_OUT} FROM fg"),
    "top_failures": (top_failures, f"WITH {_FAIL} SELECT {_FAIL_OUT} FROM (SELECT * FROM fg ORDER BY failure_rate DESC, failures DESC, group_by, task_type NULLS FIRST, target_length NULLS FIRST, answer_type NULLS FIRST, evidence_position NULLS FIRST LIMIT 10)"),
    "best_wrong": (
        best_wrong,
        f"WITH {_CAND} SELECT example_id, max(CASE WHEN a = 1 THEN candidate_value END) AS best_wrong_value_sum, max(CASE WHEN b = 1 THEN candidate_value END) AS best_wrong_value_mean FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY candidate_sum_logprob DESC, candidate_index) AS a, row_number() OVER (PARTITION BY example_id ORDER BY candidate_mean_nll, candidate_index) AS b FROM cand WHERE candidate_index > 0) GROUP BY example_id",
    ),
    "hard_negatives": (
        hard_negatives,
        f"WITH {_CAND}, h AS (SELECT example_id, list(candidate_value ORDER BY candidate_sum_logprob DESC, candidate_index)[1:4] AS l FROM cand WHERE candidate_index > 0 GROUP BY example_id) SELECT example_id, array_to_string(list_transform(range(1, 5), lambda i: l[least(i, len(l))]), ',') AS negatives FROM h",
    ),
    "attention_metrics": (attention_metrics, f"WITH {_ATT} SELECT example, {_ROUND(ATTENTION)} FROM att"),
    "attention_layer_head": (attention_layer_head, _attention_sql("layer, head", "layer, head")),
    "attention_method_position": (attention_method_position, _attention_sql("method, position_ratio", "method, position_ratio")),
    "trainlog_throughput": (trainlog_throughput, f"WITH {_LOG} SELECT run, step, round(tok_per_s, 6) AS tok_per_s FROM l3"),
    "trainlog_summary": (
        trainlog_summary,
        f"""WITH {_LOG} SELECT run, count(*) AS records, min(step) AS first_step, max(step) AS last_step, round(arg_min(loss, step), 6) AS loss_first, round(arg_max(loss, step), 6) AS loss_last, round(min(loss), 6) AS loss_min, round(avg(loss) FILTER (WHERE up <= 10), 6) AS loss_first_mean, round(avg(loss) FILTER (WHERE down <= 10), 6) AS loss_last_mean,
  round(median(tok_per_s), 6) AS tok_per_s_median, round(max(t) - min(t), 6) AS elapsed_s, arg_max(tokens_seen, step) - arg_min(tokens_seen, step) AS tokens, round((arg_max(tokens_seen, step) - arg_min(tokens_seen, step)) / nullif(max(t) - min(t), 0), 6) AS tok_per_s_wall FROM l3 GROUP BY run""",
    ),
    "lr_schedule": (
        lr_schedule,
        "SELECT event_id, step::BIGINT AS step, round(1e6::DOUBLE * CASE WHEN step < 100 THEN 3e-4::DOUBLE * (step + 1) / 100 WHEN step >= 1000 THEN 3e-5::DOUBLE ELSE 3e-5::DOUBLE + (3e-4::DOUBLE - 3e-5::DOUBLE) * 0.5::DOUBLE * (1 + cos(pi() * (step - 100) / 900.0::DOUBLE)) END, 6) AS lr_millionths FROM (SELECT event_id, event_id % 1200 AS step FROM events)",
    ),
    "train_val_split": (
        train_val_split,
        f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) <= greatest(1, (count(*) OVER () * 0.05::DOUBLE)::BIGINT) THEN 'val' ELSE 'train' END AS part FROM documents",
    ),
}
