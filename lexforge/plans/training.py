"""Queries of training-example generators, loop inputs, token losses and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import generators, listing, ranking, training
from lexforge.plans import evaluation as E
from lexforge.plans.common import Query, plain, table, token_id_sql, tokens_sql

RECORDS, SEED, NEAR = 8, 42, 5


def hard_values(spark, d):
    """A gold value for each customer, and near misses of a family that a hash picks."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("s"))
    kind = F.when(generators.number(F.col("s"), "t") % 2 == 0, "number").otherwise("alphanumeric")
    family = F.element_at(F.array(*[F.lit(x) for x in generators.FAMILIES]), (generators.number(F.col("s"), "f") % 4 + 1).cast("int"))
    rows = c.withColumn("kind", kind).withColumn("family", family).withColumn("gold", generators.value_of(F.concat(F.lit("g"), "s"), F.col("kind")))
    return plain(rows.withColumn("negatives", F.array_join(generators.near_misses(F.col("gold"), F.col("kind"), F.col("family"), F.col("s"), NEAR), ",")))


def _groups(spark, d):
    """Every supplier's groups, one for each template."""
    return generators.groups(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("g")), RECORDS, SEED)


def multi_query_examples(spark, d):
    q = generators.queries_of(_groups(spark, d))
    return plain(q.withColumn("prompt", F.md5("prompt")).withColumn("distractor_values", F.array_join("distractor_values", ",")))


def record_fit(spark, d):
    return plain(generators.fitted(_groups(spark, d), 70, 3))


def build_counters(spark, d):
    return plain(generators.counters(generators.queries_of(_groups(spark, d)), ["task_type", "split", "answer_type"]))


def loss_masks(spark, d):
    """Customer names as prompts, segments as answers."""
    c = table(spark, d, "customer").select(
        "c_custkey", T.token_ids(F.concat(F.lit("The market segment of "), "c_name", F.lit(" is"))).alias("prompt_ids"), T.token_ids(F.col("c_mktsegment")).alias("answer_ids"), T.token_ids(F.lit(".")).alias("suffix_ids")
    )
    out = training.answer_rows(c, 8)
    return plain(out.select("c_custkey", *[F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(x) for x in ("input_ids", "target_ids", "loss_mask")]))


def negative_samples(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"), F.min("c_mktsegment").alias("gold"))
    return plain(c.select("c_nationkey", "gold", F.array_join(training.negatives(F.col("gold"), F.col("v"), F.col("c_nationkey").cast("string"), 6, SEED), ",").alias("negatives")))


def sampler_shards(spark, d):
    return plain(training.dealt(table(spark, d, "documents").select("doc_id"), "doc_id", 3, SEED))


def epoch_mix(spark, d):
    return plain(training.mixed(table(spark, d, "events").select(F.col("event_id").alias("step")), 7, 12))


def token_losses(spark, d):
    """Weights of the vectors as token probabilities."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.log(F.least(F.lit(1.0), F.abs(x.cast("double")) + 1e-6))).alias("lp"))
    return plain(v.withColumns(training.losses(F.col("lp"))).drop("lp"))


def window_lookup(spark, d):
    """Orders of each customer as a shard's windows; every index of all of them is looked up."""
    orders = table(spark, d, "orders")
    w = orders.groupBy(F.col("o_custkey").alias("shard_idx")).agg(F.count("*").alias("n"))
    return plain(training.locate(w, spark.range(orders.count()).withColumnRenamed("id", "i")))


def _listing(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("dataset"), F.lit("org/repo").alias("repo"), F.concat(F.lit("data/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".parquet").otherwise(".json")).alias("path"), (F.col("p_size").cast("long") * 1024).alias("size"))


def download_check(spark, d):
    files = listing.selected(_listing(spark, d), r"\.parquet$")
    present = files.filter(F.col("size") % 5 != 0).withColumn("size", F.when(F.col("size") % 7 == 0, F.col("size") - 1).otherwise(F.col("size")))
    return plain(listing.completeness(files, present))


def checkpoint_rates(spark, d):
    """Rates of two runs, by checkpoint and size."""
    rows = None
    for name, salt in (("early", "p"), ("late", "q")):
        r = E._scored(spark, d, salt).withColumn("checkpoint", F.lit(name))
        rows = r if rows is None else rows.unionByName(r)
    names = {"exact_match": "exact_match", "format_error_rate": "format_error", "wrong_context_rate": "wrong_context_value", "hallucinated_rate": "hallucinated_value"}
    return plain(rows.groupBy("checkpoint", "num_keys").agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in names.items()]))


def index_quarters(spark, d):
    """Of wrong answers: counts by quarter of the predicted index; those without an index stand apart."""
    wrong = E._scored(spark, d).filter("first_value_match = 0").withColumn("bucket", T.quarter_bucket(F.col("predicted_index"), 8))
    return plain(wrong.groupBy("position_ratio", "bucket").agg(F.count("*").alias("n")))


def failure_counts(spark, d):
    failed = ranking.answers(E._candidates(spark, d)).filter("num_candidates > 1 AND rank_correct_sum_logprob = 0")
    return plain(generators.counters(failed, ["task_type", "target_length", "answer_type", "evidence_position"]))


def positional_join(spark, d):
    """Examples with the source row of their index, the row's place being a column of its own."""
    ex = E._examples(spark, d).select("example_id", "source_index", "key")
    return plain(ex.join(E._sources(spark, d).select("source_index", F.size("records").alias("records"), F.col("key").alias("source_key")), "source_index"))


def _number(c: str, salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {c}), 1, 7))::BIGINT"


def _letter(n: str) -> str:
    return f"substr('{generators.LETTERS}', (({n}) % 24 + 1)::INT, 1)"


def _value(c: str, kind: str) -> str:
    return f"CASE WHEN {kind} = 'number' THEN ({_number(c, 'n')} % 90000 + 10000)::VARCHAR ELSE {_letter(_number(c, 'a'))} || {_letter(_number(c, 'b'))} || '-' || ({_number(c, 'd')} % 9000 + 1000) END"


def _mutated(v: str, s: str) -> str:
    places = f"list_filter(range(1, length({v}) + 1), lambda j: regexp_matches(substr({v}, j::INT, 1), '[A-Za-z0-9]'))"
    at = f"{places}[({_number(s, 'p')} % len({places}) + 1)::INT]::INT"
    old, r = f"substr({v}, {at}, 1)", _number(s, "r")
    index = f"(instr('{generators.LETTERS}', {old}) - 1)"
    new = f"CASE WHEN regexp_matches({old}, '[0-9]') THEN ((try_cast({old} AS INT) + 1 + {r} % 9) % 10)::VARCHAR WHEN {index} >= 0 THEN {_letter(f'{index} + 1 + {r} % 23')} ELSE {_letter(r)} END"
    return f"(substr({v}, 1, {at} - 1) || {new} || substr({v}, {at} + 1))"


_S = "(s || ':' || i)"
_FRESH = _value(_S, "kind")
_HARD = f"""WITH c AS (SELECT c_custkey::VARCHAR AS s FROM customer),
k AS (SELECT s, CASE WHEN {_number('s', 't')} % 2 = 0 THEN 'number' ELSE 'alphanumeric' END AS kind, {list(generators.FAMILIES)}[({_number('s', 'f')} % 4 + 1)::INT] AS family FROM c),
g AS (SELECT *, {_value("('g' || s)", 'kind')} AS gold FROM k), t AS (SELECT *, unnest(range(1, {2 * NEAR + 5})) AS i FROM g),
u AS (SELECT s, kind, family, gold, i, CASE WHEN family = 'same_value_prefix' THEN substr(gold, 1, 3) || substr({_FRESH}, 4) WHEN family = 'same_value_suffix' THEN substr({_FRESH}, 1, length({_FRESH}) - 3) || right(gold, 3)
  WHEN family = 'single_char_near_miss' OR {_number(_S, 'm')} % 100 < 65 THEN {_mutated('gold', _S)} ELSE {_FRESH} END AS v FROM t),
w AS (SELECT s, kind, family, gold, v, min(i) AS i FROM u WHERE v <> gold GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY i) AS n FROM w)
SELECT s, kind, family, gold, string_agg(v, ',' ORDER BY i) AS negatives FROM r WHERE n <= {NEAR} GROUP BY ALL"""
_TEMPLATES = ", ".join("(" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in row) + ")" for row in generators.TEMPLATES)
_R = "(group_id || '/' || i)"
_LINE = "replace(replace(line, '{key}', r.key), '{value}', r.value)"
_GROUPS = f"""t(task_type, split, header, line, final) AS (VALUES {_TEMPLATES}),
g0 AS (SELECT '{SEED}-' || task_type || '-' || split || '-' || g AS group_id, * FROM t, (SELECT s_suppkey AS g FROM supplier)),
g1 AS (SELECT *, CASE WHEN {_number('group_id', 't')} % 100 < 60 THEN 'alphanumeric' ELSE 'number' END AS answer_type FROM g0),
g2 AS (SELECT *, unnest(range(0, {RECORDS})) AS i FROM g1),
g3 AS (SELECT *, {_letter(_number(_R, 'k'))} || lpad(({_number(_R, 'l')} % 1000)::VARCHAR, 3, '0') || lpad(i::VARCHAR, 2, '0') AS key, {_value(_R, 'answer_type')} AS value FROM g2),
gr AS (SELECT group_id, task_type, split, answer_type, header, line, final, list({{'key': key, 'value': value}} ORDER BY i) AS records FROM g3 GROUP BY ALL)"""
_BODY = lambda x: f"array_to_string(list_transform({x}, lambda r: {_LINE}), '')"
_QUERIES_OF = f"""{_GROUPS}, q0 AS (SELECT *, unnest(range(1, {RECORDS} + 1)) AS q FROM gr),
q1 AS (SELECT *, records[q] AS r, header || {_BODY("records")} || replace(replace(final, '{{key}}', records[q].key), '{{value}}', records[q].value) AS prompt, header || {_BODY("records[1:q - 1]")} AS before FROM q0),
qs AS (SELECT group_id || '-q' || (q - 1) AS example_id, task_type, split, answer_type, r.key AS key, r.value AS gold_value, array_to_string(list_transform(list_concat(records[1:q - 1], records[q + 1:]), lambda x: x.value), ',') AS distractor_values, md5(prompt) AS prompt,
  len({tokens_sql('prompt')})::BIGINT AS prompt_tokens, len({tokens_sql('before')})::BIGINT AS evidence_token_start, (len({tokens_sql('before')}) + len({tokens_sql(_LINE)}))::BIGINT AS evidence_token_end FROM q1)"""
_IDS = lambda x: f"list_transform({tokens_sql(x)}, lambda t: {token_id_sql('t')})"
_FILES = "f AS (SELECT p_brand AS dataset, 'data/' || p_partkey || '.parquet' AS path, p_size::BIGINT * 1024 AS size FROM part WHERE p_size % 3 = 0)"

QUERIES: dict[str, Query] = {
    "hard_values": (hard_values, _HARD),
    "multi_query_examples": (multi_query_examples, f"WITH {_QUERIES_OF} SELECT *, prompt_tokens - evidence_token_end AS evidence_to_answer_distance FROM qs"),
    "record_fit": (
        record_fit,
        f"""WITH {_GROUPS}, l AS (SELECT group_id, len({tokens_sql('header')}) + len({tokens_sql("replace(replace(final, '{key}', records[1].key), '{value}', '')")}) AS fixed_n, unnest(list_transform(records, lambda r: len({tokens_sql(_LINE)}))) AS n, unnest(range(0, {RECORDS})) AS i FROM gr),
r AS (SELECT group_id, i, fixed_n + sum(n) OVER (PARTITION BY group_id ORDER BY i) AS tokens FROM l) SELECT group_id, (max(i) + 1)::BIGINT AS kept, max(tokens)::BIGINT AS tokens FROM r WHERE tokens <= 70 GROUP BY group_id HAVING max(i) + 1 >= 3""",
    ),
    "build_counters": (build_counters, f"WITH {_QUERIES_OF} " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS n FROM qs GROUP BY {x}" for x in ("task_type", "split", "answer_type"))),
    "loss_masks": (
        loss_masks,
        f"""WITH c AS (SELECT c_custkey, {_IDS("'The market segment of ' || c_name || ' is'")} AS p, {_IDS("c_mktsegment")} AS a, {_IDS("'.'")} AS x FROM customer),
t AS (SELECT *, p[greatest(0, len(p) + len(a) + len(x) - 9) + 1:] AS q FROM c), i AS (SELECT *, list_resize(list_concat(list_concat(q, a), x), 9, 0) AS ids FROM t)
SELECT c_custkey, array_to_string(ids[1:8], ',') AS input_ids, array_to_string(ids[2:9], ',') AS target_ids, array_to_string(list_transform(range(0, 8), lambda k: (k >= len(q) - 1 AND k < len(q) - 1 + len(a))::INT), ',') AS loss_mask FROM i""",
    ),
    "negative_samples": (
        negative_samples,
        f"""WITH c AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS v, min(c_mktsegment) AS gold FROM customer GROUP BY 1),
o AS (SELECT c_nationkey, gold, v, unnest(list_filter(v, lambda x: x <> gold)) AS x FROM c), s AS (SELECT c_nationkey, list(x ORDER BY md5('{SEED}:' || c_nationkey || '/' || x)) AS own FROM o GROUP BY 1),
f AS (SELECT c_nationkey, unnest(range(1, 15)) AS i FROM c), n AS (SELECT c_nationkey, x, min(i) AS i FROM (SELECT *, (('0x' || substr(md5(c_nationkey || '/{SEED}/' || i), 1, 7))::BIGINT % 90000 + 10000)::VARCHAR AS x FROM f) GROUP BY 1, 2),
fill AS (SELECT c_nationkey, list(x ORDER BY i) AS more FROM n GROUP BY 1)
SELECT c_nationkey::BIGINT AS c_nationkey, gold, array_to_string(list_concat(coalesce(own, []), more)[1:6], ',') AS negatives FROM c LEFT JOIN s USING (c_nationkey) JOIN fill USING (c_nationkey)""",
    ),
    "sampler_shards": (sampler_shards, f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, p % 3 AS rank, p // 3 AS nth FROM o WHERE p < n - n % 3"),
    "epoch_mix": (epoch_mix, "SELECT step, step % 7 AS replay_batch, step % 12 AS retrieval_batch, step // 12 AS epoch FROM (SELECT event_id AS step FROM events)"),
    "token_losses": (
        token_losses,
        "WITH l AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: ln(least(1.0::DOUBLE, abs(x::DOUBLE) + 1e-6)))) AS s, len(embedding) AS n FROM embeddings) SELECT vec_id, round(s, 6) AS sum_logprob, round(-s / n, 6) AS mean_nll, round(exp(least(80.0::DOUBLE, -s / n)), 6) AS ppl FROM l",
    ),
    "window_lookup": (
        window_lookup,
        "WITH w AS (SELECT o_custkey AS shard_idx, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shard_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM w) SELECT i, shard_idx, i - first AS local FROM f, (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS i) WHERE i >= first AND i < first + n",
    ),
    "download_check": (
        download_check,
        f"WITH {_FILES}, p AS (SELECT dataset, path, CASE WHEN size % 7 = 0 THEN size - 1 ELSE size END AS found FROM f WHERE size % 5 <> 0) SELECT dataset, count(*) AS files, count(*) FILTER (WHERE found = size) AS complete, count(*) FILTER (WHERE found IS NULL) AS missing, count(*) FILTER (WHERE found <> size) AS wrong_size, sum(size)::BIGINT AS bytes, round(sum(size) / 1073741824.0::DOUBLE, 6) AS gib FROM f LEFT JOIN p USING (dataset, path) GROUP BY dataset",
    ),
    "checkpoint_rates": (
        checkpoint_rates,
        f"WITH {E._SC2}, u AS (SELECT 'early' AS checkpoint, * FROM sc UNION ALL SELECT 'late', * FROM sq) SELECT checkpoint, num_keys, count(*) AS n, round(avg(exact_match), 6) AS exact_match, round(avg(format_error), 6) AS format_error_rate, round(avg(wrong_context_value), 6) AS wrong_context_rate, round(avg(hallucinated_value), 6) AS hallucinated_rate FROM u GROUP BY 1, 2",
    ),
    "index_quarters": (
        index_quarters,
        f"WITH {E._SC} SELECT position_ratio, CASE WHEN predicted_index < 0 THEN 'no_index' WHEN predicted_index < 2 THEN '0-1' WHEN predicted_index < 4 THEN '2-3' WHEN predicted_index < 6 THEN '4-5' ELSE '6-7' END AS bucket, count(*) AS n FROM sc WHERE first_value_match = 0 GROUP BY 1, 2",
    ),
    "failure_counts": (
        failure_counts,
        f"WITH {E._CAND}, x AS (SELECT * FROM answers WHERE num_candidates > 1 AND rank_correct_sum_logprob = 0) " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c}::VARCHAR AS value, count(*) AS n FROM x GROUP BY {c}" for c in ("task_type", "target_length", "answer_type", "evidence_position")),
    ),
    "positional_join": (positional_join, f"WITH {E._EX} SELECT ex.example_id, ex.source_index, ex.key, len(s.records)::BIGINT AS records, s.key AS source_key FROM ex JOIN s USING (source_index)"),
}
