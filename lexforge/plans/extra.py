"""Queries of the other benchmarks' scores, gates of the corpus plan, targets, orders, parameters and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import params
from lexforge.functions import text as T
from lexforge.operators import corpus, generators, quality, ranking, retrieval, scoring, tokenmetrics, training
from lexforge.plans import evaluation as E
from lexforge.plans import training as TR
from lexforge.plans.common import Query, documents, plain, spread, table

SEED, FIRST, BATCH, TOP = 42, 5, 7, 5
PHASES = {"16k": (60_000, {"src0": 0.7, "src1": 0.3}), "8k": (180_000, {"src0": 0.5, "src1": 0.25, "src2": 0.25}), "4k": (360_001, {"src0": 0.45, "src1": 0.35, "src2": 0.2})}
SCALE = 0.37


def _answered(rows, salt: str, answer: str = "answer"):
    """Rows with a generated text by a digit of a hash: the answer, in a sentence, another number, two lines, or none."""
    digit = E._digit(F.col("example_id"), salt)
    a = F.col(answer)
    said = F.when(digit < 5, a).when(digit < 8, F.concat(F.lit("It is "), a, F.lit(", not 7"))).when(digit < 11, F.lit("1234567 1")).when(digit < 13, F.concat(F.lit(" \n  "), a, F.lit(" \nmore"))).otherwise(F.lit("none"))
    return rows.withColumn("generated_text", said).withColumn("latency_sec", (digit + 1) / 16.0)


def _probes(spark, d, salt):
    return scoring.score_number(_answered(retrieval.needles(spark, [256, 512], E.POSITIONS, E._asked(spark, d), SEED), salt))


def score_position(spark, d):
    return plain(_probes(spark, d, "p").select("example_id", "exact_match", "contains_answer", "first_number", "first_number_match"))


def summary_position(spark, d):
    return plain(scoring.mean_summary(_probes(spark, d, "p"), ["context_length_target", "position_ratio"], scoring.POSITION_MEANS).orderBy("context_length_target", "position_ratio"))


def score_generation(spark, d):
    return plain(_probes(spark, d, "g").select("example_id", "exact_match", "contains_answer", "first_number", "first_number_match", "num_numbers", "format_error"))


def summary_generation(spark, d):
    rows = _probes(spark, d, "g").withColumn("method", F.lit("base")).unionByName(_probes(spark, d, "h").withColumn("method", F.lit("scaled")))
    keys = ["method", "context_length_target", "position_ratio"]
    return plain(scoring.mean_summary(rows, keys, scoring.GENERATION_MEANS).orderBy(*keys))


def attention_right_wrong(spark, d):
    """Attention means of right and wrong answers apart."""
    from lexforge.operators import attention

    rows = E._attention(spark, d).withColumn("first_number_match", (E._digit(F.col("example").cast("string"), "m") < 9).cast("int"))
    return plain(attention.means(rows, ["method", "position_ratio", "first_number_match"], E.ATTENTION))


def _budget(spark, d):
    """Small examples as those of token budgets, two answers of each; target_tokens by their size."""
    rows = retrieval.mini(spark, [4, 6, 9], [0.0, 0.5, 1.0], E._asked(spark, d), SEED).withColumn("target_tokens", F.col("num_records") * 16)
    digit = E._digit(F.col("example_id"), "b")
    listed = T.record_values(F.col("prompt"), r"\d+")
    said = F.when(digit < 8, F.concat(F.lit("value "), "value")).when(digit < 12, F.get(listed, F.lit(2))).when(digit < 14, F.lit("00000000")).otherwise(F.lit("none"))
    return scoring.score_budget(rows.withColumn("generated_text", said).withColumn("latency_sec", digit / 16.0))


BUDGET_SCORES = ("predicted_value", "exact_match", "format_error", "predicted_in_context", "wrong_context_value", "hallucinated_value", "predicted_index", "index_delta")


def score_token_budget(spark, d):
    return plain(_budget(spark, d).select("example_id", *BUDGET_SCORES))


def summary_token_budget(spark, d):
    rows = _budget(spark, d).withColumn("seq", F.col("sample_index"))
    return plain(scoring.mean_summary(rows, ["target_tokens", "position_ratio"], scoring.BUDGET_MEANS, {"num_records": "seq"}).orderBy("target_tokens", "position_ratio"))


def summary_minikv(spark, d):
    return plain(scoring.mean_summary(E._mini_scored(spark, d), ["num_records", "position_ratio"], scoring.BUDGET_MEANS).orderBy("num_records", "position_ratio"))


def _aliased(spark, d):
    """Conversations' answers over many documents: customers' names with an alias."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("example_id"), F.array(F.col("c_name"), F.concat(F.lit("No. "), F.col("c_custkey").cast("string"))).alias("aliases"), "c_custkey", "c_name")
    digit = E._digit(F.col("example_id"), "q")
    said = F.when(digit < 4, F.upper("c_name")).when(digit < 8, F.concat(F.lit("It was  no. "), F.col("c_custkey").cast("string"), F.lit(" again"))).when(digit < 11, F.lit("The name is not given.")).when(digit < 13, F.lit("  ")).otherwise(F.lit("somebody"))
    return scoring.score_aliases(c.withColumn("generated_text", said))


def score_many_documents(spark, d):
    return plain(_aliased(spark, d).select("example_id", "answer_contains", "alias_match", "no_answer", "format_error"))


def score_many_values(spark, d):
    """Three values of an order's digits asked for, others around; answers by a digit of a hash."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    num = lambda s: (generators.number(F.col("k"), s) % 90_000 + 10_000).cast("string")
    rows = o.withColumns({"values": F.array(num("a"), num("b"), num("c")), "others": F.array(num("d"), num("e"))})
    digit, join = E._digit(F.col("k"), "v"), lambda *x: F.concat_ws(", ", *x)
    said = F.when(digit < 5, join(num("a"), num("b"), num("c"))).when(digit < 9, join(num("b"), num("a"), num("d"))).when(digit < 12, join(num("a"), F.lit("7"))).otherwise(F.lit("none"))
    out = scoring.score_values(rows.withColumn("generated_text", said))
    return plain(out.select("k", "exact_match", "partial_match", "missing_value", "wrong_key", "wrong_value"))


def page_boilerplate(spark, d):
    return plain(quality.page_signals(spread(table(spark, d, "pages"))))


def chat_conversations(spark, d):
    return plain(quality.conversations(table(spark, d, "conversations")))


def chat_documents(spark, d):
    rows = documents(spark, d).select("seq", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("Hello\nUser: "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    return plain(quality.without_chat(rows).select("seq"))


def targets_by_phase(spark, d):
    """Each phase's tokens dealt to the sources of the documents by their shares of all documents."""
    weights = corpus.shares(table(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("n")), "source", "n")
    return plain(corpus.targets(weights, {p: n for p, (n, _) in PHASES.items()}, SCALE))


def source_shares(spark, d):
    """Weights of nations' customers, some below zero, over their sum."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("w"))
    return plain(corpus.shares(rows, "nation", "w"))


def rank_rollup_ordered(spark, d):
    rows = ranking.rollup(ranking.answers(E._candidates(spark, d)).filter("num_candidates > 1"))
    length = F.when(F.col("target_length") == "ALL", 10**9).otherwise(F.try_to_number("target_length", F.lit("999999999999")).cast("long"))
    place = F.row_number().over(Window.orderBy(length, "evidence_position", "task_type", "answer_type"))  # a row for each cell
    return plain(ranking.rollup_order(rows).withColumn("place", place).select("place", "target_length", "evidence_position", "task_type", "answer_type", "n"))


def merged_order(spark, d):
    """Two overlapping runs merged, on the grid, in the order of cell and sample, as they are written."""
    keep = ["example_id", "num_keys", "position_ratio", "sample_index", "exact_match", "shard"]
    a, b = (E._scored(spark, d, x).withColumn("shard", F.lit(k)).select(*keep) for k, x in enumerate("pq"))
    merged = scoring.latest(a.unionByName(b.filter("sample_index % 2 = 0")), "example_id", ["shard", "sample_index"])
    cells = retrieval.grid(spark, E.SIZES, E.POSITIONS)
    return plain(scoring.on_grid(merged, cells).orderBy("num_keys", "position_ratio", "sample_index"))


def prediction_payload(spark, d):
    rows = E._predictions(spark, d).select("example_id", "prompt", "generated_text", "latency_sec")
    return plain(scoring.payload(rows))


def top_entries(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return plain(v.select("vec_id", F.inline(ranking.top_entries(F.col("e"), TOP))))


def id_aliases(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("Digit5", "rand5digit", "five-digit", "WORD", "random-5digits", "other_kind")])
    c = table(spark, d, "customer").select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % 6 + 1).cast("int")).alias("kind"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "mini_word").otherwise("other_"), F.lit("_mini_word_"), F.col("c_custkey").cast("string")).alias("id"))
    return plain(c.select("c_custkey", params.value_type(F.col("kind")).alias("kind"), params.renamed_id(F.col("id"), "mini_word", "mini_digit5").alias("id")))


def pair_lists(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit(", ,key=1_"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("s"))
    m = params.parsed_pairs(F.col("s"))
    return plain(p.select("p_partkey", m["size"].alias("size"), m["key"].alias("key"), F.size(m).alias("n")))


def log_times(spark, d):
    """Times as logs have them, ISO 8601 with an offset, read as moments."""
    e = table(spark, d, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("time"))
    return plain(e.select("event_id", F.unix_micros(F.to_timestamp("time")).alias("micros")))


def first_of_sources(spark, d):
    return plain(corpus.first_of_source(documents(spark, d).select("seq", "source"), FIRST))


def weighted_choices(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    rows = c.select(generators.weighted(F.col("k"), "len", generators.LENGTH_WEIGHTS).alias("target_length"), generators.weighted(F.col("k"), "tpl", generators.TEMPLATE_WEIGHTS).alias("template"))
    return plain(rows.groupBy("target_length", "template").agg(F.count("*").alias("n")))


def batches(spark, d):
    rows = training.dealt(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 1, SEED)
    out = training.collated(rows, BATCH, ["c_custkey", "c_name"])
    return plain(out.select("batch", F.array_join(F.transform("c_custkey", lambda x: x.cast("string")), ",").alias("keys"), F.array_join("c_name", ",").alias("names")))


def placed_blocks(spark, d):
    """Blocks of records with filler around; the tests hold them against plain Python."""
    return plain(generators.placed_blocks(TR._groups(spark, d), 400, [0.0, 0.5, 1.0]).withColumn("prompt", F.md5("prompt")))


def shared_filler(spark, d):
    groups = TR._groups(spark, d)
    return plain(generators.with_shared_filler(generators.queries_of(groups), groups, 120).withColumn("prompt", F.md5("prompt")).drop("distractor_values"))


def dense_examples(spark, d):
    return plain(generators.dense_examples(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")), [256, 512], SEED, most=120).withColumn("prompt", F.md5("prompt")))


def dense_counters(spark, d):
    rows = generators.dense_examples(spark, table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")), [256, 512], SEED, most=120)
    return plain(generators.counters(rows, ["target_length", "evidence_position", "answer_type", "template", "family", "records_in_context"]))


def bpe_merges(spark, d):
    """The first hundred merges over the words of all documents."""
    counts = tokenmetrics.bpe_word_counts(corpus.cleaned(documents(spark, d)))
    rows = [(k, a, b, n) for k, (a, b, n) in enumerate(tokenmetrics.bpe_merges(counts, 100))]
    return plain(spark.createDataFrame(rows, "rank int, left string, right string, n long"))


def _hex(x: str, n: int = 1) -> str:
    return f"('0x' || substr(md5({x}), 1, {n}))::BIGINT"


def _answered_sql(salt: str, to: str, method: str = "base") -> str:
    digit = _hex(f"'{salt}' || example_id")
    return f"""{to}_a AS (SELECT *, 'needle' || context_length_target || '_pos' || printf('%.2f', position_ratio) || '_sample' || sample_index AS example_id FROM n5),
{to}_b AS (SELECT *, {digit} AS digit, len({E.tokens_sql('text')})::BIGINT AS actual_prompt_tokens FROM {to}_a),
{to}_c AS (SELECT *, CASE WHEN digit < 5 THEN answer WHEN digit < 8 THEN 'It is ' || answer || ', not 7' WHEN digit < 11 THEN '1234567 1' WHEN digit < 13 THEN ' ' || chr(10) || '  ' || answer || ' ' || chr(10) || 'more' ELSE 'none' END AS said FROM {to}_b),
{to} AS (SELECT *, '{method}' AS method, (digit < 5 OR (digit >= 11 AND digit < 13))::BIGINT AS exact_match, contains(said, answer)::BIGINT AS contains_answer, regexp_extract(said, '\\d+') AS first_number, (regexp_extract(said, '\\d+') = answer)::BIGINT AS first_number_match,
  len(regexp_extract_all(said, '\\d+'))::BIGINT AS num_numbers, (regexp_extract(said, '\\d+') = '')::BIGINT AS format_error, (digit + 1) / 16.0::DOUBLE AS latency_sec FROM {to}_c)"""


def _means(names: dict[str, str]) -> str:
    return ", ".join(f"round(avg({c}), 6) AS {n}" for n, c in names.items())


_MINI3 = E._MINI.replace("unnest([4, 6])", "unnest([4, 6, 9])")
_BUDGET = f"""{_MINI3}, ba AS (SELECT *, {_hex("'b' || example_id")} AS digit, regexp_extract_all(prompt, 'Value: (\\d+)', 1) AS vals, num_records * 16 AS target_tokens, len({E.tokens_sql('prompt')})::BIGINT AS actual_prompt_tokens FROM mini),
bb AS (SELECT *, regexp_extract(CASE WHEN digit < 8 THEN 'value ' || value WHEN digit < 12 THEN vals[3] WHEN digit < 14 THEN '00000000' ELSE 'none' END, '\\d+') AS predicted_value FROM ba),
bc AS (SELECT *, coalesce(list_position(vals, predicted_value), 0)::BIGINT - 1 AS predicted_index, coalesce(list_position(vals, value), 0)::BIGINT - 1 AS own FROM bb),
bd AS (SELECT *, (predicted_value = value)::BIGINT AS exact_match, (predicted_value = '')::BIGINT AS format_error, (predicted_index >= 0)::BIGINT AS predicted_in_context, (predicted_value <> '' AND predicted_value <> value AND predicted_index >= 0)::BIGINT AS wrong_context_value,
  (predicted_value <> '' AND predicted_index < 0)::BIGINT AS hallucinated_value, CASE WHEN predicted_index >= 0 AND own >= 0 THEN predicted_index - own ELSE 0 END AS index_delta, digit / 16.0::DOUBLE AS latency_sec FROM bc)"""
_MINI_SCORED = _BUDGET.replace(_MINI3, E._MINI).replace("'b' || example_id", "'m' || example_id").replace("vals[3]", "vals[2]")


def _html_sql(x: str) -> str:
    for pattern, to in quality.HTML_STEPS:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return f"trim({x}, ' ' || chr(10))"


_TASK = "coalesce(try_cast(target_length AS BIGINT), 1000000000)"
_DEALT = f"o AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5('{SEED}:' || c_custkey), c_custkey) - 1 AS p FROM customer)"


def _weighted_sql(c: str, salt: str, choices) -> str:
    u = f"{_hex(f'{salt!r} || {c}', 7)} / 268435456.0::DOUBLE"
    out, upto = "CASE", 0.0
    for v, w in choices[:-1]:
        upto += w
        out += f" WHEN {u} <= {upto}::DOUBLE THEN {v!r}"
    return f"{out} ELSE {choices[-1][0]!r} END"


_NUM = lambda s: f"({_hex(f'{s!r} || k', 7)} % 90000 + 10000)::VARCHAR"
_CHAT = quality.CHAT_MARKS

QUERIES: dict[str, Query] = {
    "score_position": (score_position, f"WITH {E._NEEDLE}, {_answered_sql('p', 'z')} SELECT example_id, exact_match, contains_answer, first_number, first_number_match FROM z"),
    "summary_position": (summary_position, f"WITH {E._NEEDLE}, {_answered_sql('p', 'z')} SELECT context_length_target::BIGINT AS context_length_target, position_ratio, count(*) AS n, {_means(scoring.POSITION_MEANS)} FROM z GROUP BY 1, 2"),
    "score_generation": (score_generation, f"WITH {E._NEEDLE}, {_answered_sql('g', 'z')} SELECT example_id, exact_match, contains_answer, first_number, first_number_match, num_numbers, format_error FROM z"),
    "summary_generation": (
        summary_generation,
        f"WITH {E._NEEDLE}, {_answered_sql('g', 'z')}, {_answered_sql('h', 'y', 'scaled')}, u AS (SELECT * FROM z UNION ALL SELECT * FROM y) SELECT method, context_length_target::BIGINT AS context_length_target, position_ratio, count(*) AS n, {_means(scoring.GENERATION_MEANS)} FROM u GROUP BY 1, 2, 3",
    ),
    "attention_right_wrong": (
        attention_right_wrong,
        f"WITH {E._ATT}, am AS (SELECT method, position_ratio, ({_hex(chr(39) + 'm' + chr(39) + ' || example')} < 9)::BIGINT AS first_number_match, count(*) AS n, {E._ATT_MEANS} FROM att GROUP BY 1, 2, 3) SELECT method, position_ratio, first_number_match, n, {E._ROUND(E.ATTENTION)}, round((1 - entropy_norm + top5_mass + sink_mass_first16) / 3, 6) AS collapse_score FROM am",
    ),
    "score_token_budget": (score_token_budget, f"WITH {_BUDGET} SELECT example_id, {', '.join(BUDGET_SCORES)} FROM bd"),
    "summary_token_budget": (summary_token_budget, f"WITH {_BUDGET} SELECT target_tokens::BIGINT AS target_tokens, position_ratio, count(*) AS n, arg_min(num_records, sample_index)::BIGINT AS num_records, {_means(scoring.BUDGET_MEANS)} FROM bd GROUP BY 1, 2"),
    "summary_minikv": (summary_minikv, f"WITH {_MINI_SCORED} SELECT num_records, position_ratio, count(*) AS n, {_means(scoring.BUDGET_MEANS)} FROM bd GROUP BY 1, 2"),
    "score_many_documents": (
        score_many_documents,
        f"WITH c AS (SELECT *, {_hex(chr(39) + 'q' + chr(39) + ' || ' + chr(39) + 'c' + chr(39) + ' || c_custkey')} AS digit FROM customer) SELECT 'c' || c_custkey AS example_id, (digit < 8)::BIGINT AS answer_contains, (digit < 4)::BIGINT AS alias_match, (digit >= 8 AND digit < 11)::BIGINT AS no_answer, (digit >= 11 AND digit < 13)::BIGINT AS format_error FROM c",
    ),
    "score_many_values": (
        score_many_values,
        f"""WITH o AS (SELECT o_orderkey::VARCHAR AS k FROM orders), r AS (SELECT k, [{_NUM('a')}, {_NUM('b')}, {_NUM('c')}] AS v, [{_NUM('d')}, {_NUM('e')}] AS x, {_hex("'v' || k")} AS digit FROM o),
s AS (SELECT k, list_distinct(v) AS dv, v, x, list_distinct(CASE WHEN digit < 5 THEN v WHEN digit < 9 THEN [v[2], v[1], x[1]] WHEN digit < 12 THEN [v[1], '7'] ELSE [] END) AS said FROM r), t AS (SELECT *, len(list_intersect(said, dv)) AS hit, len(dv) AS n, list_filter(said, lambda y: NOT list_contains(v, y)) AS odd FROM s)
SELECT k, (hit = n AND len(said) = n)::BIGINT AS exact_match, round(hit / n::DOUBLE, 6) AS partial_match, (hit < n)::BIGINT AS missing_value, (len(list_filter(odd, lambda y: list_contains(x, y))) > 0)::BIGINT AS wrong_key, (len(list_filter(odd, lambda y: NOT list_contains(x, y))) > 0)::BIGINT AS wrong_value FROM t""",
    ),
    "page_boilerplate": (
        page_boilerplate,
        rf"""WITH p AS (SELECT page_id, {_html_sql("coalesce(html, '')")} AS t, regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*>(.*?)</a\s*>', 1) AS a FROM pages),
s AS (SELECT page_id, length(t)::BIGINT AS chars, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l, len(a)::BIGINT AS links, coalesce(list_sum(list_transform(a, lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))))), 0)::BIGINT AS link_chars FROM p),
q AS (SELECT page_id, chars, len(l)::BIGINT AS lines, (len(l) - len(list_distinct(l)))::BIGINT AS repeated_lines, links, link_chars FROM s),
r AS (SELECT *, CASE WHEN chars < {quality.LEAST_CHARS} THEN 'fragment' WHEN link_chars > {quality.LINK_SHARE} * chars THEN 'links' WHEN repeated_lines > {quality.REPEATED_SHARE} * lines THEN 'repeated' WHEN links > {quality.LINKS_PER_LINE} * lines THEN 'navigation' END AS reason FROM q) SELECT *, reason IS NOT NULL AS boilerplate FROM r""",
    ),
    "chat_conversations": (
        chat_conversations,
        f"WITH c AS (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, max(coalesce(regexp_matches(text, '{_CHAT}'), false)) AS marked, max(coalesce(lower(role) = 'assistant', false)) AS answered FROM conversations GROUP BY 1) SELECT conv_id, turns, roles, marked, marked OR (answered AND roles > 1) AS chat FROM c",
    ),
    "chat_documents": (chat_documents, f"SELECT doc_id AS seq FROM documents WHERE doc_id % 5 <> 0 AND NOT coalesce(regexp_matches(text, '{_CHAT}'), false)"),
    "targets_by_phase": (
        targets_by_phase,
        "WITH ph(phase, total) AS (VALUES "
        + ", ".join(f"('{p}', {n})" for p, (n, _) in PHASES.items())
        + f"), w AS (SELECT source, count(*) / sum(count(*)) OVER ()::DOUBLE AS w, row_number() OVER (ORDER BY source) - 1 AS k FROM documents GROUP BY source), p AS (SELECT * FROM ph, w), t AS (SELECT *, round_even(total * {SCALE}::DOUBLE, 0)::BIGINT AS tt FROM p), r AS (SELECT *, round_even(tt * w, 0)::BIGINT AS n FROM t) SELECT phase, source, (n + CASE WHEN k = 0 THEN tt - sum(n) OVER (PARTITION BY phase) ELSE 0 END)::BIGINT AS tokens FROM r",
    ),
    "source_shares": (source_shares, "WITH w AS (SELECT c_nationkey::VARCHAR AS nation, greatest(0, sum(c_acctbal::DECIMAL(18, 2)))::DOUBLE AS w FROM customer GROUP BY 1) SELECT nation, round(w / sum(w) OVER (), 6) AS share FROM w"),
    "rank_rollup_ordered": (
        rank_rollup_ordered,
        f"""WITH {E._CAND}, r AS (SELECT CASE WHEN grouping(target_length) = 1 THEN 'ALL' ELSE target_length::VARCHAR END AS target_length, CASE WHEN grouping(evidence_position) = 1 THEN 'ALL' ELSE evidence_position END AS evidence_position, CASE WHEN grouping(task_type) = 1 THEN 'ALL' ELSE task_type END AS task_type, CASE WHEN grouping(answer_type) = 1 THEN 'ALL' ELSE answer_type END AS answer_type, count(*) AS n
FROM answers WHERE num_candidates > 1 GROUP BY ROLLUP (target_length, evidence_position, task_type, answer_type)) SELECT row_number() OVER (ORDER BY {_TASK}, evidence_position, task_type, answer_type) AS place, * FROM r""",
    ),
    "merged_order": (
        merged_order,
        f"WITH {E._SC2}, u AS (SELECT *, 0 AS shard FROM sc UNION ALL SELECT *, 1 FROM sq WHERE sample_index % 2 = 0) SELECT example_id, num_keys, position_ratio, sample_index, exact_match, shard::BIGINT AS shard FROM u QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY shard DESC) = 1 ORDER BY num_keys, position_ratio, sample_index",
    ),
    "prediction_payload": (prediction_payload, f"WITH {E._SC} SELECT example_id, generated_text, round(latency_sec, 6) AS latency_sec FROM sc"),
    "top_entries": (top_entries, f"WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1)::BIGINT - 1 AS index FROM embeddings) SELECT vec_id, index, round(score, 6) AS score FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e.score DESC, index) <= {TOP}"),
    "id_aliases": (
        id_aliases,
        "SELECT c_custkey, ['random_5digit', 'random_5digit', 'random_5digit', 'word', 'random_5digit', 'other_kind'][c_custkey % 6 + 1] AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'mini_digit5' ELSE 'other_' END || '_mini_word_' || c_custkey AS id FROM customer",
    ),
    "pair_lists": (pair_lists, "SELECT p_partkey, p_size::BIGINT AS size, 1000 + p_partkey % 1000 AS key, 2::BIGINT AS n FROM part"),
    "log_times": (log_times, "SELECT event_id, epoch_us(ts) AS micros FROM events"),
    "first_of_sources": (first_of_sources, f"SELECT doc_id AS seq, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= {FIRST}"),
    "weighted_choices": (weighted_choices, f"WITH o AS (SELECT o_orderkey::VARCHAR AS k FROM orders) SELECT ({_weighted_sql('k', 'len', generators.LENGTH_WEIGHTS)})::BIGINT AS target_length, {_weighted_sql('k', 'tpl', generators.TEMPLATE_WEIGHTS)} AS template, count(*) AS n FROM o GROUP BY 1, 2"),
    "batches": (batches, f"WITH {_DEALT} SELECT p // {BATCH} AS batch, string_agg(c_custkey::VARCHAR, ',' ORDER BY p) AS keys, string_agg(c_name, ',' ORDER BY p) AS names FROM o GROUP BY 1"),
    "placed_blocks": (placed_blocks, ""),
    "shared_filler": (shared_filler, ""),
    "dense_examples": (dense_examples, ""),
    "dense_counters": (dense_counters, ""),
    "bpe_merges": (bpe_merges, ""),
}
