"""Queries of corpus building, shards, folds and tokenizer metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import corpus, folds, shards, tokenmetrics
from lexforge.plans.common import Query, clean_sql, documents, plain, token_id_sql, tokens_sql
from lexforge.sources.shared import saved

MIN_CHARS, LEAST, MOST, TARGET, END = 200, 128, 2_000, 15_000, 1
SHARD, LENGTH, STRIDE = 4_096, 64, 64
PHASES = [folds.Phase("16k", 512, 6_000), folds.Phase("8k", 256, 3_000), folds.Phase("4k", 128, 1_500)]
OVERSHOOT, BLOCK = 200, 2_048


def _usable(spark, d):
    return corpus.usable_only(corpus.cleaned(documents(spark, d)), MIN_CHARS)


def _sized(spark, d):
    """Usable documents without copies, with their token count, end included."""
    slim = _usable(spark, d).select("seq", "source", T.fingerprint(F.col("text")).alias("fp"), (T.token_count(F.col("text")) + 1).alias("n"))
    return corpus.without_duplicates(slim).drop("fp")


def _ids(spark, d):
    """Usable documents as ids, cut to MOST, end included."""
    return _usable(spark, d).select("seq", "source", corpus.truncated(T.token_ids(F.col("text")), MOST, END).alias("ids"))


def _pieces(spark, d):
    """Pieces of shards; ids are made once, not for counts and cuts apart."""
    return shards.cut(saved(_ids(spark, d)), SHARD, domain=documents(spark, d).select("seq"))


def _docs(spark, d):
    """Documents with their pieces, the first of each text within a source."""
    kept = corpus.first_texts(corpus.cleaned(documents(spark, d)).filter("text <> ''"))
    return kept.withColumn("pieces", T.tokens(F.col("text")))


def _metrics(spark, d):
    """Metrics of the same documents from one pass over the texts: copies are found and left out on their counts."""
    docs = corpus.cleaned(documents(spark, d)).filter("text <> ''")
    each = F.explode(F.array(T.tokens(F.col("text")))).alias("pieces")  # once for all uses
    narrow = tokenmetrics.sizes(docs.select("seq", "source", "text", T.fingerprint(F.col("text")).alias("fp"), each))
    return tokenmetrics.doc_metrics(corpus.without_duplicates(narrow))


def corpus_clean(spark, d):
    c = corpus.cleaned(documents(spark, d))
    return plain(c.select("seq", "source", F.md5("text").alias("text_md5"), F.length("text").alias("chars")))


def corpus_usable_filter(spark, d):
    return plain(_usable(spark, d).select("seq", "source", F.length("text").alias("chars")))


def corpus_exact_dedup(spark, d):
    slim = _usable(spark, d).select("seq", "source", T.fingerprint(F.col("text")).alias("fp"))
    return plain(corpus.with_duplicate_flag(slim).select("seq", "source", "duplicate"))


def corpus_dedup_scope_global(spark, d):
    slim = _usable(spark, d).select("seq", "source", T.fingerprint(F.col("text")).alias("fp"))
    return plain(corpus.with_duplicate_flag(slim, "global").select("seq", "source", "duplicate"))


def corpus_quota_fill(spark, d):
    return plain(corpus.quota_fill(_sized(spark, d).filter(F.col("n") >= LEAST), TARGET, LEAST, domain=documents(spark, d).select("seq")).select("seq", "source", "n", "take"))


def corpus_source_stats(spark, d):
    return plain(corpus.source_stats(corpus.labelled(documents(spark, d), MIN_CHARS, LEAST, MOST, TARGET), MOST))


def source_balance(spark, d):
    return plain(corpus.balance(corpus.source_stats(corpus.labelled(documents(spark, d), MIN_CHARS, LEAST, MOST, TARGET), MOST)))


def char_budget_sample(spark, d):
    slim = _usable(spark, d).select("seq", "source", T.fingerprint(F.col("text")).alias("fp"), F.length("text").cast("long").alias("n"))
    kept = corpus.without_duplicates(slim).drop("fp")
    return plain(corpus.char_budget(kept, 60_000, MIN_CHARS, domain=documents(spark, d).select("seq")).select("seq", "source", "n", "take"))


def token_shard_cut(spark, d):
    p = _pieces(spark, d)
    return plain(p.select("seq", "source", "shard_idx", "shard_start", "doc_start", F.size("piece").alias("n"), F.aggregate("piece", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum")))


def token_shard_manifest(spark, d):
    return plain(shards.manifest(_pieces(spark, d)))


def majority_shard_filter(spark, d):
    return plain(shards.majority(shards.manifest(_pieces(spark, d)), 0.3))


def eod_segmentation(spark, d):
    out = shards.documents(shards.payloads(_pieces(spark, d)), END)
    return plain(out.select("doc", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum")))


def token_windows(spark, d):
    w = shards.windows(shards.payloads(_pieces(spark, d)), LENGTH, STRIDE)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return plain(w.select("shard_idx", "w", F.get("x", F.lit(0)).alias("x_first"), F.get("y", F.lit(LENGTH - 1)).alias("y_last"), total("x").alias("x_sum"), total("y").alias("y_sum")))


def phase_routing(spark, d):
    return plain(folds.route(_sized(spark, d), PHASES, OVERSHOOT))


def phase_stats(spark, d):
    routed = folds.route(_sized(spark, d), PHASES, OVERSHOOT)
    return plain(routed.groupBy("phase", "source").agg(F.count("*").alias("docs_written"), F.sum("take").alias("tokens_written")))


def block_packing(spark, d):
    return plain(folds.next_fit(_sized(spark, d), BLOCK))


def block_payloads(spark, d):
    ids = _usable(spark, d).select("seq", F.concat(T.token_ids(F.col("text")), F.array(F.lit(END))).alias("ids"))
    out = shards.blocks(folds.next_fit(_sized(spark, d), BLOCK), ids, BLOCK, END)
    return plain(out.select("source", "block", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum")))


def tok_doc_metrics(spark, d):
    return plain(_metrics(spark, d))


def tok_source_metrics(spark, d):
    return plain(tokenmetrics.source_metrics(saved(_metrics(spark, d)), tokenmetrics.frequencies(_docs(spark, d), ["source"]), 64_000))


def tok_global_rates(spark, d):
    return plain(tokenmetrics.global_rates(_metrics(spark, d)))


def tok_topk_coverage(spark, d):
    return plain(tokenmetrics.coverage(tokenmetrics.frequencies(_docs(spark, d), [])))


def tok_piece_hist(spark, d):
    return plain(tokenmetrics.piece_lengths(tokenmetrics.frequencies(_docs(spark, d), [])))


def bpe_word_counts(spark, d):
    return plain(tokenmetrics.bpe_word_counts(corpus.cleaned(documents(spark, d))))


_CLEAN = f"clean AS (SELECT doc_id AS seq, source, {clean_sql('text')} AS text FROM documents)"
_USABLE = rf"""{_CLEAN}, usable AS (
  SELECT * FROM clean WHERE length(text) >= {MIN_CHARS}
    AND length(regexp_replace(text, '\P{{L}}', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[\t-\r \x{{85}}\p{{Z}}]', '', 'g')), 0) >= 0.25)"""
_FLAGGED = f"{_USABLE}, flagged AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY seq) > 1 AS duplicate FROM usable)"
_SIZED = f"{_FLAGGED}, sized AS (SELECT seq, source, len({tokens_sql('text')})::BIGINT + 1 AS n FROM flagged WHERE NOT duplicate)"
_LABELLED = f"""{_FLAGGED}, labelled AS (
  SELECT *, length(text)::BIGINT AS chars, len({tokens_sql("text")})::BIGINT AS full_n FROM flagged
), l2 AS (SELECT *, least(full_n, {MOST}) + 1 AS n FROM labelled),
l3 AS (SELECT *, CASE WHEN duplicate THEN 'duplicate' WHEN n < {LEAST} THEN 'short' ELSE 'open' END AS stage FROM l2),
l4 AS (SELECT *, {TARGET} - coalesce(sum(CASE WHEN stage = 'open' THEN n ELSE 0 END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM l3),
l5 AS (SELECT *, stage = 'open' AND rest > 0 AND (n <= rest OR rest >= {LEAST}) AS taken FROM l4),
stats AS (SELECT source, count(*) AS docs_seen, count(*) FILTER (WHERE taken) AS docs_written, count(*) FILTER (WHERE stage = 'short') AS docs_too_short,
  count(*) FILTER (WHERE taken AND full_n > {MOST}) AS docs_too_long, count(*) FILTER (WHERE stage = 'duplicate') AS docs_duplicate,
  count(*) FILTER (WHERE stage = 'open' AND NOT taken) AS docs_over_quota, sum(CASE WHEN taken THEN chars ELSE 0 END)::BIGINT AS chars_written,
  sum(CASE WHEN taken THEN least(n, rest) ELSE 0 END)::BIGINT AS tokens_written FROM l5 GROUP BY source)"""
_IDS = f"{_USABLE}, ids AS (SELECT seq, source, list_append(list_transform({tokens_sql('text')}[1:{MOST}], lambda t: {token_id_sql('t')}), {END}) AS ids FROM usable)"
_PIECES = f"""{_IDS}, placed AS (
  SELECT *, len(ids) AS n, coalesce(sum(len(ids)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p0 FROM ids
), spread AS (SELECT *, unnest(range(p0 // {SHARD}, (p0 + n - 1) // {SHARD} + 1)) AS shard_idx FROM placed),
bounds AS (SELECT *, greatest(p0, shard_idx * {SHARD}) AS low, least(p0 + n, (shard_idx + 1) * {SHARD}) AS high FROM spread),
pieces AS (SELECT seq, source, shard_idx, low - shard_idx * {SHARD} AS shard_start, low - p0 AS doc_start, ids[low - p0 + 1:high - p0] AS piece FROM bounds)"""
_MANIFEST = f"{_PIECES}, manifest AS (SELECT shard_idx, source, sum(len(piece))::BIGINT AS tokens FROM pieces GROUP BY ALL)"
_STREAM = f"{_IDS}, stream AS (SELECT seq, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM ids), numbered AS (SELECT id, row_number() OVER (ORDER BY seq, i) - 1 AS p FROM stream)"
_DOCS = f"{_CLEAN}, first_docs AS (SELECT * FROM clean WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY seq) = 1), docs AS (SELECT *, {tokens_sql('text')} AS pieces FROM first_docs)"
_METRICS = f"""{_DOCS}, metrics AS (
  SELECT source, seq, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, len(pieces)::BIGINT AS tokens,
    length(text)::DOUBLE / len(pieces) AS chars_per_token, strlen(text)::DOUBLE / len(pieces) AS bytes_per_token, len(pieces) * 1000.0::DOUBLE / length(text) AS tokens_per_1k_chars,
    len(list_filter(pieces, lambda p: p = '<unk>'))::DOUBLE / len(pieces) AS unk_rate, len(list_filter(pieces, lambda p: length(p) <= 1))::DOUBLE / len(pieces) AS single_piece_rate
  FROM docs WHERE len(pieces) > 0)"""
_COUNTS = f"{_DOCS}, counts AS (SELECT piece, count(*) AS n FROM (SELECT unnest(pieces) AS piece FROM docs) GROUP BY piece)"


def _route_sql(tail: str) -> str:
    """The fold as a recursion over each source's documents in order; w1.. are what the phases have so far."""
    w = [f"w{k}" for k in range(len(PHASES))]
    done = " AND ".join(f"{p.target} - {x} < {p.least}" for p, x in zip(PHASES, w))
    phase = "CASE " + " ".join(f"WHEN d.n >= {p.least} AND {p.target} - {x} > 0 THEN {k}" for k, (p, x) in enumerate(zip(PHASES, w))) + " END"
    rest = "CASE " + " ".join(f"WHEN d.n >= {p.least} AND {p.target} - {x} > 0 THEN {p.target} - {x}" for p, x in zip(PHASES, w)) + " END"
    least = "CASE " + " ".join(f"WHEN d.n >= {p.least} AND {p.target} - {x} > 0 THEN {p.least}" for p, x in zip(PHASES, w)) + " END"
    take = f"CASE WHEN ({done}) OR ({phase}) IS NULL THEN 0 WHEN d.n <= ({rest}) + {OVERSHOOT} THEN d.n WHEN ({rest}) < ({least}) THEN 0 ELSE ({rest}) END"
    steps = ", ".join(f"{x} + CASE WHEN ({phase}) = {k} THEN {take} ELSE 0 END AS {x}" for k, x in enumerate(w))
    name = "CASE ph " + " ".join(f"WHEN {k} THEN '{p.name}'" for k, p in enumerate(PHASES)) + " END"
    return f"""WITH RECURSIVE {_SIZED}, d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM sized),
walk AS (
  SELECT DISTINCT source, 0::BIGINT AS i, -1::BIGINT AS seq, {", ".join(f"0::BIGINT AS {x}" for x in w)}, NULL::INTEGER AS ph, 0::BIGINT AS take FROM d
  UNION ALL
  SELECT d.source, d.i, d.seq, {steps}, ({phase})::INTEGER AS ph, ({take})::BIGINT AS take FROM walk JOIN d ON d.source = walk.source AND d.i = walk.i + 1
), routed AS (SELECT source, seq, {name} AS phase, take FROM walk WHERE take > 0) {tail}"""


_BLOCKS = f"""WITH RECURSIVE {_SIZED}, d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM sized WHERE n <= {BLOCK}),
walk AS (
  SELECT DISTINCT source, 0::BIGINT AS i, -1::BIGINT AS seq, 0::BIGINT AS block, 0::BIGINT AS start, 0::BIGINT AS "end" FROM d
  UNION ALL
  SELECT d.source, d.i, d.seq, CASE WHEN w."end" + d.n > {BLOCK} THEN w.block + 1 ELSE w.block END, CASE WHEN w."end" + d.n > {BLOCK} THEN 0 ELSE w."end" END,
    CASE WHEN w."end" + d.n > {BLOCK} THEN d.n ELSE w."end" + d.n END FROM walk w JOIN d ON d.source = w.source AND d.i = w.i + 1
), placed AS (SELECT source, seq, block, start, "end" FROM walk WHERE i > 0)"""

QUERIES: dict[str, Query] = {
    "corpus_clean": (corpus_clean, f"WITH {_CLEAN} SELECT seq, source, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM clean"),
    "corpus_usable_filter": (corpus_usable_filter, f"WITH {_USABLE} SELECT seq, source, length(text)::BIGINT AS chars FROM usable"),
    "corpus_exact_dedup": (corpus_exact_dedup, f"WITH {_FLAGGED} SELECT seq, source, duplicate FROM flagged"),
    "corpus_dedup_scope_global": (corpus_dedup_scope_global, f"WITH {_USABLE} SELECT seq, source, row_number() OVER (PARTITION BY text ORDER BY seq) > 1 AS duplicate FROM usable"),
    "corpus_quota_fill": (
        corpus_quota_fill,
        f"WITH {_SIZED}, run AS (SELECT *, {TARGET} - coalesce(sum(n) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM sized WHERE n >= {LEAST}) SELECT seq, source, n, least(n, rest)::BIGINT AS take FROM run WHERE rest > 0 AND (n <= rest OR rest >= {LEAST})",
    ),
    "corpus_source_stats": (corpus_source_stats, f"WITH {_LABELLED} SELECT * FROM stats"),
    "source_balance": (source_balance, f"WITH {_LABELLED} SELECT source, round(tokens_written / sum(tokens_written) OVER (), 6)::DOUBLE AS share, round(1.0::DOUBLE / count(*) OVER (), 6) AS target_share FROM stats"),
    "char_budget_sample": (
        char_budget_sample,
        f"WITH {_FLAGGED}, run AS (SELECT seq, source, length(text)::BIGINT AS n, 60000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM flagged WHERE NOT duplicate) SELECT seq, source, n, least(n, rest)::BIGINT AS take FROM run WHERE rest >= {MIN_CHARS}",
    ),
    "token_shard_cut": (token_shard_cut, f"WITH {_PIECES} SELECT seq, source, shard_idx::BIGINT AS shard_idx, shard_start::BIGINT AS shard_start, doc_start::BIGINT AS doc_start, len(piece)::BIGINT AS n, list_sum(piece)::BIGINT AS id_sum FROM pieces"),
    "token_shard_manifest": (token_shard_manifest, f"WITH {_MANIFEST} SELECT shard_idx::BIGINT AS shard_idx, source, tokens FROM manifest"),
    "majority_shard_filter": (
        majority_shard_filter,
        f"WITH {_MANIFEST} SELECT shard_idx::BIGINT AS shard_idx, arg_max(source, (tokens, source)) AS top_source, max(tokens)::BIGINT AS top_tokens, sum(tokens)::BIGINT AS total, max(tokens)::DOUBLE / sum(tokens) >= 0.3 AS kept FROM manifest GROUP BY shard_idx",
    ),
    "eod_segmentation": (
        eod_segmentation,
        f"WITH {_STREAM}, marked AS (SELECT id, coalesce(sum((id = {END})::INT) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc FROM numbered) SELECT doc, count(*) AS n, sum(id)::BIGINT AS id_sum FROM marked GROUP BY doc",
    ),
    "token_windows": (
        token_windows,
        f"""WITH {_STREAM}, sh AS (SELECT p // {SHARD} AS shard_idx, list(id ORDER BY p) AS ids FROM numbered GROUP BY 1),
w AS (SELECT shard_idx, ids, unnest(range(0, CASE WHEN len(ids) > {LENGTH} THEN (len(ids) - {LENGTH} - 1) // {STRIDE} + 1 ELSE 0 END)) AS w FROM sh)
SELECT shard_idx::BIGINT AS shard_idx, w::BIGINT AS w, ids[w * {STRIDE} + 1]::BIGINT AS x_first, ids[w * {STRIDE} + {LENGTH} + 1]::BIGINT AS y_last,
  list_sum(ids[w * {STRIDE} + 1:w * {STRIDE} + {LENGTH}])::BIGINT AS x_sum, list_sum(ids[w * {STRIDE} + 2:w * {STRIDE} + {LENGTH} + 1])::BIGINT AS y_sum FROM w""",
    ),
    "phase_routing": (phase_routing, _route_sql("SELECT * FROM routed")),
    "phase_stats": (phase_stats, _route_sql("SELECT phase, source, count(*) AS docs_written, sum(take)::BIGINT AS tokens_written FROM routed GROUP BY phase, source")),
    "block_packing": (block_packing, f"{_BLOCKS} SELECT * FROM placed"),
    "block_payloads": (
        block_payloads,
        f"""{_BLOCKS} SELECT p.source, block, {BLOCK}::BIGINT AS n, (sum(list_sum(list_transform({tokens_sql('text')}, lambda t: {token_id_sql('t')})) + {END}) + ({BLOCK} - max("end")) * {END})::BIGINT AS id_sum FROM placed p JOIN usable USING (seq) GROUP BY 1, 2""",
    ),
    "tok_doc_metrics": (
        tok_doc_metrics,
        f"WITH {_METRICS} SELECT source, seq, chars, bytes, tokens, {', '.join(f'round({x}, 6) AS {x}' for x in ('chars_per_token', 'bytes_per_token', 'tokens_per_1k_chars', 'unk_rate', 'single_piece_rate'))} FROM metrics",
    ),
    "tok_source_metrics": (
        tok_source_metrics,
        f"""WITH {_METRICS}, u AS (SELECT source, count(DISTINCT piece) AS unique_pieces FROM (SELECT source, unnest(pieces) AS piece FROM docs) GROUP BY source)
SELECT source, count(*) AS docs, sum(chars)::BIGINT AS chars, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens, round(avg(chars_per_token), 6) AS mean_chars_per_token,
  round(quantile_cont(chars_per_token, 0.5), 6) AS median_chars_per_token, round(quantile_cont(chars_per_token, 0.1), 6) AS p10_chars_per_token, round(quantile_cont(chars_per_token, 0.9), 6) AS p90_chars_per_token,
  round(avg(tokens_per_1k_chars), 6) AS mean_tokens_per_1k_chars, round(sum(unk_rate * tokens) / sum(tokens), 6) AS unk_rate, round(sum(single_piece_rate * tokens) / sum(tokens), 6) AS single_piece_rate,
  any_value(unique_pieces) AS unique_pieces, round(any_value(unique_pieces) * 100.0::DOUBLE / 64000, 6) AS vocab_utilisation FROM metrics JOIN u USING (source) GROUP BY source""",
    ),
    "tok_global_rates": (
        tok_global_rates,
        f"WITH {_METRICS} SELECT count(*) AS docs, sum(chars)::BIGINT AS chars, sum(tokens)::BIGINT AS tokens, round(sum(chars)::DOUBLE / sum(tokens), 6) AS chars_per_token, round(sum(unk_rate * tokens) / sum(tokens), 6) AS unk_rate, round(sum(single_piece_rate * tokens) / sum(tokens), 6) AS single_piece_rate FROM metrics",
    ),
    "tok_topk_coverage": (
        tok_topk_coverage,
        f"WITH {_COUNTS}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, piece) AS r FROM counts) SELECT k::BIGINT AS k, round(sum(n) FILTER (WHERE r <= k)::DOUBLE / sum(n), 6) AS coverage FROM r, (SELECT unnest([1000, 4000, 8000, 16000, 32000, 48000, 64000]) AS k) GROUP BY k",
    ),
    "tok_piece_hist": (tok_piece_hist, f"WITH {_COUNTS} SELECT least(length(piece), 16)::BIGINT AS piece_len, sum(n)::BIGINT AS n FROM counts GROUP BY 1"),
    "bpe_word_counts": (bpe_word_counts, rf"WITH {_CLEAN} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+')) AS word FROM clean) GROUP BY word"),
}
