"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontaminate, hostrules, langid, lbl, lexical, licenses, nbsvm, packing, secrets, sharding, simhash, trie, warc
from lexforge.llm.common import table

#: The vocabulary that packing counts with; another file is another parameter.
TOKENIZER = "word_bpe_49k.json"


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.quality_rules(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.lm_scores(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_license_scans, op2_quality_classifier, op3_packing, op4_simhash_near_dedup, op5_quality_rules, op6_warc, op7_benchmark_decontamination, op8_language_id, op9_lm_scoring, op10_sharding, op11_prefix_trie, op12_secret_scans, op13_lexical_search)
    return {f.__name__: f for f in each}


def _rules_sql() -> str:
    """SQL of op5: the counts, the hosts' failures, their priors by the method of moments, and the verdicts."""
    names = list(hostrules.RULES)
    hard = {r: hostrules.RULES[r][0] for r in names}
    soft = {r: hostrules.RULES[r][1] for r in names}
    rate = "(h.{r} + a_{r}) / (h.n + a_{r} + b_{r}) > " + f"{hostrules.HOST_RATE}::DOUBLE"
    moments, priors = [], []
    for r in names:
        moments.append(f"sum({r}) / sum(n)::DOUBLE AS m_{r}, sum({r} * {r} / n::DOUBLE) / sum(n) - (sum({r}) / sum(n)::DOUBLE) ** 2 AS s_{r}")
        mean, spread = f"m_{r}", f"greatest(s_{r} - m_{r} * (1 - m_{r}) * hosts / total, 1e-9)"
        weight = f"least(greatest(m_{r} * (1 - m_{r}) / {spread} - 1, 1.0), 1e6)"
        fixed = f"m_{r} <= 0 OR m_{r} >= 1 OR hosts < 2"
        priors.append(f"CASE WHEN {fixed} THEN 0.5 + {mean} ELSE {mean} * {weight} END AS a_{r}, CASE WHEN {fixed} THEN 1.5 - {mean} ELSE (1 - {mean}) * {weight} END AS b_{r}")
    guilty = " OR ".join(f"(({rate.format(r=r)}) AND ({soft[r]}))" for r in names)
    return f"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM words
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), counts AS (
  SELECT words.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')))))::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)
), h AS (
  SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {x}) AS {r}" for r, x in hard.items())} FROM counts GROUP BY source
), moments AS (SELECT count(*) AS hosts, sum(n) AS total, {", ".join(moments)} FROM h),
priors AS (SELECT {", ".join(priors)} FROM moments)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (({hard["few_words"]}) OR ({hard["repeats"]})) AS base_failed,
  NOT (({hard["few_words"]}) OR ({hard["repeats"]})) AND NOT ({guilty}) AS kept
FROM counts c JOIN h ON c.source IS NOT DISTINCT FROM h.source CROSS JOIN priors
"""


#: SHA-1 as hexadecimal, 20 bits at a time, in base32.
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM v
"""


#: Turns of rebuilt conversations, nodes by hashes of whole prefixes, and for each node all ancestors along its conversation.
_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS words, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS o FROM turns),
crc AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT crc.c, 0 AS part, own.o, digest, words FROM crc JOIN own ON own.c = crc.c - crc.c % 20 AND own.o <= h
  UNION ALL SELECT crc.c, 1, own.o, digest, words FROM crc JOIN own ON own.c = crc.c AND own.o > h
), placed AS (
  SELECT c, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, words, count(*) OVER (PARTITION BY c) AS n FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, o)
), members AS (
  SELECT c, depth, key, substr(key, 1, 32 * (depth - 1)) AS parent, words, depth = n AS last FROM placed
  UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM placed) FROM crc
), nodes AS (
  SELECT key, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM members GROUP BY key
), children AS (SELECT parent AS key, count(*) AS n_children FROM nodes GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
sums AS (
  SELECT m.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * u.words)::BIGINT AS saved_tokens
  FROM counted u JOIN members m ON m.c = u.conv_id AND m.depth <= u.depth GROUP BY m.key
)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens, u.ends_sha256
FROM counted u JOIN sums USING (key) LEFT JOIN nodes p ON p.key = u.parent
"""

#: Scores are integers but for the weights, floors of logarithms.
_SEARCH_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sizes AS (SELECT doc_id, r, len(t) AS n FROM docs WHERE len(t) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term
), scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM postings JOIN weights USING (term) JOIN items USING (term) JOIN sizes USING (r), corpus GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": _rules_sql(), "op6_warc": _WARC_SQL, "op11_prefix_trie": _TRIE_SQL, "op13_lexical_search": _SEARCH_SQL}
