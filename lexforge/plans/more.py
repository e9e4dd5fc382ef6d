"""Queries of encoders, lookups and small summaries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexforge.functions import encode
from lexforge.functions import text as T
from lexforge.operators import corpus, ranking, scoring, trainlog
from lexforge.plans import evaluation as E
from lexforge.plans.common import Query, documents, plain, table
from lexforge.sources.shared import small_batches

#: A vocabulary file; another one is another parameter.
VOCABULARY = "byte_bpe_50k.json"


def bpe_encode(spark, d):
    """Cleaned documents as ids of a byte-level vocabulary; SQL has no such function, the tests hold it against the library."""
    small_batches(spark)
    ids = encode.encode(public_tokenizers.path(VOCABULARY))
    rows = corpus.cleaned(documents(spark, d)).select("seq", "source", F.length("text").alias("chars"), ids("text").alias("ids"))
    return plain(rows.select("seq", "source", "chars", F.size("ids").alias("tokens"), F.crc32(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_crc32")))


def prompt_compact(spark, d):
    return plain(E._examples(spark, d).select("example_id", T.compacted(F.col("prompt"), 3, 3).alias("prompt")))


def first_match(spark, d):
    rows = E._scored(spark, d).filter("wrong_context_value = 1").select("num_keys", "position_ratio", "sample_index", "example_id", "predicted_index")
    return plain(scoring.first_of(rows, ["num_keys", "position_ratio"], "sample_index"))


def matched_pairs(spark, d):
    p = E._predictions(spark, d).select("example_id", "generated_text")
    return plain(scoring.matched(E._examples(spark, d).select("example_id", "key", "value"), p).select("example_id", "key", "value", "generated_text"))


def answer_summary(spark, d):
    rows = ranking.answers(E._candidates(spark, d)).filter("num_candidates > 1").withColumn("match", F.col("rank_correct_mean_nll"))
    return plain(scoring.answer_summary(rows, ["target_length", "evidence_position"]))


def validation_loss(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("split"), (F.col("event_id") % 50).alias("batch"), F.col("value").alias("loss"))
    return plain(trainlog.mean_loss(rows, 20))


_LINES = "string_split(prompt, chr(10))"
QUERIES: dict[str, Query] = {
    "bpe_encode": (bpe_encode, ""),
    "prompt_compact": (
        prompt_compact,
        f"WITH {E._EX} SELECT example_id, CASE WHEN len({_LINES}) <= 6 THEN prompt ELSE array_to_string(list_concat(list_concat({_LINES}[1:3], ['... ' || (len({_LINES}) - 6) || ' lines ...']), {_LINES}[-3:]), chr(10)) END AS prompt FROM ex",
    ),
    "first_match": (first_match, f"WITH {E._SC} SELECT num_keys, position_ratio, sample_index, example_id, predicted_index FROM sc WHERE wrong_context_value = 1 QUALIFY row_number() OVER (PARTITION BY num_keys, position_ratio ORDER BY sample_index) = 1"),
    "matched_pairs": (matched_pairs, f"WITH {E._SC} SELECT example_id, key, value, generated_text FROM sc"),
    "answer_summary": (
        answer_summary,
        f"WITH {E._CAND} SELECT target_length, evidence_position, count(*) AS n, round(avg(rank_correct_mean_nll), 6) AS accuracy, sum(rank_correct_mean_nll)::BIGINT AS right, round(avg(answer_mean_nll) FILTER (WHERE rank_correct_mean_nll = 1), 6) AS nll_right, round(avg(answer_mean_nll) FILTER (WHERE rank_correct_mean_nll = 0), 6) AS nll_wrong, round(avg(answer_mean_nll), 6) AS answer_mean_nll, round(exp(least(80.0::DOUBLE, avg(answer_mean_nll))), 6) AS answer_ppl FROM answers WHERE num_candidates > 1 GROUP BY 1, 2",
    ),
    "validation_loss": (validation_loss, "SELECT event_type AS split, count(*) AS batches, round(avg(value), 6) AS loss FROM events WHERE event_id % 50 < 20 GROUP BY 1"),
}
