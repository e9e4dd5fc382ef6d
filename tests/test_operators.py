"""Operators on literal rows and on random ones, against plain Python loops."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import attention, corpus, folds, ranking, retrieval, scoring, shards, trainlog
from lexforge.operators.prefix import with_running_total

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("__"))
    return row.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, clean",
    [("a\r\nb\rc", "a\nb\nc"), ("x \t\x0b y", "x y"), ("p  \n\n\n\n  q", "p\n\nq"), ("\x00z\x07", "z"), ("  t　", "t"), ("", ""), (" \n ", "")],
)
def test_clean_text(spark, text, clean):
    assert one(spark, T.clean_text(F.col("t")), t=text) == clean


@pytest.mark.parametrize("text, ok", [("", False), ("abc", True), ("a1234", False), ("   ", False), ("ab1", True)])
def test_usable(spark, text, ok):
    assert one(spark, T.usable(F.col("t"), 1, 0.5), t=text) is ok


@pytest.mark.parametrize("ratio, n, index", [(0.5, 6, 2), (0.5, 8, 4), (0.5, 140, 70), (0.25, 75, 18), (0.84, 130, 108), (1.0, 300, 299), (0.5, 1, 0)])
def test_target_index(spark, ratio, n, index):
    assert one(spark, T.target_index(F.col("r"), F.col("n")), r=ratio, n=n) == index


@pytest.mark.parametrize("name, seed", [("pg19", 622556849), ("pes2o", 551582290), ("fineweb_edu", 14997868)])
def test_stable_seed(spark, name, seed):
    assert one(spark, T.stable_seed(F.col("n")), n=name) == seed


@pytest.mark.parametrize("index, n, bucket", [(-1, 10, "not_in_context"), (0, 10, "target_0"), (1, 100, "front_0_10"), (2, 9, "mid_25_50"), (9, 10, "end_90_100"), (1, 1, "end_90_100")])
def test_index_bucket(spark, index, n, bucket):
    assert one(spark, T.index_bucket(F.col("i"), F.col("n")), i=index, n=n) == bucket


@pytest.mark.parametrize("index, bucket", [(None, "no_index"), (-1, "no_index"), (0, "0-34"), (35, "35-69"), (104, "70-104"), (139, "105-139")])
def test_quarter_bucket(spark, index, bucket):
    assert one(spark, T.quarter_bucket(F.col("i").cast("int")), i=index) == bucket


def test_scaled_targets():
    mix = {"a": 6_500, "b": 1_200, "c": 1_000, "d": 800, "e": 500}
    assert list(corpus.scaled_targets(mix, 1_003).values()) == [653, 120, 100, 80, 50]


def docs(spark, lengths, source="s"):
    return spark.createDataFrame([(i, source, n) for i, n in enumerate(lengths)], "seq long, source string, n long")


def quota_loop(lengths, target, least):
    out, got = [], 0
    for i, n in enumerate(lengths):
        rest = target - got
        if rest <= 0:
            break
        if n > rest:
            if rest >= least:
                out.append((i, rest))
            break
        out.append((i, n))
        got += n
    return out


@pytest.mark.parametrize("lengths, target, least, taken", [([5, 7, 10, 2], 20, 4, [(0, 5), (1, 7), (2, 8)]), ([8, 8, 8], 18, 4, [(0, 8), (1, 8)]), ([8, 8, 8], 19, 3, [(0, 8), (1, 8), (2, 3)])])
def test_quota_fill(spark, lengths, target, least, taken):
    rows = corpus.quota_fill(docs(spark, lengths), target, least).orderBy("seq").collect()
    assert [(r["seq"], r["take"]) for r in rows] == taken == quota_loop(lengths, target, least)


@FEW
@given(st.lists(st.integers(4, 30), min_size=1, max_size=20), st.integers(1, 120), st.integers(1, 10))
def test_quota_fill_is_the_loop(spark, lengths, target, least):
    rows = corpus.quota_fill(docs(spark, lengths), target, least, span=4).orderBy("seq").collect()
    assert [(r["seq"], r["take"]) for r in rows] == quota_loop(lengths, target, least)


def test_running_total_is_the_same_for_every_stretch(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, k string, n long")
    sums, expected = {}, {}
    for i, k, n in rows:
        expected[i] = sums.get(k, 0)
        sums[k] = expected[i] + n
    for span in (1, 7, 1 << 20):
        got = {r["seq"]: r["before"] for r in with_running_total(df, ["k"], "seq", "n", "before", span).collect()}
        assert got == expected


def test_phase_routing(spark):
    phases = [folds.Phase("16k", 16, 40), folds.Phase("8k", 8, 10), folds.Phase("4k", 4, 8)]
    rows = folds.route(docs(spark, [20, 9, 30, 5, 17, 4, 16]), phases, 0).orderBy("seq").collect()
    assert [(r["seq"], r["phase"], r["take"]) for r in rows] == [(0, "16k", 20), (1, "8k", 9), (2, "16k", 20), (3, "4k", 5)]
    rows = folds.route(docs(spark, [20, 60, 18]), [folds.Phase("16k", 16, 30), *phases[1:]], 5).collect()
    assert [(r["seq"], r["phase"], r["take"]) for r in rows] == [(0, "16k", 20)]


def test_next_fit(spark):
    rows = folds.next_fit(docs(spark, [4, 5, 3, 12, 10, 1]), 10).orderBy("seq").collect()
    assert [(r["seq"], r["block"], r["start"], r["end"]) for r in rows] == [(0, 0, 0, 4), (1, 0, 4, 9), (2, 1, 0, 3), (4, 2, 0, 10), (5, 3, 0, 1)]


@pytest.mark.parametrize("n, length, stride, count", [(10, 3, 2, 4), (10, 3, 3, 3), (4, 3, 3, 1), (3, 3, 3, 0), (4097, 2048, 2048, 2)])
def test_window_count(spark, n, length, stride, count):
    assert one(spark, shards.window_count(F.col("n"), length, stride), n=n) == count


def test_windows_hold_the_next_token(spark):
    df = spark.createDataFrame([(1, list(range(10)))], "k int, ids array<int>")
    rows = shards.windows(df, 3, 2).orderBy("w").collect()
    assert [r["x"] for r in rows] == [[0, 1, 2], [2, 3, 4], [4, 5, 6], [6, 7, 8]]
    assert all(r["y"] == [v + 1 for v in r["x"]] for r in rows)


def test_end_segmentation(spark):
    df = spark.createDataFrame([(0, [5, 6, 1, 7]), (1, [8, 1, 9, 1])], "shard_idx long, ids array<int>")
    assert [r["ids"] for r in shards.documents(df, 1).orderBy("doc").collect()] == [[5, 6, 1], [7, 8, 1], [9, 1]]
    tail = spark.createDataFrame([(0, [1, 1, 4]), (1, [5, 6])], "shard_idx long, ids array<int>")
    assert [r["ids"] for r in shards.documents(tail, 1).orderBy("doc").collect()] == [[1], [1], [4, 5, 6]]


@FEW
@given(st.lists(st.integers(1, 12), min_size=1, max_size=12), st.integers(1, 9))
def test_cut_and_read_back(spark, lengths, size):
    df = spark.createDataFrame([(i, [7] * (n - 1) + [1]) for i, n in enumerate(lengths)], "seq long, ids array<int>")
    payload = shards.payloads(shards.cut(df, size, span=4))
    sizes = [len(r["ids"]) for r in payload.orderBy("shard_idx").collect()]
    assert sizes[:-1] == [size] * (len(sizes) - 1) and sum(sizes) == sum(lengths)
    assert [len(r["ids"]) for r in shards.documents(payload, 1).orderBy("doc").collect()] == lengths


def test_duplicates_are_found_by_scope_and_keep_the_first(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, None, "x"), (6, "a", "x")], "seq long, source string, text string")
    flag = lambda scope: {r["seq"]: r["duplicate"] for r in corpus.with_duplicate_flag(df, scope).collect()}
    assert flag("global") == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    own = flag("source")
    assert {k: own[k] for k in (1, 2, 3, 4, 6)} == {1: False, 2: True, 3: False, 4: False, 6: True}


def test_gold_wins_ties_and_margins(spark):
    rows = [("e", "gold", "g", 0, -1.0, 1.0), ("e", "distractor", "a", 1, -1.0, 0.5), ("e", "distractor", "b", 2, -3.0, 3.0), ("alone", "gold", "g", 0, -2.0, 2.0)]
    df = spark.createDataFrame(rows, "example_id string, candidate_kind string, candidate_value string, candidate_index int, candidate_sum_logprob double, candidate_mean_nll double")
    df = df.withColumns({"target_length": F.lit(1), "evidence_position": F.lit("p"), "task_type": F.lit("t"), "answer_type": F.lit("a"), "evidence_to_answer_distance": F.lit(1.0)})
    got = {r["example_id"]: r for r in ranking.answers(df).collect()}
    assert (got["e"]["gold_rank_sum_logprob"], got["e"]["gold_rank_mean_nll"], got["e"]["sum_logprob_margin"]) == (1, 2, 0.0)
    assert got["alone"]["best_wrong_sum_logprob"] == -math.inf and got["alone"]["sum_logprob_margin"] == math.inf
    assert {r["candidate_value"]: r["rank_sum"] for r in ranking.ranked(df).filter("example_id = 'e'").collect()} == {"g": 1, "a": 2, "b": 3}
    assert [r["negatives"] for r in ranking.hard_negatives(df, 3).collect()] == [["a", "b", "b"]]


def test_attention_metrics(spark):
    df = spark.createDataFrame([([0.5, 0.25, 0.125, 0.125], 3, None, None)], "probs array<double>, query int, evidence_start int, evidence_end int")
    r = attention.query_metrics(df).first()
    assert r["entropy"] == pytest.approx(1.2130075659799042) and r["entropy_norm"] == pytest.approx(0.875) and r["effective_span_80"] == 4
    assert math.isnan(r["evidence_mass"])
    m = attention.means(attention.query_metrics(df).withColumn("k", F.lit(1)), ["k"]).first()
    assert math.isnan(m["evidence_mass"]) and m["top1_mass"] == 0.5


def test_scores(spark):
    u, w = "00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b"
    prompt = f"Key: k | Value: {u}\nKey: l | Value: {w}\n"
    rows = [(f" {u.upper()} \nmore", 0), (f"it is {w}", 0), ("no idea", 0), ("00000000-0000-0000-0000-0000000000ff", 0), ("", 0)]
    df = spark.createDataFrame([(i, t, u, prompt, k) for i, (t, k) in enumerate(rows)], "i int, generated_text string, value string, prompt string, target_index int")
    got = [r.asDict() for r in scoring.score_kv(df).orderBy("i").collect()]
    assert [r["exact_match"] for r in got] == [1, 0, 0, 0, 0]
    assert [r["contains_value"] for r in got] == [0, 0, 0, 0, 0]
    assert [r["predicted_index"] for r in got] == [-1, 1, -1, -1, -1]
    assert [r["wrong_context_value"] for r in got] == [0, 1, 0, 0, 0]
    assert [r["hallucinated_value"] for r in got] == [1, 0, 0, 1, 0]
    assert [r["format_error"] for r in got] == [0, 0, 1, 0, 1]


def test_missing_target_key_fails(spark):
    df = spark.createDataFrame([([("a", "1")], "b")], "records array<struct<key:string,value:string>>, key string")
    with pytest.raises(Exception, match="target key not found"):
        df.select(retrieval.moved(F.col("records"), F.col("key"), F.lit(0))).collect()


def test_cells_must_be_full(spark):
    scored = spark.createDataFrame([(8, 0.0, 1, 1, 1, 0, 0, 0, 0)], "num_keys int, position_ratio double, exact_match int, contains_value int, first_value_match int, format_error int, wrong_context_value int, hallucinated_value int, abs_index_delta int")
    grid = retrieval.grid(spark, [8], [0.0, 1.0])
    assert {r["position_ratio"]: r["n"] for r in scoring.official_summary(scored, grid).collect()} == {0.0: 1, 1.0: 0}
    with pytest.raises(Exception, match="rows in a cell"):
        scoring.official_summary(scored, grid, 500).collect()


def test_same_samples(spark):
    df = spark.createDataFrame([(8, 1, 0.0), (8, 1, 1.0), (9, 1, 0.0), (9, 2, 1.0)], "num_keys int, source_index int, position_ratio double")
    assert {r["num_keys"]: r["consistent"] for r in scoring.same_samples(df).collect()} == {8: True, 9: False}


def test_later_rows_replace_earlier(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "id string, v int, shard int")
    assert sorted((r["id"], r["v"]) for r in scoring.latest(df, "id", ["shard"]).collect()) == [("a", 2), ("b", 3)]


def test_split_is_exact(spark):
    df = spark.range(1000)
    rows = trainlog.split(df, "id", 0.05, 1)
    assert rows.filter("part = 'val'").count() == 50
    assert trainlog.split(spark.range(3), "id", 0.05, 1).filter("part = 'val'").count() == 1


def test_published_log_figures():
    """Steps, tokens and hours of a published run give its wall throughput; a second published table sums up."""
    assert round((4_999_741_440 - 1_966_080) / (22.978 * 3600)) == pytest.approx(60_417, rel=1e-3)
    assert 662 + 266 + 110 + 12 == 3 * 7 * 50
    assert 387_698 + 515_909 + 815_326 + 1_057_513 + 323_219 == 3_099_665
