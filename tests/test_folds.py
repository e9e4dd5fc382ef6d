"""Ordered folds and text cleaning against plain loops, on random rows."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import corpus, folds

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
LENGTHS = st.lists(st.integers(1, 40), min_size=1, max_size=25)


def loop(lengths, phases, overshoot):
    """One source's documents, one after another."""
    have, out = [0] * len(phases), []
    for i, n in enumerate(lengths):
        if all(target - h < least for (_, least, target), h in zip(phases, have)):
            break
        for k, (name, least, target) in enumerate(phases):
            rest = target - have[k]
            if n >= least and rest > 0:
                if n <= rest + overshoot:
                    out.append((i, name, n))
                    have[k] += n
                elif rest >= least:
                    out.append((i, name, rest))
                    have[k] += rest
                break
    return out


@FEW
@given(LENGTHS, st.integers(0, 60), st.integers(0, 40), st.integers(0, 30), st.integers(0, 10), st.sampled_from([3, 7, 1 << 20]))
def test_routing_is_the_loop(spark, lengths, a, b, c, overshoot, span):
    phases = [("long", 16, a), ("middle", 8, b), ("short", 4, c)]
    df = spark.createDataFrame([(i, s, n) for s in ("x", None) for i, n in enumerate(lengths)], "seq long, source string, n long").repartition(3)
    rows = folds.route(df, [folds.Phase(*p) for p in phases], overshoot, span).collect()
    for s in ("x", None):
        assert sorted((r["seq"], r["phase"], r["take"]) for r in rows if r["source"] == s) == loop(lengths, phases, overshoot)


def test_routing_of_one_hot_source_in_many_stretches(spark):
    """Nine of ten rows are of one source; phases get short, pass documents over and close in different stretches."""
    import random

    rng = random.Random(4)
    of = {"hot": [rng.choice([0, 2, 5, 9, 18, 30]) for _ in range(3_000)], "b": [rng.randrange(40) for _ in range(200)], "c": [50] * 100}
    phases, overshoot = [("long", 16, 9_000), ("middle", 8, 4_001), ("short", 4, 2_500), ("last", 1, 10**9)], 3
    df = spark.createDataFrame([(i, s, n) for s, v in of.items() for i, n in enumerate(v)], "seq long, source string, n long").repartition(4)
    rows = folds.route(df, [folds.Phase(*p) for p in phases], overshoot, 50).collect()
    for s, lengths in of.items():
        assert sorted((r["seq"], r["phase"], r["take"]) for r in rows if r["source"] == s) == loop(lengths, phases, overshoot)
    tasks = folds.dealt(df, 50).filter("source = 'hot'").select("stretch").distinct().count()
    assert tasks == 60


def blocks(lengths, size):
    block, end, out = 0, 0, []
    for i, n in enumerate(lengths):
        if n <= size:
            if end + n > size:
                block, end = block + 1, 0
            out.append((i, block, end, end + n))
            end += n
    return out


@FEW
@given(LENGTHS, st.integers(5, 60), st.sampled_from([2, 5, 1 << 20]))
def test_blocks_are_those_of_the_loop(spark, lengths, size, span):
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(lengths)], "seq long, source string, n long")
    rows = folds.next_fit(df, size, span).orderBy("seq").collect()
    assert [(r["seq"], r["block"], r["start"], r["end"]) for r in rows] == blocks(lengths, size)


def test_blocks_of_one_hot_source_in_many_stretches(spark):
    import random

    rng = random.Random(8)
    of = {"hot": [rng.choice([0, 1, 7, 40, 99, 100, 101]) for _ in range(4_000)], "b": [3] * 200, None: [100, 0, 100]}
    df = spark.createDataFrame([(7 * i - 900, s, n) for s, v in of.items() for i, n in enumerate(v)], "seq long, source string, n long").repartition(4)
    rows = folds.next_fit(df, 100, 64).collect()
    for s, lengths in of.items():
        assert sorted((r["seq"], r["block"], r["start"], r["end"]) for r in rows if r["source"] == s) == [(7 * i - 900, *x) for i, *x in blocks(lengths, 100)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=30), st.integers(20, 60), st.integers(0, 60))
def test_effect_of_a_stretch_on_any_fill(ns, size, fill):
    import numpy as np

    fill = min(fill, size)
    block, end = 0, fill
    for n in ns:
        if end + n > size:
            block, end = block + 1, 0
        end += n
    rooms, begun, fills, total = folds.effect(np.array(ns, np.int64), size)
    k = folds.bisect_right(rooms, size - fill) - 1
    assert ((0, fill + total) if total <= size - fill else (begun[k], fills[k])) == (block, end)


def cleaned(t):
    t = re.sub(r"\r\n?", "\n", t)
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", t)
    t = re.sub(r"[ \t\f\v]+", " ", t)
    t = re.sub(r" *\n *", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@FEW
@given(st.lists(st.text(st.sampled_from("ab \t\n\r\x00\x07\x0b\x0c\x1c\x85\xa0 　é1"), max_size=25), min_size=20, max_size=60))
def test_cleaning_any_text(spark, texts):
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "seq long, source string, text string")
    rows = corpus.cleaned(df).withColumn("ok", T.usable(F.col("text"), 1, 0.5)).orderBy("seq").collect()
    for r, t in zip(rows, texts):
        c = cleaned(t)
        visible = sum(not x.isspace() for x in c)
        assert r["text"] == c
        assert r["ok"] == (len(c) >= 1 and visible > 0 and sum(x.isalpha() for x in c) / visible >= 0.5)


@pytest.mark.parametrize("kind", ["dense", "hashed", "gaps", "one far off", "negative"])
def test_running_totals_over_sparse_orders(spark, kind):
    """Ids of any spread give the same totals, and no stretch holds much more than its share."""
    import random

    from lexforge.operators import prefix

    rng = random.Random(6)
    ids = {
        "dense": list(range(600)),
        "hashed": [rng.randrange(-(1 << 62), 1 << 62) for _ in range(600)],
        "gaps": [k + (k // 100) * 10**12 for k in range(600)],
        "one far off": [*range(599), 10**17],
        "negative": [-(k * k * k) for k in range(600)],
    }[kind]
    rows = [(x, rng.choice("aab"), rng.randrange(9)) for x in ids]
    df = spark.createDataFrame(rows, "seq long, source string, n long").repartition(5)
    got = {r["seq"]: r["before"] for r in prefix.with_running_total(df, ["source"], "seq", "n", "before", 50).collect()}
    for s in "ab":
        at = 0
        for x, _, n in sorted(r for r in rows if r[1] == s):
            assert got[x] == at
            at += n
    sizes = [r["count"] for r in df.groupBy(prefix.stretch_of(df, "seq", 50).alias("s")).count().collect()]
    assert len(got) == 600 and max(sizes) <= 150
