"""Near-duplicates against all pairs, leaks against plain sets, and the bitmaps between them."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import leaks, nearcopies
from lexforge.operators.bitmap import bitmap, may_have, without
from lexforge.operators.components import connected

SCHEMA = "seq long, source string, text string"


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"y{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3_000)}"
    texts = [[word() for _ in range(rng.randrange(1, 120))] for _ in range(60)]
    long = [word() for _ in range(400)]
    texts += [varied(rng, long, rng.randrange(0, 12)) for _ in range(150)]  # a hot group, of similarities on both sides of 0.8
    shared = [word() for _ in range(60)]
    texts += [shared + [word() for _ in range(60)] for _ in range(40)]  # a passage that many share
    texts += [long] * 50 + [[], [], ["one"], ["One"], ["a", "b", "c", "d"]]
    rows = [(1000 + 3 * i, rng.choice("abc"), rng.choice([" ", "\n "]).join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (5, "a", None), (7, None, " \t")]


def classes(rows):
    sets = {}
    for seq, _, text in rows:
        w = (text or "").lower().split()
        sets[seq] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)}
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for u in sets:
        for v in sets:
            both = len(sets[u] & sets[v])
            if u < v and 5 * both >= 4 * (len(sets[u]) + len(sets[v]) - both):
                links += 1
                a, b = sorted((find(u), find(v)))
                root[b] = a
    return {s: find(s) for s in sets}, links


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    expected, links = classes(rows)
    assert links > 2_000 and len(set(expected.values())) > 80
    got = nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["seq"]: r["class"] for r in got} == expected and len(got) == len(rows)
    assert all(r["kept"] == (r["seq"] == r["class"]) for r in got)


def test_bands_find_pairs_about_the_least_similarity(spark):
    """Recall of candidates, over pairs of similarities from 0.8 to 0.9: three in a hundred could be missed, none is."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        base = [f"v{rng.randrange(10**5)}" for _ in range(200)]
        near = list(base)
        for at in range(0, 4 * rng.randrange(1, 5), 4):
            near[10 + 11 * at % 180] = "z"
        rows += [(2 * k, "a", " ".join(base)), (2 * k + 1, "b", " ".join(near))]
    expected, links = classes(rows)
    got = {r["seq"]: r["class"] for r in nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(150) if expected[2 * k] == expected[2 * k + 1])
    assert links > 100 and found >= 0.97 * links and all(got[2 * k] != got[2 * k + 1] for k in range(150) if expected[2 * k] != expected[2 * k + 1])


def test_copies_take_one_row_and_no_pairs(spark):
    df = spark.createDataFrame([(i, "a", "the same text again and again " * 9) for i in range(500)], SCHEMA)
    marked = nearcopies.signed(df)
    reps = marked.groupBy("fp").agg(F.min("seq").alias("rep"), F.first("bands").alias("bands"))
    assert reps.count() == 1 and nearcopies.links(df, reps.select("rep", "bands")).count() == 0


def test_empty_table(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(spark.createDataFrame([(1, "a", "b " * 20)], SCHEMA), items).count() == 0
    assert leaks.without_leaks(spark.createDataFrame([(1, "a", "b " * 20)], SCHEMA), items).count() == 1


def test_leaks_are_shared_runs(spark):
    rng = random.Random(1)
    item = lambda n: " ".join(f"i{rng.randrange(500)}" for _ in range(n))
    items = [(k, item(rng.randrange(3, 30))) for k in range(30)] + [(99, None), (98, "")]
    filler = lambda: " ".join(f"d{rng.randrange(500)}" for _ in range(rng.randrange(0, 60)))
    docs = [(k, "a", f"{filler()} {rng.choice(items[:30])[1].upper().replace(' ', ', ') if k % 3 == 0 else ''} {filler()}") for k in range(150)] + [(500, "a", None)]
    import re

    runs = lambda t: {tuple(w[i : i + 8]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 7)}
    expected = {(s, i): len(runs(t) & runs(x)) for s, _, t in docs for i, x in items if runs(t) & runs(x)}
    d, e = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["seq"], r["item_id"]): r["runs"] for r in leaks.leaks(d, e).collect()} == expected and len(expected) > 20
    assert {r["seq"] for r in leaks.without_leaks(d, e).collect()} == {s for s, _, _ in docs} - {s for s, _ in expected}


def test_no_text_is_shuffled(spark):
    d = spark.createDataFrame([(1, "a", "x " * 30)], SCHEMA)
    e = spark.createDataFrame([(1, "y " * 30)], "item_id long, text string")
    plan = leaks.leaks(d, e)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange hashpartitioning" not in line or "text" not in line


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_bitmaps_lose_no_key(spark, n):
    keys = spark.range(0, 3 * n, 3).withColumnRenamed("id", "k")
    pages, size = bitmap(keys, F.col("k"), n)
    rows = spark.range(20_000).selectExpr("id", "id as v").union(spark.sql("SELECT CAST(NULL AS LONG), 1L"))
    let = {r["id"] for r in may_have(rows, F.col("id"), pages, size).collect()}
    real = {k for k in range(0, 3 * n, 3) if k < 20_000}
    assert real <= let and len(let - real) <= 1_000
    assert {r["id"] for r in without(rows, "id", keys, "k").collect()} == ({None} | set(range(20_000))) - real


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(2_000, k) for k in range(2_001, 2_050)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame([*edges, (None, 4), (9_000, 9_000)], "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
