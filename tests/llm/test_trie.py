"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexforge.llm import trie

WORD = re.compile("[^ \t-\r]+")


def plain(rows, group=20, head=4):
    own = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % head
        rebuilt[c] = turns.get(c - int(math.fmod(c, group)), [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, v in nodes.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * words
    return Counter(
        (min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(v) if len(rebuilt[c]) == len(k)).encode()).hexdigest())
        for k, v in nodes.items()
    )


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(3)
    found, expected = Counter(tuple(r) for r in trie.prefix_trie(df, **how).collect()), plain(rows, **how)
    assert (found - expected, expected - found) == (Counter(), Counter())


def conversations(seed, n, deep=6):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        if rng.random() < 0.3:  # all begin alike
            out.append((c, 0, "user", "same first turn"))
        for t in range(1, rng.randrange(1, deep)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "b  c\nd", "", None])))
    return out


def test_shared_prefixes_ties_and_nulls(spark):
    rows = conversations(1, 130) + [(200, None, "user", "x"), (200, None, "user", None), (200, 3, "user", "same"), (200, 3, "user", "same"), (200, 3, "assistant", "y")]
    rows += [(None, 0, "user", "of no conversation"), (409, 0, "user", "base absent"), (-7, 1, "u", "a"), (-20, 0, "u", "a"), (-21, 0, "u", "b")]
    rows += [(c, 0, None, "lone") for c in range(300, 330)]
    check(spark, rows)


def test_long_conversations_and_lists_are_cut_into_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    deep = [(c, t, "u", "w" * (1 + (c // 3 == 1 and t > 20))) for c in range(1, 9) for t in range(40)]
    check(spark, deep + conversations(2, 40, 12))


def test_other_groups_and_turnless_conversations(spark):
    rows = [(c, 0, "u", str(c % 2)) for c in range(1, 12)]  # none has its group's first
    check(spark, rows)
    check(spark, conversations(3, 50), group=5, head=3)


def test_empty_table_has_no_root(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = trie.prefix_trie(df)
    assert out.count() == 0 and out.columns[-1] == "ends_sha256"
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "a")], "conv_id long, turn long, role string, text string")).count() == 0


def test_light_paths_hang_from_nodes_that_twice_as_many_pass(spark):
    df = spark.createDataFrame(conversations(5, 200), "conv_id long, turn long, role string, text string")
    rows = trie.members(df).cache()
    nodes = rows.groupBy("a", "b").agg(F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    found = {(r["a"], r["b"]): r for r in trie.with_paths(rows, nodes).collect()}
    for r in found.values():
        if r["depth"]:
            up = found[r["pa"], r["pb"]]
            assert (r["path"] == up["path"]) == (r["depth"] != r["top"])
            assert r["path"] == up["path"] or 2 * r["n_convs"] <= up["n_convs"]
