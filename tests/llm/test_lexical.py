"""Ranked search against plain scoring of all documents, and block boundaries against all partitions."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_best_documents_of_each_item(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    items = [(1, rows[4][1]), (2, "The RIVER the river of stone1"), (3, None), (4, ""), (5, "niño straße 2024"), (6, "no such terms zzz"), (None, "winter"), (7, "x" * 30_000)]
    found = lexical.search(docs, spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int"))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(found) == plain([(r[0], r[1]) for r in [*rows, rows[7]]], items)


def test_ties_nulls_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS_HELD", 2)
    data = [(9, "a b"), (None, "a b"), (3, "b a"), (3, "a b"), (5, "c"), (6, None), (7, " .,; ")]
    items = [(k, "a c a") for k in range(5)]
    found = lexical.search(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == plain(data, items)
    one = lexical.search(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(1, "a"), (1, "c a")], "item_id long, text string"))
    assert rows_of(one) == plain(data, [(1, "a c a")])


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(empty, items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.limit(0)).dtypes == lexical.search(docs, items).dtypes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=9), min_size=1, max_size=4))
def test_boundaries_are_the_cheapest_of_all(lists):
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = set(lexical.cuts(first, np.array([s for x in lists for s in x])).tolist())
    for a, x in zip(first.tolist(), lists):
        def cost(begins):
            ends = [*begins[1:], len(x)]
            return sum(max(x[p:q]) * (q - p) - sum(x[p:q]) for p, q in zip(begins, ends)) + len(begins) * lexical.BLOCK_COST * sum(x) / len(x)

        every = [[0, *(k + 1 for k in range(len(x) - 1) if bits >> k & 1)] for bits in range(1 << (len(x) - 1))]
        mine = sorted(b - a for b in got if a <= b < a + len(x))
        assert mine[0] == 0 and math.isclose(cost(mine), min(map(cost, every)), abs_tol=1e-6)


def test_long_lists_are_cut_within_the_window_and_blocks_are_skipped():
    rng = np.random.default_rng(3)
    n = 5_000
    rare = np.sort(rng.choice(n, 40, replace=False)).astype(np.int32)
    docs = np.concatenate([np.arange(n, dtype=np.int32), rare])
    row = {"terms": [0, 1, -1, -2], "dfs": [n, 40, n, 3 * n], "ids": list(range(n)), "sizes": rng.integers(1, 900, n).tobytes(), "docs": docs.tobytes(), "tfs": rng.integers(1, 4, n + 40).tobytes()}
    index = lexical.index_of(row, np.array([10, 5_000]), n, 450 * n)
    assert np.diff(index.begins).max() <= lexical.WINDOW
    seen = Counter()
    found = lexical.best(index, np.array([0, 1]), np.array([2, 1]), 5, seen)
    scores = np.zeros(n, np.int64)
    np.add.at(scores, index.docs, index.scores * np.repeat([2, 1], [n, 40]))
    assert sorted((-s, d) for d, s in found)[:5] == sorted((-s, d) for d, s in enumerate(scores.tolist()))[:5]
    assert seen["read"] < seen["postings"] / 2


def test_terms_of_long_texts_are_found_in_steps():
    text = ("Wörter und 12_ab\x00c " * 2_000).encode()
    assert [w.decode() for part in lexical.terms_of(text, 1_000) for w in part] == terms(text.decode())
