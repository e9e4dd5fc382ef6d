"""Generators, loop inputs and listings on literal rows."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import generators, listing, training
from lexforge.sources import readers


def test_a_mutation_changes_one_place(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("s")).withColumn("v", F.when(F.col("s") % 2 == 0, "AB-1234").otherwise("98765"))
    for r in df.withColumn("m", generators.mutated(F.col("v"), F.col("s"))).collect():
        assert len(r["m"]) == len(r["v"]) and sum(a != b for a, b in zip(r["m"], r["v"])) == 1
        assert all(a.isdigit() == b.isdigit() for a, b in zip(r["m"], r["v"]))


def test_near_misses_differ_and_keep_their_family(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"), F.lit("98765").alias("g"), F.lit("number").alias("k"))
    for family in generators.FAMILIES:
        for r in df.withColumn("n", generators.near_misses(F.col("g"), F.col("k"), F.lit(family), F.col("s"), 4)).collect():
            assert len(set(r["n"])) == len(r["n"]) and "98765" not in r["n"] and len(r["n"]) >= 3
            if family == "same_value_prefix":
                assert all(x.startswith("987") for x in r["n"])
            if family == "same_value_suffix":
                assert all(x.endswith("765") for x in r["n"])


def test_every_record_is_a_query_with_its_evidence(spark):
    rows = generators.queries_of(generators.groups(spark, 2, 5, 1)).collect()
    assert len(rows) == 2 * len(generators.TEMPLATES) * 5
    for r in rows:
        assert r["gold_value"] in r["prompt"] and r["key"] in r["prompt"] and len(r["distractor_values"]) == 4
        assert 0 < r["evidence_token_start"] < r["evidence_token_end"] <= r["prompt_tokens"]
    keys = {(r["example_id"].rsplit("-q", 1)[0], r["key"]) for r in rows}
    assert len(keys) == len(rows)


def test_answer_rows(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [8, 9], [5]), ([1], [8], [5])], "prompt_ids array<int>, answer_ids array<int>, suffix_ids array<int>")
    a, b = training.answer_rows(df, 5).collect()
    assert (a["input_ids"], a["target_ids"], a["loss_mask"]) == ([2, 3, 4, 8, 9], [3, 4, 8, 9, 5], [0, 0, 1, 1, 0])
    assert (b["input_ids"], b["target_ids"], b["loss_mask"]) == ([1, 8, 5, 0, 0], [8, 5, 0, 0, 0], [1, 0, 0, 0, 0])
    long = spark.createDataFrame([([1], [7] * 9, [5])], df.schema)
    with pytest.raises(Exception, match="too long"):
        training.answer_rows(long, 5).collect()


def test_last_ids(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],)], "x array<int>")
    assert [r[0] for r in df.select(training.last(F.col("x"), 2)).collect()] == [[2, 3], [1]]


def test_readers_get_equal_shares(spark):
    got = training.dealt(spark.range(1000), "id", 7, 1).collect()
    by = {}
    for r in got:
        by.setdefault(r["rank"], []).append(r["nth"])
    assert len(got) == 994 and all(sorted(v) == list(range(142)) for v in by.values())
    assert training.dealt(spark.range(1000), "id", 7, 1, drop_last=False).count() == 1000


def test_negatives_are_filled_up(spark):
    df = spark.createDataFrame([("g", ["a", "g", "b", "a"], "k1")], "gold string, v array<string>, k string")
    got = df.select(training.negatives(F.col("gold"), F.col("v"), F.col("k"), 5, 1)).first()[0]
    assert len(got) == len(set(got)) == 5 and set(got[:2]) == {"a", "b"} and all(len(x) == 5 for x in got[2:])


def test_windows_are_located(spark):
    w = spark.createDataFrame([(0, 3), (1, 0), (2, 70_000), (3, 2)], "shard_idx long, n long")
    asked = spark.createDataFrame([(i,) for i in (0, 2, 3, 70_002, 70_003, 70_005)], "i long")
    got = {r["i"]: (r["shard_idx"], r["local"]) for r in training.locate(w, asked).collect()}
    assert got == {0: (0, 0), 2: (0, 2), 3: (2, 0), 70_002: (2, 69_999), 70_003: (3, 0)}


def test_listing(spark):
    files = spark.createDataFrame([("d", "o/r", "a b/x.parquet", 5), ("d", "o/r", "y.parquet", None), ("d", "o/r", "z.parquet", 7), ("d", "o/r", "n.txt", 1), ("d", "o/r", "w.parquet", 3)], "dataset string, repo string, path string, size long")
    found = listing.selected(files, r"\.parquet$")
    first = found.filter("path = 'a b/x.parquet'").first()
    assert first["filename"] == "x.parquet" and first["url"].endswith("/a%20b/x.parquet")
    present = spark.createDataFrame([("d", "a b/x.parquet", 5), ("d", "y.parquet", 9), ("d", "z.parquet", 6)], "dataset string, path string, size long")
    r = listing.completeness(found, present).first()
    assert (r["files"], r["complete"], r["missing"], r["wrong_size"], r["bytes"]) == (4, 2, 1, 1, 15)


def test_synthetic_ids(spark):
    rows = readers.synthetic(spark, 5, 8, 100, 1).collect()
    assert all(len(r["ids"]) == 9 and all(0 <= x < 100 for x in r["ids"]) for r in rows) and len({tuple(r["ids"]) for r in rows}) == 5
