"""Rows with ids or long texts: what a task holds of them, and how many tasks they make."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge.functions import encode
from lexforge.operators import shards
from lexforge.sources import readers, sinks


def test_a_task_reads_many_small_files(spark, tmp_path):
    files = []
    for k in range(30):
        (tmp_path / f"shard_{k:06d}.bin").write_bytes(bytes([k, 0] * (50 + k)))
        files.append([f"{tmp_path}/shard_{k:06d}.bin", None])
    reader = readers._ShardReader({"files": json.dumps(files), "block": "20"})
    assert len(reader.partitions()) == 1
    rows = readers.token_shards(spark, [p for p, _ in files], block=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["token_start"])):
        assert r["token_start"] % 20 == 0 and len(r["ids"]) <= 20
        got.setdefault(r["path"], []).extend(r["ids"])
    assert [got[p] for p, _ in files] == [[k] * (50 + k) for k in range(30)]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(bytes([7, 0] * 1000))
    monkeypatch.setattr(readers, "TASK_TOKENS", 300)
    parts = readers._ShardReader({"files": json.dumps([[f"{tmp_path}/a.bin", 1000], [f"{tmp_path}/b.bin", 10]]), "block": "100"}).partitions()
    assert [[x[1:] for x in p.pieces] for p in parts] == [[(0, 300)], [(300, 600)], [(600, 900)], [(900, 1000), (0, 10)]]


def test_batches_of_shards_are_bounded_by_bytes(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    rows = spark.range(3).select(F.col("id").alias("shard_idx"), F.array_repeat(F.col("id").cast("int"), 5).alias("ids"))
    assert sinks.write_token_shards(rows, str(tmp_path / "out")).count() == 3
    assert int(spark.conf.get(name)) <= 4 << 20
    spark.conf.set(name, before)
    nulls = spark.sql("SELECT 0L AS shard_idx, array(1, null) AS ids")
    with pytest.raises(Exception, match="null"):
        sinks.write_token_shards(nulls, str(tmp_path / "null")).collect()


def test_a_stretch_of_ids_is_short(spark):
    docs = spark.range(20_000).select(F.col("id").alias("seq"), F.array(F.col("id").cast("int")).alias("ids"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = shards.cut(docs, 64).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 20_000


def test_texts_are_encoded_in_slices():
    assert [*encode.slices(["aa", "b", "cccc", "", "dd"], 3)] == [["aa", "b"], ["cccc"], ["", "dd"]]
    assert [*encode.slices([], 3)] == []
