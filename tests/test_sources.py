"""Readers, sinks and the prediction stream, on small files."""

import gzip
import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lexforge.sources import readers, sinks


def lines(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def test_corpora_of_all_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines({"text": "one"}, {"text": ""}, {"text": "two"}))
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress((lines({"content": "three"}) + "{broken\n\n" + lines({"content": "four"})).encode()))
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(lines({"body": ["x", "", "y"]}).encode()))
    (tmp_path / "d.txt").write_text("five\n\nsix")
    spark.createDataFrame([("seven", 1)], "text string, n int").write.parquet(str(tmp_path / "e.parquet"))
    got = readers.corpora(spark, {"s": [str(tmp_path / x) for x in ("a.jsonl", "b.jsonl.zst", "c.jsonl.gz", "d.txt", "e.parquet", "a.jsonl")]})
    assert sorted(r["text"] for r in got.collect()) == sorted(["one", "two", "three", "four", "x\n\ny", "five\n\nsix", "seven"])
    assert got.columns == ["source", "text", "path"]


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines({"text": "one"}) + "{broken\n")
    with pytest.raises(Exception):
        readers.corpus(spark, str(tmp_path / "a.jsonl"), "s", strict=True).collect()
    with pytest.raises(ValueError):
        readers.corpus(spark, str(tmp_path / "a.doc"), "s")


def test_nested_text(spark):
    df = spark.createDataFrame([({"text": "", "body": {"content": "in"}},)], "r struct<text:string,body:struct<content:string>>")
    assert df.select(readers.extract_text(df.schema["r"].dataType, F.col("r")).alias("x")).first()["x"] == "in"


def test_records_of_other_sizes_come_from_the_largest(spark, tmp_path):
    row = {"key": "k", "value": "v", "ordered_kv_records": [["k", "v"], ["l", "w"]]}
    (tmp_path / "kv-retrieval-300_keys.jsonl.gz").write_bytes(gzip.compress(lines(row).encode()))
    assert readers.kv_records(spark, str(tmp_path), 40).first()["ordered_kv_records"][1] == ["l", "w"]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿num_keys,accuracy\n75,0.5\n".encode())
    r = readers.csv(spark, str(tmp_path / "x.csv")).first()
    assert (r["num_keys"], r["accuracy"]) == (75, 0.5)


def test_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2, 65535]), (1, [4])], "shard_idx long, ids array<int>")
    written = sinks.write_token_shards(df, str(tmp_path / "out")).orderBy("shard_idx").collect()
    assert [r["tokens"] for r in written] == [3, 1]
    rows = readers.token_shards(spark, [r["path"] for r in written], block=2).orderBy("path", "token_start").collect()
    assert [r["ids"] for r in rows] == [[1, 2], [65535], [4]]
    text = sinks.manifest_json(spark.createDataFrame(written), "uint16", 65536, 1)
    (tmp_path / "out" / "manifest.json").write_text(text)
    got = readers.manifest(spark, str(tmp_path / "out" / "manifest.json")).orderBy("shard_idx").collect()
    assert [(r["tokens"], r["dtype"]) for r in got] == [(3, "uint16"), (1, "uint16")] and got[0]["path"].endswith("out/shard_000000.bin")


def test_ids_out_of_range_and_torn_files_fail(spark, tmp_path):
    df = spark.createDataFrame([(0, [70_000])], "shard_idx long, ids array<int>")
    with pytest.raises(Exception, match="out of range"):
        sinks.write_token_shards(df, str(tmp_path / "bad")).collect()
    (tmp_path / "torn.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole tokens"):
        readers.token_shards(spark, [str(tmp_path / "torn.bin")]).collect()


def test_manifest_aliases(spark, tmp_path):
    """The first alias that has a value counts, in the order of the table; an entry may be a path alone."""
    for name in ("a.bin", "b.bin", "c.bin"):
        (tmp_path / name).write_bytes(b"\x01\x00" * 4)
    np.save(tmp_path / "d.npy", np.arange(7, dtype=np.int32))
    shards = [
        {"shard_path": "zz.bin", "name": "a.bin", "file": "", "token_count": 9, "tokens": 0, "num_tokens": 5, "size": 3},
        {"relpath": "c.bin", "tokens_path": str(tmp_path / "b.bin"), "data_type": "int32", "np_dtype": "x"},
        "b.bin",
        {"filename": "d.npy", "length": None},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"token_dtype": "uint16", "shards": shards}))
    got = readers.manifest(spark, str(tmp_path / "m.json")).orderBy("shard_idx").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["tokens"], r["dtype"]) for r in got] == [("a.bin", 5, "uint16"), ("c.bin", 2, "int32"), ("b.bin", 4, "uint16"), ("d.npy", 7, "uint16")]
    assert readers.manifest(spark, str(tmp_path / "m.json"), limit=2).count() == 2
    rows = readers.token_shards(spark, [str(tmp_path / "d.npy")], block=4).orderBy("token_start").collect()
    assert [r["ids"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6]]
    for bad, error in (({"shards": [{"path": "none.bin"}]}, FileNotFoundError), ({"shards": [{"tokens": 3}]}, ValueError), ({"shards": []}, ValueError), ({}, ValueError)):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(error):
            readers.manifest(spark, str(tmp_path / "bad.json"))
    np.save(tmp_path / "e.npy", np.zeros((2, 2)))
    with pytest.raises(ValueError, match="dimension"):
        readers.token_count(str(tmp_path / "e.npy"), "int32")


def test_listing_and_folders(tmp_path):
    for name in ("b.jsonl", "a.parquet", "c.jsonl.zst", "d.zst", "e.txt", "f.json"):
        (tmp_path / name).write_bytes(b"")
    names = [x.rsplit("/", 1)[1] for x in readers.source_files(str(tmp_path))]
    assert names == ["a.parquet", "b.jsonl", "c.jsonl.zst", "d.zst"]
    mixed = readers.source_files(str(tmp_path), shuffle=True, seed=3)
    assert sorted(mixed) == readers.source_files(str(tmp_path)) and mixed == readers.source_files(str(tmp_path), True, 3)
    assert readers.source_files(str(tmp_path), True, 3, limit=2) == mixed[:2]
    assert readers.source_folders("/r/", {"a": "x"}) == {"a": "/r/x"}


def test_ordered_text(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"two\xff")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    assert readers.corpus_text(spark, str(tmp_path)).first()["text"] == "one\n\ntwo\ufffd"
    assert readers.corpus_text(spark, str(tmp_path / "a.txt")).first()["text"] == "one"
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        readers.corpus_text(spark, str(tmp_path / "empty")).collect()


def test_checkpoints(tmp_path):
    for name in ("run_a", "run_b", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "last.pt").write_text("x")
    root = str(tmp_path)
    assert [n for n, _ in readers.checkpoints(root, "*/last.pt", prefix="run_")] == ["other", "a", "b"]
    assert [n for n, _ in readers.checkpoints(root, "*/last.pt", prefix="run_", wanted=["b"])] == ["b"]
    assert readers.checkpoints(root, "", named=[f"x={root}/other/last.pt"]) == [("x", f"{root}/other/last.pt")]
    for call in (lambda: readers.checkpoints(root, "*.none"), lambda: readers.checkpoints(root, "", named=[f"x={root}/no.pt"])):
        with pytest.raises(FileNotFoundError):
            call()
    with pytest.raises(ValueError):
        readers.checkpoints(root, "", named=["x"])


def test_overwrite_guard_and_headers(spark, tmp_path):
    folder = str(tmp_path / "out")
    sinks.prepare_folder(folder)
    (tmp_path / "out" / "shard_000000.bin").write_text("x")
    (tmp_path / "out" / "notes.txt").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.prepare_folder(folder)
    sinks.prepare_folder(folder, overwrite=True)
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["notes.txt"]
    assert sinks.header_of([{"b": 1}, {"a": 1, "b": 2}]) == ["b", "a"] and sinks.header_of([{"b": 1}, {"a": 1}], "sorted") == ["a", "b"]
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    sinks.write_csv(df, f"{folder}/s", "sorted")
    assert spark.read.csv(f"{folder}/s", header=True).columns == ["a", "b"]
    sinks.write_csv(df.limit(0), f"{folder}/none")
    assert "".join(p.read_text() for p in (tmp_path / "out" / "none").glob("*.csv")) == ""
    sinks.write_merged(df, df, f"{folder}/m", ["b"])
    assert readers.jsonl(spark, f"{folder}/m/predictions").count() == spark.read.csv(f"{folder}/m/summary", header=True).count() == 1


def test_reports(spark):
    import xml.dom.minidom

    df = spark.createDataFrame([(75, 0.5, "a|b")], "keys int, rate double, name string")
    text = sinks.memo("Result", [("Run", "words"), ("Table", df)])
    assert text.startswith("# Result\n") and "| 75 | 0.5 | a\\|b |" in text
    charts = [sinks.line_chart({"75 & more": [(0.0, 1.0), (1.0, 0.2)]}, "a < b"), sinks.heat_map({("75", "0"): 0.5, ("140", "1"): 1.0}, "t"), sinks.stacked_bars({"75": {"correct": 0.7, "wrong": 0.3}}, "t"), sinks.line_chart({}, "none")]
    for svg in charts:
        xml.dom.minidom.parseString(svg)
    assert sinks.page("T", charts).count("<svg") == 4
    rows, seen = sinks.observed(df, "progress", n=F.count("*"))
    rows.collect()
    assert seen.get == {"n": 1}
    assert json.loads(sinks.build_stats_json(spark.createDataFrame([("s", 3)], "source string, docs long"), 1.23456)) == {"manifest": "manifest.json", "elapsed_sec": 1.235, "stats": {"s": {"docs": 3}}}


def test_prediction_stream(spark, tmp_path):
    from lexforge.streaming import predictions

    u = "00000000-0000-0000-0000-00000000000a"
    row = {"example_id": "e1", "num_keys": 1, "position_ratio": 0.0, "target_index": 0, "value": u, "prompt": f"Key: k | Value: {u}\n", "generated_text": u, "actual_prompt_tokens": 9, "at": "2024-01-01T00:00:00Z"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(lines(row, row, row | {"example_id": "e2", "generated_text": "?"}))
    q = predictions.running_summary(predictions.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("cells").first()
    assert (r["n"], round(r["first_value_match"], 6), round(r["format_error_rate"], 6)) == (3, 0.666667, 0.333333)
    q = predictions.once(predictions.read(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def test_a_stream_that_restarts_in_the_middle_of_a_batch(spark, tmp_path):
    """The last batch is written but not noted when the run is lost; it is made again, and every row is there once."""
    from lexforge.streaming import predictions

    rows = [(f"e{k % 30}", 8, 0.5, 0, "v", "p", "v", 3, f"2024-01-01 00:00:{k % 50:02d}") for k in range(60)]
    df = spark.createDataFrame(rows, predictions.SCHEMA.replace("at timestamp", "at string")).repartition(6)
    df.write.json(f"{tmp_path}/in")
    go = lambda: predictions.land(predictions.once(predictions.read(spark, f"{tmp_path}/in", files=2)).select("example_id"), f"{tmp_path}/out", f"{tmp_path}/check")
    go()
    first = sorted(r["example_id"] for r in predictions.landed(spark, f"{tmp_path}/out").collect())
    assert first == sorted(f"e{k}" for k in range(30))
    commits = sorted((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) >= 3
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    df.limit(5).write.mode("append").json(f"{tmp_path}/in")
    go()
    assert sorted(r["example_id"] for r in predictions.landed(spark, f"{tmp_path}/out").collect()) == first


def test_lines_keep_their_numbers_when_a_file_is_split(spark, tmp_path):
    lines = [f"{k} " + "x" * (k * 37 % 90) for k in range(3_000)]
    (tmp_path / "b.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "a.txt").write_text("first\n\nthird")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(f"{tmp_path}/b.txt").rdd.getNumPartitions() > 5
        assert [r["value"] for r in rows.orderBy("n").collect()] == ["first", "", "third", *lines]
        assert [r["n"] for r in rows.orderBy("n").collect()] == list(range(3_003))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_frames_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    """Frames with and without sizes and checksums, one to skip, lines and characters cut anywhere, frames within one line."""
    import io
    import random
    import struct

    import zstandard

    from lexforge.sources import zstframes

    rng = random.Random(1)
    lines = [f"{k} é漢 " + "y" * rng.choice([0, 3, 50, 4_000]) for k in range(400)] + ["z" * 50_000, "end"]
    raw, out, at, spans = "\n".join(lines).encode(), io.BytesIO(), 0, []
    while at < len(raw):
        n = rng.choice([1, 7, 500, 9_000])
        frame = zstandard.ZstdCompressor(write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5).compress(raw[at : at + n])
        spans.append((out.tell(), len(frame)))
        out.write(frame)
        if rng.random() < 0.1:
            out.write(struct.pack("<II", 0x184D2A50 + rng.randrange(16), 5) + b"12345")
        at += n
    (tmp_path / "a.zst").write_bytes(out.getvalue())
    (tmp_path / "b.zst").write_bytes(zstandard.compress(b"one\n\ntwo\n") + zstandard.compress(b""))
    assert len(spans) > 20 and list(zstframes.frames(io.BytesIO(out.getvalue()), len(out.getvalue()))) == spans
    rows = zstframes.zst_lines(spark, [f"{tmp_path}/a.zst", f"{tmp_path}/b.zst"], step=1_000)
    got = rows.collect()
    assert sorted(r["line"] for r in got if r["path"].endswith("a.zst")) == sorted(lines)
    assert sorted(r["line"] for r in got if r["path"].endswith("b.zst")) == ["one", "two"]
    by = spark.read.format("binaryFile").load(str(tmp_path)).count()
    tasks = rows.filter("path LIKE '%a.zst'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert by == 2 and tasks > 1
    (tmp_path / "torn.zst").write_bytes(out.getvalue()[:-3])
    with pytest.raises(Exception, match="cut short|no zstd frame|reserved"):
        zstframes.zst_lines(spark, [f"{tmp_path}/torn.zst"]).collect()
