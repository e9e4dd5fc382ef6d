"""The transactional shard sink: all shards and manifests, or nothing."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import shards
from lexforge.sources import readers
from lexforge.sources.shardsink import write_shards


def pieces(spark, n=60, phases=("4k", "8k", "a b"), size=50):
    rng = random.Random(2)
    docs = [(i, rng.choice("xy"), rng.choice(phases), [rng.randrange(60_000) for _ in range(rng.randrange(0, 40))]) for i in range(n)]
    df = spark.createDataFrame(docs, "seq long, source string, phase string, ids array<int>").repartition(5)
    return docs, shards.cut(df, size, span=16, keys=("phase",))


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_phases_shards_and_manifests(spark, tmp_path):
    docs, rows = pieces(spark)
    write_shards(rows, f"{tmp_path}/out", vocabulary=60_000, eod_id=1)
    for phase in ("4k", "8k", "a b"):
        home = tmp_path / "out" / phase
        m = json.loads((home / "manifest.json").read_text())
        stream = [x for _, _, p, ids in sorted(docs) if p == phase for x in ids]
        got = np.concatenate([np.fromfile(home / s["path"], np.uint16) for s in m["shards"]])
        assert got.tolist() == stream and m["total_tokens"] == len(stream) and m["phase"] == phase and m["eod_id"] == 1
        assert all(s["tokens"] == 50 for s in m["shards"][:-1]) and [s["path"] for s in m["shards"]] == [f"shard_{k:06d}.bin" for k in range(len(m["shards"]))]
        by = {s: sum(len(ids) for _, src, p, ids in docs if p == phase and src == s) for s in "xy"}
        assert {s: sum(x["source_tokens"].get(s, 0) for x in m["shards"]) for s in "xy"} == by
        assert [r["tokens"] for r in readers.manifest(spark, str(home / "manifest.json")).collect()] == [s["tokens"] for s in m["shards"]]
    assert not [f for f in files(tmp_path) if "_stage" in f]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    _, rows = pieces(spark)
    late = rows.withColumn("piece", F.when((F.col("phase") == "8k") & (F.col("shard_idx") == 1), F.array(F.lit(70_000))).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="out of range"):
        write_shards(late, f"{tmp_path}/out")
    assert files(tmp_path) == []
    with pytest.raises(Exception, match="after"):
        write_shards(rows.filter("shard_start > 0"), f"{tmp_path}/out")
    assert files(tmp_path) == []


def test_standing_shards_are_kept_or_replaced(spark, tmp_path):
    _, rows = pieces(spark)
    out = f"{tmp_path}/out"
    write_shards(rows.filter("phase = '4k'").drop("phase", "source"), out)
    Path(out, "notes.txt").write_text("stays")
    before = files(out)
    with pytest.raises(Exception, match="holds shards"):
        write_shards(rows, out)
    assert files(out) == before and "manifest.json" in before
    bad = rows.withColumn("piece", F.array(F.lit(-1)))
    with pytest.raises(Exception, match="out of range"):
        write_shards(bad, out, overwrite=True)
    assert files(out) == before
    write_shards(rows.filter("phase = '8k'"), out, overwrite=True)
    assert {f.split("/")[0] for f in files(out)} == {"8k", "notes.txt"}


def test_a_path_with_a_comma_and_known_counts(spark, tmp_path):
    np.arange(10, dtype=np.uint16).tofile(tmp_path / "a,b.bin")
    rows = readers.token_shards(spark, [f"{tmp_path}/a,b.bin"], block=4, counts=[10]).orderBy("token_start").collect()
    assert [x for r in rows for x in r["ids"]] == list(range(10))
    assert spark.read.format("token_shards").load(f"{tmp_path}/a,b.bin").count() == 1
