"""Range sharding by sampled splitters: near equal bytes for each shard, rows in key order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut, mapped

SHARDS = 40
#: Sampled keys for each range, ranges for each shard, rows that a range should hold, and most ranges: the driver holds
#: some 16 numbers for each, 10 MB, whatever the rows. Beyond, ranges are larger and their sort spills.
SAMPLES, FINE, ROWS, RANGES = 16, 16, 100_000, 16_384
#: A range over this multiple of the mean is subdivided, in so many rounds at most; then only rows that are that large
#: themselves, or repeated ids, are left together.
OVERFULL, ROUNDS = 2.0, 4


def records(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, key, tie). Equal texts share a key, so they stand together, in the order
    of tie: the doc_id, or for a null one the row's place, so that rows without ids can be parted too."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id() - F.lit(1 << 62)).alias("tie"),
    )


def ranges_of(key: np.ndarray, tie: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """For each (key, tie): how many of the splitters (keys, ties), sorted by both, are smaller or equal."""
    if not len(keys):
        return np.zeros(len(key), np.int64)
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    out = low.copy()
    same = np.flatnonzero(low < high)
    for a in np.unique(low[same]).tolist():
        rows = same[low[same] == a]
        out[rows] = a + np.searchsorted(ties[a : high[rows[0]]], tie[rows], "right")
    return out


def in_ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows with their range number. There are about RANGES splitters at most; tasks get them as two arrays."""
    keys, ties = (np.array([x[k] for x in splitters], np.int64) for k in range(2))
    held = rows.sparkSession.sparkContext.broadcast((keys, ties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = ranges_of(*(b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)), *held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return mapped(rows, run, "doc_id long, size long, text_crc32 long, key long, tie long, part long")


def sample(rows: DataFrame, rate, salt: int) -> list[tuple[int, int, int]]:
    """(key, tie, part) of rows drawn with a chance of size * rate: by a hash, so a rerun draws the same."""
    u = F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(salt)), 11) / float(1 << 53)
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    return sorted(tuple(r) for r in rows.filter(u < F.col("size") * rate).select("key", "tie", part).collect())


def splitters_of(drawn: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """n - 1 quantiles of the drawn keys, distinct."""
    return sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard): a row for each row.

    Law `bytes`: shard sizes are equal up to about the largest document. Keys (text hash, doc_id or place) are sampled with
    weights of size, their quantiles cut the key space into ranges, overfull ranges are subdivided by a closer sample,
    and exact sums over the ranges and a running sum within each place every row on one line of bytes, which is cut
    into equal shards. A group of equal texts stays together unless a cut falls into it. slot counts a shard's rows
    from 0 in key order; null texts count as empty; repeated rows take slots of their own; grown_shard is null, as it
    belongs to another law. An empty table gives no rows.
    """
    rows = cut(records(docs))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    fine = max(FINE * shards, min(RANGES, n // ROWS))
    splitters = splitters_of([x[:2] for x in sample(rows, fine * SAMPLES / total, 0)], fine)
    for salt in range(1, ROUNDS + 1):
        parted = in_ranges(rows, splitters)
        limit = OVERFULL * total / fine
        sums = parted.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
        over = {r["part"]: r["bytes"] for r in sums if r["rows"] > 1 and r["bytes"] > limit}
        if not over or salt == ROUNDS:
            break
        closer = sample(parted.filter(F.col("part").isin([*over])), 8 * SAMPLES * fine / total, salt)
        more = set(splitters)
        for part, size in over.items():
            more |= set(splitters_of([x[:2] for x in closer if x[2] == part], int(2 * size / limit) + 2))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    offsets, at, rank = [], 0, 0
    for r in sums:
        offsets.append((r["part"], at, rank))
        at, rank = at + r["bytes"], rank + r["rows"]
    starts = docs.sparkSession.createDataFrame(offsets, "part long, byte_at long, row_at long")
    line = Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        parted.withColumns({"upto": F.sum("size").over(line), "nth": F.count("*").over(line)})
        .join(F.broadcast(starts), "part")  # as many rows as ranges, about RANGES at most
        .withColumn("middle", F.col("byte_at") + F.col("upto") - F.col("size") / 2.0)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / total)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("row_at") + F.col("nth") - 1).alias("nth"))
    )
    placed = cut(placed, n)
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
