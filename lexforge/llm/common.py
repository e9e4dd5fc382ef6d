"""What the training-data operators share: the shared folder, lineage cuts and small guards."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and a worker, and rows of a checkpointed part of a small table.
BATCH_BYTES, PART_ROWS = 4 << 20, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of
    its own, and a cluster, whose executors could not read that, an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexforge-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder once and read from there ever after; with `rows`, at most as many as it has, in
    files of PART_ROWS about instead of one for each shuffle partition."""
    shared_dir(df.sparkSession)
    return (df if rows is None else in_files(df, rows)).checkpoint(eager=True)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df, a narrow table of so many rows, in parts of PART_ROWS about: one for each shuffle partition makes many tiny files."""
    return df.coalesce(1 + rows // PART_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """The strings' bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that the texts of each slice have about `most` bytes (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype("int64")
        group = np.cumsum(sizes) // most
        at = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def fold(column: str, modulus: int):
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of the highest counts, whole count levels only and `most` rows at most: safe to collect.

    The levels are cut by a histogram of counts, itself limited to the counts' distinct values.
    """
    kept, least = 0, None
    levels = counts.groupBy(column).agg(F.count("*").alias("__rows")).orderBy(F.desc(column))
    for row in levels.toLocalIterator():
        if kept + row["__rows"] > most:
            break
        kept, least = kept + row["__rows"], row[column]
    return counts.filter(F.col(column) >= F.lit(least)) if least is not None else counts.limit(0)


def mapped(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema) in batches bounded by bytes: rows of long texts else make batches of any size on both sides.

    The bound is a setting of the session, which is set here unless the session has a smaller one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
