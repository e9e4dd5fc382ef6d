"""The folder that driver and executors share: for files that a query writes and reads again, and for rows computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers bounded by bytes: rows of long texts or lists else make batches of any size. It is a setting of the
    session, which is set here unless the session has a smaller one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without that gets a folder of its own, once for its session, a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexforge-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once and read from there ever after, so that lost executors cost no recomputation."""
    root(df.sparkSession)
    return df.checkpoint(eager=True)
