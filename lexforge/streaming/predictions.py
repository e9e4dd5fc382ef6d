"""Predictions as a stream: de-duplicated by example, scored, and summed by cell as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.scoring import score_kv

SCHEMA = "example_id string, num_keys int, position_ratio double, target_index int, value string, prompt string, generated_text string, actual_prompt_tokens long, at timestamp"


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int | None = None) -> DataFrame:
    """JSON lines appended to a folder; `files` of them at most in a micro-batch."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).json(folder)


def once(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each example within the watermark: what a resumed run writes again is passed over."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["example_id"])


def running_summary(rows: DataFrame) -> DataFrame:
    """Counts and rates by cell so far, for output mode `complete`; state is a row for each cell."""
    return score_kv(rows).groupBy("num_keys", "position_ratio").agg(
        F.count("*").alias("n"), F.avg("first_value_match").alias("first_value_match"), F.avg("format_error").alias("format_error_rate")
    )


def land(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes in what has arrived, in micro-batches, and stops: each batch is written below the folder under its number.

    A batch that was written but not yet noted in the checkpoint when its run was lost is made again with the same rows and
    replaces what it had left, so every row is there once, however often a run is restarted.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """What land() has written so far."""
    return spark.read.parquet(f"{folder}/batch=*")
