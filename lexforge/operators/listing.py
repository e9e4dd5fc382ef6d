"""File listings of a corpus: which files count, what is there, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selected(files: DataFrame, pattern: str) -> DataFrame:
    """files (dataset, repo, path, size) whose path matches, with filename and the address to fetch it from."""
    return files.filter(F.col("path").rlike(pattern)).withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1)).withColumn(
        "url", F.concat(F.lit("https://host/"), "repo", F.lit("/resolve/main/"), F.array_join(F.transform(F.split("path", "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/"))
    )


def completeness(listed: DataFrame, present: DataFrame) -> DataFrame:
    """By dataset: files listed, complete, missing and of another size, and GiB. A listed size that is null fits any."""
    rows = listed.join(present.select("dataset", "path", F.col("size").alias("found")), ["dataset", "path"], "left")
    fits = F.col("found").isNotNull() & (F.col("size").isNull() | (F.col("size") == F.col("found")))
    return rows.groupBy("dataset").agg(
        F.count("*").alias("files"),
        F.count_if(fits).alias("complete"),
        F.count_if(F.col("found").isNull()).alias("missing"),
        F.count_if(F.col("found").isNotNull() & ~fits).alias("wrong_size"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        (F.coalesce(F.sum("size"), F.lit(0)) / float(1 << 30)).alias("gib"),
    )
