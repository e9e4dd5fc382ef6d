"""Session factory: settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lexforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting; ANSI stays as Spark has it. conf: more settings, `_` for `.`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()
