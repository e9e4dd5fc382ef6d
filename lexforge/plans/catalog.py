"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.plans import corpus, evaluation, extra, files, gates, more, training

PARTS = (corpus.QUERIES, evaluation.QUERIES, training.QUERIES, more.QUERIES, files.QUERIES, extra.QUERIES, gates.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in PARTS for name, (run, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.items() if sql}
