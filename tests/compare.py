"""Spark results against SQL results, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "item"):
        return value(x.item())
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x


def difference(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """'' if rows, column names and kinds of columns agree."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    found = c.sql(sql)
    names = sorted(df.columns)
    if names != sorted(found.columns):
        return f"columns {names} and {sorted(found.columns)}"
    mine = {n: kinds.get(t, t) for n, t in df.dtypes}
    other = dict(zip(found.columns, map(str, found.types)))
    if mine != other:
        return f"types {[(n, mine[n], other[n]) for n in names if mine[n] != other[n]]}"
    a = Counter(tuple(value(r[n]) for n in names) for r in df.collect())
    b = Counter(map(lambda r: tuple(map(value, r)), found.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()))
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only in one: {list((a - b).items())[:3]}; in the other: {list((b - a).items())[:3]}"
