"""Exact quantiles against sorted values, with brackets that take several rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators.quantiles import quantiles

AT = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}


def exact(xs, p):
    xs, pos = sorted(xs), p * (len(xs) - 1)
    a, b = xs[math.floor(pos)], xs[math.ceil(pos)]
    return a if a == b else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b


@pytest.mark.parametrize("kind", ["even", "spread over exponents", "few values", "one far off"])
def test_quantiles_of_large_groups(spark, kind):
    rng = random.Random(5)
    one = {
        "even": rng.random,
        "spread over exponents": lambda: (-1) ** rng.randrange(2) * 10.0 ** rng.uniform(-300, 300),
        "few values": lambda: float(rng.choice([1, 1, 1, 2, 2, 7])),
        "one far off": lambda: rng.choice([rng.random(), 1e300]),
    }[kind]
    groups = {"hot": [one() for _ in range(6_000)], "small": [one() for _ in range(7)], "single": [one()], None: [one() for _ in range(300)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("hot", None), ("none", None)], "g string, x double").repartition(4).cache()
    got = {r["g"]: r for r in quantiles(df, "g", "x", AT, few=20, parts=16).collect()}
    assert {g: tuple(r[k] for k in AT) for g, r in got.items()} == {g: tuple(exact(v, p) for p in AT.values()) for g, v in groups.items()}


def test_same_digits_as_sorting_all(spark):
    df = spark.range(2_000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id") * 7919 % 1_000).alias("x")).cache()
    whole = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", list(AT.values())).alias("q")).collect()}
    got = quantiles(df, "g", "x", AT, few=50, parts=8).collect()
    assert {r["g"]: [r[k] for k in AT] for r in got} == whole


def test_empty(spark):
    assert quantiles(spark.createDataFrame([], "g string, x double"), "g", "x", AT).count() == 0
