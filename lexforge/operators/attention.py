"""Attention-distribution metrics over arrays of weights, and their means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("entropy", "entropy_norm", "top1_mass", "top5_mass", "sink_mass_first16", "local_mass_128", "local_mass_512", "local_mass_2048", "far_mass_4096_plus", "far_mass_8192_plus", "evidence_mass", "effective_span_80")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def query_metrics(rows: DataFrame, local: tuple[int, ...] = (128, 512, 2048), far: tuple[int, ...] = (4096, 8192), sink: int = 16, topk: tuple[int, ...] = (1, 5)) -> DataFrame:
    """rows (probs array<double>, query int, evidence_start, evidence_end, ...) with the metrics of each distribution.

    Weights up to the query, itself included, are normalised for entropy, top-k, sink and span; local, far and evidence
    masses are of the weights as they are. Without an evidence span the evidence mass is NaN.
    """
    n = F.col("query") + 1
    out = rows.withColumn("__raw", F.slice("probs", F.lit(1), n)).withColumn("__n", F.size("__raw"))
    out = out.withColumn("__p", F.transform("__raw", lambda x: x / F.greatest(F.lit(1e-20), total(F.col("__raw")))))
    size, p, raw = F.col("__n"), F.col("__p"), F.col("__raw")
    entropy = -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(1e-20)))))
    down = F.reverse(F.array_sort(p))
    reached = F.aggregate(
        F.reverse(p),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("hit")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n"), F.when((s["hit"] == 0) & (s["sum"] + x >= 0.8), s["n"] + 1).otherwise(s["hit"]).alias("hit")),
        lambda s: s["hit"],
    )
    low, high = F.greatest(F.lit(0), F.col("evidence_start")), F.least(size, F.col("evidence_end"))
    evidence = F.when(F.col("evidence_start").isNull() | F.col("evidence_end").isNull(), F.lit(float("nan"))).otherwise(total(F.slice(raw, low + 1, F.greatest(F.lit(0), high - low))))
    values = {"entropy": entropy, "entropy_norm": entropy / F.log(F.greatest(size, F.lit(2)))}
    values |= {f"top{k}_mass": total(F.slice(down, 1, k)) for k in topk}
    values[f"sink_mass_first{sink}"] = total(F.slice(p, 1, sink))
    values |= {f"local_mass_{w}": total(F.slice(raw, F.greatest(F.lit(1), size - w + 1), F.lit(w))) for w in local}
    values |= {f"far_mass_{d}_plus": total(F.slice(raw, F.lit(1), F.greatest(F.lit(0), size - d))) for d in far}
    values |= {"evidence_mass": evidence, "effective_span_80": F.when(reached > 0, reached).otherwise(size).cast("double")}
    return out.withColumns(values).drop("__raw", "__n", "__p", "probs")


def means(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means of the metrics by keys, NaN values left out and NaN where no other are; and the collapse score."""
    mean = {m: F.coalesce(F.avg(F.nanvl(F.col(m), F.lit(None))), F.lit(math.nan)).alias(m) for m in metrics}
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *mean.values())
    return out.withColumn("collapse_score", (1.0 - F.col("entropy_norm") + F.col("top5_mass") + F.col("sink_mass_first16")) / 3.0)
