"""Exact quantiles of groups of any size in bounded memory: brackets narrowed by mergeable sketches, then a few rows sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.sources.shared import saved

#: Rows that may be sorted in one place; parts that a round cuts a bracket into, and the sketch's accuracy, 16 times as fine.
FEW, PARTS = 10_000, 256


def quantiles(rows: DataFrame, by: str, value: str, at: dict[str, float], few: int = FEW, parts: int = PARTS) -> DataFrame:
    """rows, cheap to read again -> (by, a column for each name of `at`): that quantile of the group's values, with linear
    interpolation between the two nearest, digit for digit what sorting them all gives.

    The values wanted are those at two ranks for each quantile. Each has a bracket (low, high) that holds it, at first the
    group's extremes. A round sketches what lies in each bracket (its PARTS-quantiles, to a sixteenth of a part), takes the two cuts
    around the rank, and counts exactly what lies below; so a bracket shrinks by a factor of about PARTS / 3 whatever the values
    are, and 10**12 rows take four rounds. When it holds `few` rows, or one value, these decide. Nulls in value are left out; a
    null group is a group.
    """
    same = rows.filter(F.col(value).isNotNull()).select(F.col(by).alias("__by"), F.col(value).cast("double").alias("__x"))
    groups = same.groupBy("__by").agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("n") - 1)).alias("pos")) for k, p in enumerate(at.values())])
    targets = groups.withColumn("t", F.explode(wanted)).select("__by", "n", "low", "high", F.col("t.k").alias("k"), F.col("t.pos").alias("pos"))
    ranks = targets.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    open_ = saved(ranks.select(F.col("__by").alias("by"), "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct())
    needed = saved(targets.select(F.col("__by").alias("by"), "k", "pos"))
    found = None

    def within(brackets: DataFrame) -> DataFrame:
        return same.join(brackets, F.col("__by").eqNullSafe(F.col("by")) & (F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))

    while True:
        one = open_.filter("low = high").select("by", "rank", F.col("low").alias("x"))
        small = within(open_.filter(f"low < high AND inside <= {few}")).groupBy("by", "rank", "below").agg(F.array_sort(F.collect_list("__x")).alias("xs"))
        settled = saved(one.unionByName(small.select("by", "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x"))))
        found = settled if found is None else found.unionByName(settled)
        large = open_.filter(f"low < high AND inside > {few}")
        if large.isEmpty():
            break
        grid = [k / parts for k in range(parts + 1)]
        cut = within(large).groupBy("by", "rank", "below", "inside", "low", "high").agg(F.percentile_approx("__x", grid, 16 * parts).alias("cuts"))
        part = F.floor((F.col("rank") - F.col("below")) * parts / F.col("inside")).cast("int")
        narrow = saved(cut.select("by", "rank", "below", F.when(part < 1, F.col("low")).otherwise(F.get("cuts", part - 1)).alias("low"), F.when(part > parts - 2, F.col("high")).otherwise(F.get("cuts", part + 2)).alias("high"), F.col("low").alias("from"), F.col("high").alias("to")))
        x, low, high = F.col("__x"), F.col("low"), F.col("high")
        ends = same.join(narrow, F.col("__by").eqNullSafe(F.col("by")) & (x >= F.col("from")) & (x <= F.col("to"))).groupBy("by", "rank", "low", "high").agg(
            (F.max("below") + F.count_if(x < low)).alias("below"),
            F.count_if((x >= low) & (x <= high)).alias("inside"),
            F.count_if(x == low).alias("lows"),
            F.count_if(x == high).alias("highs"),
            F.min(F.when(x > low, x)).alias("next"),
            F.max(F.when(x < high, x)).alias("last"),
        )
        # the ends themselves are settled or left out, so repeated values can't hold a bracket open
        at_low, at_high = F.col("rank") < F.col("below") + F.col("lows"), F.col("rank") >= F.col("below") + F.col("inside") - F.col("highs")
        choose = lambda a, b, c: F.when(at_low, a).when(at_high, b).otherwise(c)
        open_ = saved(ends.select("by", "rank", choose(low, high, F.col("next")).alias("low"), choose(low, high, F.col("last")).alias("high"), choose(F.col("below"), F.col("below"), F.col("below") + F.col("lows")).alias("below"), choose(F.col("inside"), F.col("inside"), F.col("inside") - F.col("lows") - F.col("highs")).alias("inside")))
    value_at = lambda r, name: found.select(F.col("by").alias(f"__{name}"), F.col("rank").alias(r), F.col("x").alias(name))
    out = needed.withColumns({"lower": F.floor("pos"), "upper": F.ceil("pos")})
    for r, name in (("lower", "a"), ("upper", "b")):
        v = value_at(f"__{r}", name)
        out = out.join(v, F.col("by").eqNullSafe(F.col(f"__{name}")) & (F.col(r) == F.col(f"__{r}"))).drop(f"__{name}", f"__{r}")
    # the same sum of parts as of sorted values: what is beyond the lower rank counts for the upper one
    mixed = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("upper") - F.col("pos")) * F.col("a") + (F.col("pos") - F.col("lower")) * F.col("b"))
    each = [F.max(F.when(F.col("k") == k, F.col("x"))).alias(name) for k, name in enumerate(at)]
    return out.withColumn("x", mixed).groupBy(F.col("by").alias(by)).agg(*each)
