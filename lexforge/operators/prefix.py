"""Running totals that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that share a task, about; bounds of stretches of sparse orders at most.
SPAN, BOUNDS = 1 << 20, 1024


def stretch_of(df: DataFrame, order: str, span: int) -> Column:
    """A number that grows with the order column and that about `span` rows share.

    Where its values are dense, it is their quotient by span, which keys share: a row count and two extremes decide. Where
    they are sparse (hashes, gaps), stretches lie between quantiles of the values, BOUNDS of them at most.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if not n or high - low + 1 <= 4 * n:
        return F.floor(F.col(order) / span).cast("long")
    parts = min(BOUNDS, -(-n // span))
    bounds = sorted({int(x) for x in df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * BOUNDS)).first()[0]}) if parts > 1 else []
    if not bounds:
        return F.lit(0).cast("long")
    # two steps of some 32 comparisons: which row of bounds, then which of its bounds
    rows = [bounds[k : k + 32] for k in range(0, len(bounds), 32)]
    firsts, table = F.array(*[F.lit(r[0]) for r in rows]), F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(order)))
    row = F.greatest(F.lit(0), below(firsts) - 1)
    return (row * 32 + below(F.get(table, row))).cast("long")


def with_running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, span: int = SPAN, domain: DataFrame | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same keys that come before in `order`.

    Rows are dealt by keys and by stretches of `order`, summed within, and shifted by the totals of the stretches before;
    both passes read one exchange. order must be an integer without repeats within the keys; domain,
    if given, a table that has its values, and maybe more, at less cost: where stretches lie is found there. A hot key is thus spread over
    its stretches, and the totals are a row for each stretch.
    """
    at = stretch_of(df if domain is None else domain, order, span)
    dealt = df.withColumn("__stretch", at).repartition(*keys, "__stretch")
    inside = Window.partitionBy(*keys, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__stretch").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("__shift", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    shift = shift.withColumnsRenamed({k: f"__{k}" for k in (*keys, "__stretch")})
    same: Column = F.col("__stretch") == F.col("____stretch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        dealt.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(shift, same, "left")
        .withColumn(name, F.col(name) + F.col("__shift"))
        .drop("__stretch", "__shift", "____stretch", *[f"__{k}" for k in keys])
    )
