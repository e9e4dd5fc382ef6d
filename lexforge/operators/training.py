"""What a training loop is fed: masks, trims, orders, samplers, mixes; and reductions of token losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.prefix import with_running_total


def answer_rows(rows: DataFrame, length: int) -> DataFrame:
    """rows (prompt_ids, answer_ids, suffix_ids) -> input_ids, target_ids and loss_mask of `length` places.

    The prompt loses its beginning where all would be too long; places after the end are 0. The mask is 1 where the
    target is a token of the answer. Fails if the answer alone does not fit.
    """
    over = F.greatest(F.lit(0), F.size("prompt_ids") + F.size("answer_ids") + F.size("suffix_ids") - (length + 1))
    cut = F.when(over < F.size("prompt_ids"), F.slice("prompt_ids", over + 1, F.size("prompt_ids"))).otherwise(
        F.when(over == 0, F.col("prompt_ids")).otherwise(F.raise_error(F.lit("example too long after trimming the prompt")).cast("array<int>"))
    )
    out = rows.withColumn("__p", cut).withColumn("__ids", F.concat("__p", "answer_ids", "suffix_ids"))
    padded = F.concat("__ids", F.array_repeat(F.lit(0), F.lit(length + 1) - F.size("__ids")))
    first = F.size("__p") - 1
    mask = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((i >= first) & (i < first + F.size("answer_ids")) & (i >= 0)).cast("int"))
    return out.withColumn("__x", padded).withColumns({"input_ids": F.slice("__x", 1, length), "target_ids": F.slice("__x", 2, length), "loss_mask": mask}).drop("__p", "__ids", "__x")


def last(ids: Column, keep: int) -> Column:
    """The last `keep` ids."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - keep + 1), F.lit(keep))


def order_key(key: Column, seed: int) -> Column:
    """Sorting by this is a shuffle that the seed fixes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def dealt(rows: DataFrame, key: str, ranks: int, seed: int, drop_last: bool = True) -> DataFrame:
    """rows with (rank, nth): the shuffled order dealt to `ranks` readers in turn, each getting as many rows.

    The order is found by the hash's first four digits and a count of each, so no task sorts all rows.
    """
    marked = rows.withColumn("__h", order_key(F.col(key), seed)).withColumn("__p", F.substring("__h", 1, 4))
    counts = marked.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumns(  # 65,536 rows at most
        {"__b": F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__t": F.sum("__n").over(Window.partitionBy(F.lit(0)))}
    )
    at = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)) - 1
    out = marked.withColumn("__i", at).join(before.drop("__n"), "__p")
    out = out.withColumn("__at", F.col("__b") + F.col("__i"))
    if drop_last:
        out = out.filter(F.col("__at") < F.col("__t") - F.col("__t") % ranks)
    return out.withColumn("rank", (F.col("__at") % ranks).cast("int")).withColumn("nth", F.floor(F.col("__at") / ranks)).drop(*[c for c in out.columns if c.startswith("__")])


def negatives(gold: Column, values: Column, key: Column, n: int, seed: int) -> Column:
    """n values other than gold in an order that the key fixes; five-digit numbers fill up where there are fewer."""
    others = F.array_distinct(F.filter(values, lambda v: v != gold))
    shuffled = F.transform(F.array_sort(F.transform(others, lambda v: F.struct(order_key(F.concat(key, F.lit("/"), v), seed).alias("h"), v.alias("v")))), lambda s: s["v"])
    fresh = F.transform(F.sequence(F.lit(1), F.lit(2 * n + 2)), lambda i: (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{seed}/"), i.cast("string"))), 1, 7), 16, 10).cast("long") % 90_000 + 10_000).cast("string"))
    fill = F.array_distinct(F.filter(fresh, lambda v: (v != gold) & ~F.array_contains(others, v)))
    return F.slice(F.concat(shuffled, fill), 1, n)


def mixed(steps: DataFrame, replay: int, retrieval: int) -> DataFrame:
    """steps (step) -> the batch of either loader that a step takes when both are cycled through."""
    return steps.withColumn("replay_batch", F.col("step") % replay).withColumn("retrieval_batch", F.col("step") % retrieval).withColumn("epoch", F.floor(F.col("step") / retrieval))


def losses(logprobs: Column) -> dict[str, Column]:
    """Sum, mean negative log-likelihood and perplexity, capped at e^80, of an answer's token log-probabilities."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)
    nll = -total / F.greatest(F.lit(1), F.size(logprobs))
    return {"sum_logprob": total, "mean_nll": nll, "ppl": F.exp(F.least(F.lit(80.0), nll))}


def locate(windows: DataFrame, asked: DataFrame) -> DataFrame:
    """windows (shard_idx, n), asked (i) -> (i, shard_idx, local): where the i-th window of all shards is.

    Running totals are taken in stretches of shard_idx; the lookup is an equality on blocks of indices.
    """
    w = with_running_total(windows, [], "shard_idx", "n", "first").filter("n > 0")
    block = 1 << 16
    spread = w.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("n") - 1) / block))))
    return asked.withColumn("block", F.floor(F.col("i") / block)).join(spread, "block").filter("i >= first AND i < first + n").select("i", "shard_idx", (F.col("i") - F.col("first")).alias("local"))


def collated(rows: DataFrame, size: int, columns: list[str], order: str = "nth") -> DataFrame:
    """rows (nth, ...) -> (batch, one list of each column): `size` rows of consecutive places in each, in order; the last may
    have fewer."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns)))
    out = rows.withColumn("batch", F.floor(F.col(order) / size)).groupBy("batch").agg(each.alias("r"))  # size rows
    return out.select("batch", *[F.expr(f"transform(r, x -> x.`{c}`)").alias(c) for c in columns])
