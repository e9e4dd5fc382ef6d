"""Token shards: cuts of one stream, their manifest, documents read back, and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.prefix import with_running_total


def window_count(n, length: int, stride: int):
    """Windows of `length` inputs and the token after: ((n - length - 1) div stride) + 1, or none."""
    return F.when(n > length, F.floor((n - length - 1) / stride) + 1).otherwise(0).cast("int")


#: Documents of a stretch whose ids go through a task together.
WIDE_SPAN = 1 << 12


def cut(docs: DataFrame, shard_tokens: int, span: int = WIDE_SPAN, domain: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """docs (seq, ids, ...) -> pieces (shard_idx, shard_start, doc_start, piece, ...): the stream of all documents in order of
    seq, cut every shard_tokens; documents may go over a cut. With keys (a phase, say), a stream for each value of them. Rows
    with ids are wide, so a stretch of them is shorter than one of counts."""
    sized = with_running_total(docs.withColumn("n", F.size("ids").cast("long")), list(keys), "seq", "n", "at", span, domain)
    first, last = F.floor(F.col("at") / shard_tokens), F.floor((F.col("at") + F.col("n") - 1) / shard_tokens)
    cuts = sized.filter("n > 0").withColumn("shard_idx", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("shard_idx") * shard_tokens)
    high = F.least(F.col("at") + F.col("n"), (F.col("shard_idx") + 1) * shard_tokens)
    return (
        cuts.withColumn("shard_start", low - F.col("shard_idx") * shard_tokens)
        .withColumn("doc_start", low - F.col("at"))
        .withColumn("piece", F.slice("ids", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")))
        .drop("ids", "n", "at")
    )


def payloads(pieces: DataFrame) -> DataFrame:
    """pieces -> (shard_idx, ids): each shard's tokens in order; a shard is at most shard_tokens long."""
    rows = F.array_sort(F.collect_list(F.struct("shard_start", "piece")))
    return pieces.groupBy("shard_idx").agg(F.flatten(F.transform(rows, lambda r: r["piece"])).alias("ids"))


def manifest(pieces: DataFrame) -> DataFrame:
    """pieces with source -> (shard_idx, source, tokens)."""
    return pieces.groupBy("shard_idx", "source").agg(F.sum(F.size("piece")).cast("long").alias("tokens"))


def majority(rows: DataFrame, least: float = 0.999) -> DataFrame:
    """manifest rows -> (shard_idx, top_source, top_tokens, total, kept): kept if the largest source has `least` of it."""
    top = rows.groupBy("shard_idx").agg(
        F.max_by("source", F.struct("tokens", F.col("source"))).alias("top_source"), F.max("tokens").alias("top_tokens"), F.sum("tokens").alias("total")
    )
    return top.withColumn("kept", F.col("top_tokens") / F.col("total") >= least)


def documents(shards: DataFrame, end: int) -> DataFrame:
    """shards (shard_idx, ids) -> (doc, ids): the stream split after each end token, across shard boundaries.

    Each shard is split on its own; a running count of ends over shards numbers the documents, and only those at a
    boundary consist of more than one fragment. Tokens after the last end are a document too.
    """
    ends = F.filter(F.transform("ids", lambda x, i: F.when(x == end, i + 1)), lambda x: x.isNotNull())
    per = shards.withColumn("ends", ends)
    before = Window.orderBy("shard_idx").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    numbers = per.select("shard_idx", F.size("ends").alias("k")).withColumn("doc", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    stops = F.when(F.get(F.col("ends"), F.size("ends") - 1) == F.size("ids"), F.col("ends")).otherwise(F.concat("ends", F.array(F.size("ids"))))
    fragments = (
        per.join(numbers, "shard_idx")
        .withColumn("stops", stops)
        .select("shard_idx", "doc", "ids", "stops", F.posexplode("stops").alias("k", "stop"))
        .withColumn("start", F.when(F.col("k") == 0, 0).otherwise(F.get("stops", F.col("k") - 1)))
        .select((F.col("doc") + F.col("k")).alias("doc"), "shard_idx", F.expr("slice(ids, start + 1, stop - start)").alias("part"))
    )
    whole = F.array_sort(F.collect_list(F.struct("shard_idx", "part")))
    return fragments.groupBy("doc").agg(F.flatten(F.transform(whole, lambda r: r["part"])).alias("ids"))


def windows(rows: DataFrame, length: int, stride: int) -> DataFrame:
    """rows (..., ids) -> a row for each window: w, x and y, y being x one token later. None crosses a row's end."""
    n = window_count(F.size("ids"), length, stride)
    each = rows.withColumn("n", n).filter("n > 0").withColumn("w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("w") * stride
    return each.withColumn("x", F.slice("ids", at + 1, length)).withColumn("y", F.slice("ids", at + 2, length)).drop("ids", "n")


def blocks(placed: DataFrame, docs: DataFrame, size: int, end: int) -> DataFrame:
    """placed (source, seq, block, start), docs (seq, ids) -> (source, block, ids): blocks of `size` tokens, filled up with ends."""
    rows = F.array_sort(F.collect_list(F.struct("start", "ids")))
    whole = placed.join(docs.select("seq", "ids"), "seq").groupBy("source", "block").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(end), F.lit(size) - F.size("ids"))))
