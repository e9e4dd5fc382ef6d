"""Bitmaps of keys: a filter of bounded size that spares rows without a match the way through a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap at least and at most (64 MB), and for each key. Beyond, more rows without a match get through, none is lost.
FEWEST, MOST, EACH = 1 << 20, 1 << 29, 16
#: Bits that Spark's bitmap functions keep in one value.
PAGE = 1 << 15


def bitmap(keys: DataFrame, key: Column, rows: int) -> tuple[DataFrame, int]:
    """(page, bits) of the keys' hashes, and the number of bits: pages of 4 KB, 64 MB together at most. rows: about how many keys."""
    size = min(max(FEWEST, 1 << max(0, EACH * rows - 1).bit_length()), MOST)
    at = keys.select(F.pmod(F.xxhash64(key), F.lit(size)).alias("at")).distinct()
    pages = at.groupBy(F.floor(F.col("at") / PAGE).cast("int").alias("__page")).agg(F.bitmap_construct_agg((F.col("at") % PAGE)).alias("__bits"))
    return pages, size


def marked(rows: DataFrame, key: Column, pages: DataFrame, size: int) -> DataFrame:
    """rows with `__hit`: whether the key may be one of the bitmap's. All that are hit, few others do; rows stay in their tasks."""
    out = rows.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(size)))
    out = out.join(F.broadcast(pages), F.floor(F.col("__at") / PAGE).cast("int") == F.col("__page"), "left")
    byte = F.conv(F.hex(F.substring("__bits", ((F.col("__at") % PAGE) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn("__hit", hit).drop("__at", "__page", "__bits")


def may_have(rows: DataFrame, key: Column, pages: DataFrame, size: int) -> DataFrame:
    """The rows that are hit."""
    return marked(rows, key, pages, size).filter("__hit").drop("__hit")


def without(rows: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """rows without those whose key is in `gone` (one column, `name`), a saved list of any length: rows that its bitmap rules out
    stay where they are, and only the others go through the join. Nulls in either are left alone."""
    pages, size = bitmap(gone, F.col(name), gone.count())
    each = marked(rows, F.col(key), pages, size)
    clear, hit = (each.filter(x).drop("__hit") for x in ("NOT __hit", "__hit"))
    return clear.unionByName(hit.join(gone, F.col(key) == F.col(name), "left_anti"))
