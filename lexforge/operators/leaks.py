"""Leak removal: documents that share a long run of words with an evaluation item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.bitmap import bitmap, may_have, without
from lexforge.sources.shared import saved

#: Words of a run that no document has by chance.
RUN = 8


def runs(text: Column, n: int = RUN) -> Column:
    """The text's runs of n words, lower case, letters and digits only, as fingerprints; none if it has fewer words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    none = F.array().cast("array<string>")
    each = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(none)
    return F.get(F.transform(F.array(words), each), F.lit(0))


def leaks(docs: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """docs (seq, text), items (item_id, text) -> (seq, item_id, runs): how many distinct runs of n words a document shares with an item.

    A bitmap of the items' runs, built by aggregation and 64 MB at most, is tested where the documents are read; what it
    lets through, some runs of few documents, is matched exactly by a join. No text is moved. Null texts, and those of fewer
    words, share nothing.
    """
    known = saved(items.select("item_id", F.explode(runs(F.col("text"), n)).alias("run")).distinct())
    pages, size = bitmap(known, F.col("run"), known.count())
    here = docs.select("seq", F.explode(runs(F.col("text"), n)).alias("run"))
    hits = may_have(here, F.col("run"), pages, size).distinct()
    return hits.join(known, "run").groupBy("seq", "item_id").agg(F.count("*").alias("runs"))


def without_leaks(docs: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """The documents that share no run of n words with any item, with all their columns. seq must not repeat.

    Which go is found on runs; the texts themselves meet a broadcast bitmap of their seqs, and only what that
    lets through meets the list.
    """
    bad = saved(leaks(docs, items, n).select(F.col("seq").alias("__seq")).distinct())
    return without(docs, "seq", bad, "__seq")
