"""Tokenizer quality: per-document ratios, per-source and global statistics, coverage and piece lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.quantiles import quantiles

#: Piece lengths from here on share a bin; ranks at which coverage is read.
LONGEST, RANKS = 16, (1_000, 4_000, 8_000, 16_000, 32_000, 48_000, 64_000)


def sizes(docs: DataFrame) -> DataFrame:
    """docs (source, seq, text, pieces array<string>) -> the counts of each document that metrics are made of."""
    n = F.size("pieces").cast("long")
    single = F.size(F.filter("pieces", lambda p: F.length(p) <= 1)).cast("long")
    unknown = F.size(F.filter("pieces", lambda p: p == "<unk>")).cast("long")
    return docs.withColumns({"tokens": n, "singles": single, "unks": unknown, "chars": F.length("text").cast("long"), "bytes": F.octet_length("text").cast("long")}).drop("text", "pieces")


def doc_metrics(docs: DataFrame) -> DataFrame:
    """sizes() of documents -> ratios of each document that has tokens."""
    return docs.filter("tokens > 0").select(
        "source",
        "seq",
        "chars",
        "bytes",
        "tokens",
        (F.col("chars") / F.col("tokens")).alias("chars_per_token"),
        (F.col("bytes") / F.col("tokens")).alias("bytes_per_token"),
        (F.col("tokens") * 1000.0 / F.col("chars")).alias("tokens_per_1k_chars"),
        (F.col("unks") / F.col("tokens")).alias("unk_rate"),
        (F.col("singles") / F.col("tokens")).alias("single_piece_rate"),
    )


def frequencies(docs: DataFrame, by: list[str]) -> DataFrame:
    """docs (..., pieces) -> (by..., piece, n): occurrences, summed before the shuffle."""
    return docs.select(*by, F.explode("pieces").alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("n"))


def source_metrics(metrics: DataFrame, counts: DataFrame, vocabulary: int) -> DataFrame:
    """Per source: sums, distinct pieces, share of the vocabulary, spread of chars per token, pooled rates.

    The rate columns are means over tokens, tokens_per_1k_chars one over documents. metrics are read several times: for the
    exact quantiles, which no task needs a source's rows for, too.
    """
    spread = F.col("chars_per_token")
    marks = {"median_chars_per_token": 0.5, "p10_chars_per_token": 0.1, "p90_chars_per_token": 0.9}
    quantile = quantiles(metrics, "source", "chars_per_token", marks).withColumnRenamed("source", "__source")
    stats = metrics.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum("chars").alias("chars"),
        F.sum("bytes").alias("bytes"),
        F.sum("tokens").alias("tokens"),
        F.avg(spread).alias("mean_chars_per_token"),
        F.avg("tokens_per_1k_chars").alias("mean_tokens_per_1k_chars"),
        (F.sum(F.col("unk_rate") * F.col("tokens")) / F.sum("tokens")).alias("unk_rate"),
        (F.sum(F.col("single_piece_rate") * F.col("tokens")) / F.sum("tokens")).alias("single_piece_rate"),
    )
    distinct = counts.groupBy("source").agg(F.count("*").alias("unique_pieces"))
    stats = stats.join(quantile, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return stats.join(distinct, "source").withColumn("vocab_utilisation", F.col("unique_pieces") * 100.0 / vocabulary)


def global_rates(metrics: DataFrame) -> DataFrame:
    """One row over all documents, ratios pooled."""
    t = F.sum("tokens")
    return metrics.agg(
        F.count("*").alias("docs"),
        F.sum("chars").alias("chars"),
        t.alias("tokens"),
        (F.sum("chars") / t).alias("chars_per_token"),
        (F.sum(F.col("unk_rate") * F.col("tokens")) / t).alias("unk_rate"),
        (F.sum(F.col("single_piece_rate") * F.col("tokens")) / t).alias("single_piece_rate"),
    )


def coverage(counts: DataFrame, ranks: tuple[int, ...] = RANKS) -> DataFrame:
    """counts (piece, n) -> (k, coverage): share of all tokens that the k most frequent pieces make up.

    Pieces of equal count are interchangeable in these sums, so it is enough to rank the distinct counts: a row for each.
    """
    levels = counts.groupBy("n").agg(F.count("*").alias("pieces"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each count
    ranked = levels.withColumn("upto", F.sum("pieces").over(down)).withColumn("mass", F.sum(F.col("pieces") * F.col("n")).over(down))
    at = F.explode(F.array(*[F.lit(k) for k in ranks])).alias("k")
    each = ranked.select("n", "pieces", "upto", "mass", at)
    # of the level that k falls into, the pieces up to k; of those before it, all
    before = F.col("upto") - F.col("pieces")
    part = F.greatest(F.lit(0), F.least(F.col("pieces"), F.col("k") - before)) * F.col("n")
    return each.groupBy("k").agg((F.sum(part) / F.max("mass")).alias("coverage"))


def piece_lengths(counts: DataFrame) -> DataFrame:
    """counts (piece, n) -> (piece_len, n), lengths over LONGEST together."""
    return counts.groupBy(F.least(F.length("piece"), F.lit(LONGEST)).alias("piece_len")).agg(F.sum("n").alias("n"))


def bpe_word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> (word, n): counts of the words that byte-pair merges work on, a leading space belonging to the word."""
    words = F.regexp_extract_all("text", F.lit(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bpe_merges(counts: DataFrame, merges: int, least: int = 2, words: int = 500_000) -> list[tuple[str, str, int]]:
    """counts (word, n) -> the first merges of byte-level pair encoding, as (left, right, occurrences): the most frequent pair of
    neighbours is joined again and again, of equal ones the first in order, while it occurs `least` times.

    Merges follow each other, so they are learned on the driver, on the `words` most frequent words (a documented bound, as
    in the tokenizer's own training); counting them is the distributed part. Pairs are kept by the words they occur in,
    so a merge costs what it changes.
    """
    import heapq
    from collections import defaultdict

    rows = counts.filter(F.col("n") >= 1).orderBy(F.desc("n"), "word").limit(words).collect()
    spelled = [[bytes([b]).decode("latin1") for b in r["word"].encode()] for r in rows]
    times = [r["n"] for r in rows]
    total: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, w in enumerate(spelled):
        for pair in zip(w, w[1:]):
            total[pair] += times[k]
            where[pair].add(k)
    heap = [(-n, p) for p, n in total.items()]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while heap and len(out) < merges:
        n, pair = heapq.heappop(heap)
        if -n != total.get(pair, 0):
            continue  # of an earlier count
        if -n < least:
            break
        out.append((*pair, -n))
        changed = set()
        for k in where.pop(pair):
            w, new, i = spelled[k], [], 0
            for p in zip(w, w[1:]):
                total[p] -= times[k]
                changed.add(p)
            while i < len(w):
                joined = i + 1 < len(w) and (w[i], w[i + 1]) == pair
                new.append(w[i] + w[i + 1] if joined else w[i])
                i += 1 + joined
            spelled[k] = new
            for p in zip(new, new[1:]):
                total[p] += times[k]
                where[p].add(k)
                changed.add(p)
        total.pop(pair, None)
        for p in changed:
            if total.get(p):
                heapq.heappush(heap, (-total[p], p))
    return out
