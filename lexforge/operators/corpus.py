"""Corpus building: cleaning, filters, exact de-duplication, quotas and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.prefix import with_running_total
from lexforge.sources.shared import saved


def cleaned(docs: DataFrame) -> DataFrame:
    """docs (seq, source, text) with the text cleaned.

    The one-element explode keeps the optimiser from moving later filters below the cleaning, which would then run once
    for every use of the text in them.
    """
    once = F.explode(F.array(T.clean_text(F.col("text")))).alias("text")
    return docs.select(*[c for c in docs.columns if c != "text"], once).select(*docs.columns)


def usable_only(docs: DataFrame, min_chars: int = 200, min_alpha: float = 0.25) -> DataFrame:
    return docs.filter(T.usable(F.col("text"), min_chars, min_alpha))


def with_duplicate_flag(docs: DataFrame, scope: str = "source") -> DataFrame:
    """docs with `duplicate`: an earlier row (by seq) of the same source, or of any, has the same text.

    The first row of each text comes from a partial aggregation and is matched by (text, seq), so copies of one text,
    however many, are spread over all tasks. docs may have the text's fingerprint `fp` instead of it: then no text is moved, and
    docs are saved, so that texts are read, cleaned and counted once, not for either side of the join and each use of the result.
    """
    keys = ["source", "fp"] if scope == "source" else ["fp"]
    marked = saved(docs) if "fp" in docs.columns else docs.withColumn("fp", T.fingerprint(F.col("text")))
    first = marked.groupBy(*keys).agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    out = marked.withColumn("key_source", F.col("source")) if scope == "source" else marked
    if scope == "source":
        first = first.withColumnRenamed("source", "key_source")
        keys = ["key_source", "fp"]
    return out.join(first, [*keys, "seq"], "left").withColumn("duplicate", F.col("first").isNull()).select(*docs.columns, "duplicate")


def without_duplicates(docs: DataFrame, scope: str = "source") -> DataFrame:
    return with_duplicate_flag(docs, scope).filter("NOT duplicate").drop("duplicate")


def first_texts(docs: DataFrame, scope: str = "source") -> DataFrame:
    """docs (seq, source, text) without later copies: what goes is found on fingerprints, and only its few seqs meet the texts,
    in a join that broadcasts them while they are small. seq must not repeat."""
    slim = docs.select("seq", "source", T.fingerprint(F.col("text")).alias("fp"))
    copies = with_duplicate_flag(slim, scope).filter("duplicate").select(F.col("seq").alias("__seq"))
    return docs.join(copies, docs["seq"] == F.col("__seq"), "left_anti")


def scaled_targets(targets: dict[str, int], total: int) -> dict[str, int]:
    """Targets scaled to a new total, rounded down; the first source takes what is left."""
    whole = sum(targets.values())
    out = {k: v * total // whole for k, v in targets.items()}
    first = next(iter(out))
    out[first] += total - sum(out.values())
    return out


def phase_targets(phases: dict[str, tuple[int, dict[str, float]]], scale: float = 1.0) -> dict[str, dict[str, int]]:
    """phase -> (tokens, weights of sources): each phase's tokens times `scale`, dealt by weight, all rounded half to even; the
    first source takes what rounding leaves."""
    out = {}
    for phase, (tokens, weights) in phases.items():
        total = round(tokens * scale)
        own = {k: round(total * w) for k, w in weights.items()}
        own[next(iter(own))] += total - sum(own.values())
        out[phase] = own
    return out


def shares(rows: DataFrame, name: str, weight: str) -> DataFrame:
    """rows (name, weight) -> (name, share): weights below zero count as none, and the others' shares add up to one; all have the
    same if none is above zero."""
    w = F.greatest(F.lit(0.0), F.col(weight).cast("double"))
    total = rows.select(F.sum(w).alias("__all"), F.count("*").alias("__n"))  # one row
    share = F.when(F.col("__all") > 0, F.col("__w") / F.col("__all")).otherwise(F.lit(1.0) / F.col("__n"))
    return rows.withColumn("__w", w).join(F.broadcast(total)).select(name, share.alias("share"))


def targets(weights: DataFrame, phases: dict[str, int], scale: float = 1.0) -> DataFrame:
    """weights (source, share), phase -> tokens: (phase, source, tokens), each phase's tokens times `scale`, dealt by share, all
    rounded half to even; the first source by name takes what rounding leaves."""
    each = weights.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.bround(F.lit(n) * F.lit(scale)).cast("long").alias("total")) for p, n in phases.items()]))).select("source", "share", "p.*")
    own = each.withColumn("tokens", F.bround(F.col("total") * F.col("share")).cast("long"))
    rest = own.groupBy("phase").agg((F.first("total") - F.sum("tokens")).alias("rest"), F.min("source").alias("first"))
    return own.join(F.broadcast(rest), "phase").select("phase", "source", (F.col("tokens") + F.when(F.col("source") == F.col("first"), F.col("rest")).otherwise(0)).alias("tokens"))


def first_of_source(docs: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first n rows (seq, source, ...) of each source, in order of seq, or with a seed in that of a hash of it.

    A partial aggregation keeps n keys of each source and task; the rows are matched with what is left of these.
    """
    key = F.col("seq") if seed is None else F.struct(F.xxhash64("seq", F.lit(seed)).alias("h"), F.col("seq").alias("s"))
    part = F.spark_partition_id().alias("__p")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__k"))
    keys = docs.select("source", "seq", key.alias("__k"), part)
    few = keys.withColumn("__r", rank("source", "__p")).filter(F.col("__r") <= n)  # n of each source and part
    best = few.withColumn("__r", rank("source")).filter(F.col("__r") <= n).select(F.col("source").alias("__s"), F.col("seq").alias("__q"))
    return docs.join(best, docs["source"].eqNullSafe(F.col("__s")) & (docs["seq"] == F.col("__q")), "left_semi")


def quota_fill(docs: DataFrame, target: int | dict[str, int], least: int, span: int = 1 << 20, domain: DataFrame | None = None) -> DataFrame:
    """docs (seq, source, n) -> those that a source's quota takes, with `take`, the tokens of each that are taken.

    In order of seq: whole documents while they fit; the one that does not is cut to the rest, unless the rest is under
    `least`; nothing after it.
    """
    if isinstance(target, dict):
        quota = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])[F.col("source")]
    else:
        quota = F.lit(target)
    run = with_running_total(docs, ["source"], "seq", "n", "before", span, domain)
    rest = quota - F.col("before")
    return run.filter((rest > 0) & ((F.col("n") <= rest) | (rest >= least))).withColumn("take", F.least(F.col("n"), rest)).drop("before")


def char_budget(docs: DataFrame, budget: int, least: int, span: int = 1 << 20, domain: DataFrame | None = None) -> DataFrame:
    """docs (seq, source, n) -> the sample of each source up to a budget of characters; stops when under `least` are left."""
    run = with_running_total(docs, ["source"], "seq", "n", "before", span, domain)
    rest = F.lit(budget) - F.col("before")
    return run.filter((rest > 0) & (rest >= least)).withColumn("take", F.least(F.col("n"), rest)).drop("before")


def truncated(ids, most: int, end: int):
    """At most `most` ids, then the end."""
    return F.concat(F.slice(ids, 1, most), F.array(F.lit(end)))


def labelled(docs: DataFrame, min_chars: int, least: int, most: int, target: int) -> DataFrame:
    """docs (seq, source, text) -> every document with what became of it: its outcome, characters and tokens taken.

    Cleaned; unusable ones are dropped; then outcomes are `duplicate`, `short`, `taken` or `over_quota`.
    """
    base = usable_only(cleaned(docs.select("seq", "source", "text")), min_chars)
    slim = base.select("seq", "source", T.fingerprint(F.col("text")).alias("fp"), F.length("text").cast("long").alias("chars"), T.token_count(F.col("text")).alias("full"))
    sized = with_duplicate_flag(slim).drop("fp").withColumn("n", F.least(F.col("full"), F.lit(most)) + 1)
    sized = sized.withColumn("stage", F.when(F.col("duplicate"), "duplicate").when(F.col("n") < least, "short").otherwise("open"))
    counted = sized.withColumn("counts", F.when(F.col("stage") == "open", F.col("n")).otherwise(0))
    run = with_running_total(counted, ["source"], "seq", "counts", "before", domain=docs.select("seq"))
    rest = F.lit(target) - F.col("before")
    taken = (F.col("stage") == "open") & (rest > 0) & ((F.col("n") <= rest) | (rest >= least))
    return run.select(
        "seq",
        "source",
        "chars",
        "full",
        F.when(F.col("stage") != "open", F.col("stage")).when(taken, "taken").otherwise("over_quota").alias("outcome"),
        F.when(taken, F.least(F.col("n"), rest)).otherwise(0).alias("take"),
    )


def source_stats(rows: DataFrame, most: int) -> DataFrame:
    """What became of each source's documents, from one pass over labelled()."""
    n = lambda c: F.count_if(c)
    taken = F.col("outcome") == "taken"
    return rows.groupBy("source").agg(
        F.count("*").alias("docs_seen"),
        n(taken).alias("docs_written"),
        n(F.col("outcome") == "short").alias("docs_too_short"),
        n(taken & (F.col("full") > most)).alias("docs_too_long"),
        n(F.col("outcome") == "duplicate").alias("docs_duplicate"),
        n(F.col("outcome") == "over_quota").alias("docs_over_quota"),
        F.sum(F.when(taken, F.col("chars")).otherwise(0)).alias("chars_written"),
        F.sum("take").alias("tokens_written"),
    )


def balance(stats: DataFrame, tokens: str = "tokens_written") -> DataFrame:
    """Each source's share of the tokens against an equal share. A row for each source goes in and comes out."""
    every = Window.partitionBy(F.lit(0))
    return stats.select(
        "source",
        F.round(F.try_divide(F.col(tokens), F.sum(tokens).over(every)), 9).alias("share"),
        F.round(F.lit(1.0) / F.count("*").over(every), 9).alias("target_share"),
    )
