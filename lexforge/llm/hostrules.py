"""Quality rules of documents and of their hosts, with failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, mapped, partitions, pieces, shared_dir, utf8
from lexforge.operators.bitmap import bitmap, marked

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
#: Rules whose rates are taken by host. A document fails one at the first threshold; on a host that fails the rule,
#: the second, stricter for the document, is enough to reject it.
RULES = {
    "few_words": ("n_words < 50", "n_words < 60"),
    "repeats": ("100 * n_repeat_words > 50 * n_words", "100 * n_repeat_words > 40 * n_words"),
    "symbols": ("10 * n_symbols > 3 * n_words", "10 * n_symbols > 2 * n_words"),
    "dup_lines": ("n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_words", "n_dup_lines >= 3 AND 10 * n_dup_lines > 2 * n_words"),
    "word_length": ("word_chars > 15 * n_words", "word_chars > 13 * n_words"),
}
#: A host fails a rule if the shrunken share of its documents that fail it is over this.
HOST_RATE = 0.5
#: Failing hosts up to this many are broadcast (a name and a few bits each); of more, a bitmap (64 MB at most) is, and only
#: documents of hosts that it lets through are shuffled.
BROADCAST_HOSTS = 10_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(words: list[bytes], n: int = 3) -> int:
    """Words inside windows of n words that occur twice or more, the first occurrence included."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    code = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        _, code = np.unique(code, return_inverse=True) if len(ids) > 1 << 20 else (None, code)
        code = code * len(ids) + w[k : len(w) - n + 1 + k]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(w), bool)
    for k in range(n):
        cover[k : k + len(code)] |= twice
    return int(cover.sum())


def stats_of(text: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of one text's UTF-8 bytes, in the order of STATS."""
    words = text.split()
    points = len(text.decode("utf-8", "replace")) - sum(map(text.count, (bytes([c]) for c in SPACES)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), points, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), repeated(words)


def with_stats(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns `keep` of docs and the counts of its text, named with the prefix. Null texts have no words."""
    schema = docs.select(*keep).schema
    names = [prefix + x for x in STATS]
    for x in names:
        schema = schema.add(x, "long")
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            counts = np.array([stats_of(x) for x in utf8(b.column(at))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, counts.T.copy())], [*keep, *names])

    return mapped(source, run, schema)


def _expr(rule: str, prefix: str) -> F.Column:
    for x in STATS:
        rule = rule.replace(x, f"`{prefix}{x}`")
    return F.expr(rule)


def beta_prior(n: list[int], k: list[int]) -> tuple[float, float]:
    """Method of moments: the spread of the hosts' rates beyond what their sizes explain fixes the prior's weight."""
    return prior_of(len(n), sum(n), sum(k), sum(b * b / a for a, b in zip(n, k)))


def prior_of(hosts: int, n: float, k: float, squares: float) -> tuple[float, float]:
    """hosts, documents, failures, and the sum over hosts of failures squared over documents."""
    mean = k / n
    if not 0 < mean < 1 or hosts < 2:
        return 0.5 + mean, 1.5 - mean
    seen = squares / n - mean * mean
    noise = mean * (1 - mean) * hosts / n
    spread = max(seen - noise, 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def host_verdicts(counted: DataFrame, host: str = "source", prefix: str = "") -> DataFrame:
    """counted (host, counts) -> (host, failing array<boolean>): for each rule whether the host fails it.

    One partial aggregation by host, then one row of sums to the driver for the priors.
    """
    few = max(1, partitions(counted.sparkSession) // 8)  # a row for each host is little
    hosts = cut(counted.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), *[F.sum(_expr(hard, prefix).cast("long")).alias(r) for r, (hard, _) in RULES.items()]).coalesce(few))
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[x for r in RULES for x in (F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq"))]).first()
    if not sums["n"]:
        return hosts.select("__host", F.array(*[F.lit(False)] * len(RULES)).alias("__failing"))
    priors = {r: prior_of(sums["hosts"], sums["n"], sums[r], sums[f"{r}_sq"]) for r in RULES}
    return hosts.select("__host", F.array(*[(F.col(r) + a) / (F.col("n") + a + b) > HOST_RATE for r, (a, b) in priors.items()]).alias("__failing"))


def judged(counted: DataFrame, verdicts: DataFrame, host: str = "source", prefix: str = "") -> DataFrame:
    """counted with base_failed and kept: hosts' verdicts joined back. A document of a failing host goes only if it shows
    signs of the same failure itself. A null host is a host of its own."""
    bad = verdicts.filter(F.exists("__failing", lambda x: x))
    n = bad.count()
    hard = [_expr(RULES[r][0], prefix) for r in ("few_words", "repeats")]
    soft = [F.col("__failing")[k] & _expr(soft, prefix) for k, (_, soft) in enumerate(RULES.values())]
    guilty = soft[0]
    for x in soft[1:]:
        guilty = guilty | x
    if n <= BROADCAST_HOSTS:
        joined = counted.join(F.broadcast(bad), counted[host].eqNullSafe(bad["__host"]), "left")
    else:
        key = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))  # a null host has a key, too
        pages, size = bitmap(bad, F.coalesce(F.concat(F.lit("="), F.col("__host")), F.lit("")), n)
        each = marked(counted, key, pages, size)
        hit = each.filter("__hit").drop("__hit").join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
        joined = each.filter("NOT __hit").drop("__hit").unionByName(hit, allowMissingColumns=True)
    return (
        joined.withColumn("base_failed", hard[0] | hard[1])
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(guilty, F.lit(False)))
        .drop("__host", "__failing")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) -> (doc_id, the five counts, base_failed, kept), a row for each row.

    Words are runs without ASCII white space. A null or empty text has no words and fails; repeated rows are judged
    each; a document without a source belongs to the host null; an empty table gives no rows.
    """
    counted = cut(with_stats(docs.select(F.col("doc_id").cast("long"), "source", "text"), ["doc_id", "source"]))
    return judged(counted, host_verdicts(counted)).select("doc_id", *STATS, "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of docs. Null and empty texts have no words and go; repeated rows are judged each; a
    null source is a host; an empty table gives no rows.

    Texts are counted once and never shuffled: the documents lie beside their counts, as Parquet in the shared folder, until the
    hosts' verdicts, made of the counts' columns alone, are there.
    """
    p = "__rule_"
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/counted-{uuid.uuid4().hex}"
    with_stats(docs, docs.columns, p).write.parquet(folder)
    counted = docs.sparkSession.read.parquet(folder)
    own = {x: f"__own_{x}" for x in ("base_failed", "kept") if x in docs.columns}
    out = judged(counted.withColumnsRenamed(own), host_verdicts(counted, prefix=p), prefix=p).filter("kept").drop("base_failed", "kept")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
