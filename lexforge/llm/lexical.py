"""Ranked lexical search: the exact best documents of each query, by variable-block-max indexes of bounded shards."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut, mapped, pieces, utf8

#: Documents returned for each query.
TOP = 20
#: A shard is closed at this many documents or postings (a document more, at most).
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
#: Distinct terms and query rows that are searched together; more queries are further blocks.
TERMS_HELD, ROWS_HELD = 200_000, 20_000
#: Postings in a block at most, and what a block costs beside its bound's error, in mean scores of its list.
WINDOW, BLOCK_COST = 64, 8.0
#: Documents scored first, those of the highest bounds; what they leave is scored where its bound reaches the least of the best.
FIRST = 256

#: Bytes of terms, A-Z lower-cased; all others are spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of UTF-8 bytes, in lists of about `step` bytes."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + step)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(text: bytes) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for part in terms_of(text):
        out.update(part)
    return out


@dataclass(frozen=True)
class Queries:
    """A block of queries: the place of each term, and for each query its terms' places and how often it has them."""

    terms: dict[bytes, int]
    items: list[tuple[int | None, np.ndarray, np.ndarray]]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """Queries in blocks of bounded size, in the order of item_id; rows that share an item_id are one query."""
    rows = items.select(F.col("item_id").cast("long"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).orderBy("item_id")
    terms: dict[bytes, int] = {}
    now: list[tuple[int | None, Counter[bytes]]] = []

    def block() -> Queries:
        return Queries(dict(terms), [(i, np.array([terms[w] for w in c], np.int64), np.array(list(c.values()), np.int64)) for i, c in now])

    for n, (item, text) in enumerate(rows.toLocalIterator()):
        if not now or now[-1][0] != item:
            if len(terms) > TERMS_HELD or len(now) >= ROWS_HELD:
                yield block()
                terms, now = {}, []
            now.append((item, Counter()))
        now[-1][1].update(counted(bytes(text)))
        for w in now[-1][1]:
            terms.setdefault(w, len(terms))
    if now:
        yield block()


SHARD = "terms array<long>, dfs array<long>, ids array<long>, sizes binary, docs binary, tfs binary"


def shards(docs: DataFrame, queries) -> DataFrame:
    """docs (doc_id, text) -> a row for each shard: its postings of the queries' terms, ordered by term and place.

    terms and dfs also carry the shard's documents with a term (-1) and all their terms (-2).
    """
    names = [x.split(" ")[0] for x in SHARD.split(", ")]
    kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, n_terms = queries.value.terms, 0, 0
        ids, sizes, term, doc, tf = [], [], [], [], []

        def shard() -> pa.RecordBatch:
            t = np.array(term, np.int64)
            order = np.argsort(t, kind="stable")
            each, dfs = np.unique(t, return_counts=True)
            row = [[*each.tolist(), -1, -2], [*dfs.tolist(), n_docs, n_terms], list(ids), np.array(sizes, np.int64).tobytes(), np.array(doc, np.int32)[order].tobytes(), np.array(tf, np.int64)[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for b in pieces(batches, "text", 2 << 20):
            for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                counts = counted(text)
                if not counts:
                    continue
                n, hits = counts.total(), counts.keys() & known.keys()
                n_docs, n_terms = n_docs + 1, n_terms + n
                if not hits:
                    continue
                term += [known[w] for w in hits]
                tf += [counts[w] for w in hits]
                doc += [len(ids)] * len(hits)
                ids.append(i)
                sizes.append(n)
                if len(ids) >= SHARD_DOCS or len(term) >= SHARD_POSTINGS:
                    yield shard()
                    n_docs = n_terms = 0
                    ids, sizes, term, doc, tf = [], [], [], [], []
        if n_docs:
            yield shard()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, SHARD)


def cuts(first: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Where blocks begin in posting lists that lie end to end in `scores`, list k from first[k] to first[k + 1].

    Of all partitions into blocks of WINDOW postings at most, the one of each list that makes the least of the sum of
    (block's maximum - score) over postings plus BLOCK_COST mean scores for each block. All lists take the dynamic
    programme's steps together, the longest first, so that those still running are the first rows of the tables.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[:-1][order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), "left")  # lists of more than i postings
    fixed = BLOCK_COST * np.array([scores[a : a + n].mean() for a, n in zip(start, size)])
    base, top = np.full((len(size), WINDOW), np.inf), np.zeros((len(size), WINDOW))
    cost, taken, slots = np.zeros(len(size)), np.zeros(len(scores), np.int32), np.arange(WINDOW)
    for i in range(longest):
        t, slot = int(running[i]), i % WINDOW
        at = start[:t] + i
        base[:t, slot], top[:t, slot] = cost[:t], 0
        np.maximum(top[:t], scores[at][:, None], out=top[:t])
        length = (i - slots) % WINDOW + 1  # of a block that began in each slot and ends here
        sums = top[:t] * length
        sums += base[:t]
        best = sums.argmin(1)
        cost[:t] = sums[np.arange(t), best] + fixed[:t]
        taken[at] = length[best]
    begins, left = np.zeros(len(scores), bool), size.copy()
    while (live := left > 0).any():
        left[live] -= taken[start[live] + left[live] - 1]
        begins[start[live] + left[live]] = True
    return np.flatnonzero(begins)


@dataclass(frozen=True)
class Index:
    """A shard's postings with scores, and their blocks: where each begins, its first and last document and its bound."""

    ids: list
    terms: np.ndarray
    first_block: np.ndarray
    docs: np.ndarray
    scores: np.ndarray
    begins: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray


def index_of(row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> Index | None:
    """The index of one row of shards(); the terms' weights and the corpus's counts fix the scores."""
    terms, dfs = np.array(row["terms"][:-2], np.int64), np.array(row["dfs"][:-2], np.int64)
    if not len(terms):
        return None
    sizes, docs, tf = (np.frombuffer(row[k], t) for k, t in (("sizes", np.int64), ("docs", np.int32), ("tfs", np.int64)))
    each, which = np.unique(sizes, return_inverse=True)
    m = np.array([75 + 25 * n * n_docs // n_terms for n in each.tolist()], np.int64)[which]
    scores = np.repeat(weights[terms], dfs) * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
    first = np.concatenate([[0], np.cumsum(dfs)])
    begins = cuts(first, scores)
    ends = np.concatenate([begins[1:], [len(docs)]])
    return Index(row["ids"], terms, np.searchsorted(begins, first), docs, scores, np.append(begins, len(docs)), docs[begins], docs[ends - 1], np.maximum.reduceat(scores, begins))


def best(index: Index, terms: np.ndarray, times: np.ndarray, top: int = TOP, seen: Counter | None = None) -> list[tuple[int, int]]:
    """(place, score) of the shard's documents that can be among the best `top`: all whose score is over 0 and at least
    that of the top-th.

    A document's bound is the sum of the bounds of the blocks that reach over it. Documents of the highest bounds are scored
    first; of the others only those whose bound reaches the least score of the best so far, and of their terms only
    the blocks that hold them. seen counts postings read and passed over.
    """
    at = np.searchsorted(index.terms, terms)
    here = (at < len(index.terms)) & (index.terms[np.minimum(at, len(index.terms) - 1)] == terms)
    at, times = at[here], times[here]
    a, z = index.first_block[at], index.first_block[at + 1]
    blocks, of = spans(a, z), np.repeat(times, z - a)
    if not len(blocks):
        return []
    low, high, n = index.low[blocks], index.high[blocks], len(index.ids)
    bound, step = np.zeros(n + 1, np.int64), index.bound[blocks] * of
    np.add.at(bound, low, step)
    np.subtract.at(bound, high + 1, step)
    bound = np.cumsum(bound)[:n]
    scores, least = np.zeros(n, np.int64), 1
    done = np.zeros(n, bool)
    chosen = np.argpartition(-bound, FIRST)[:FIRST] if n > FIRST else np.arange(n)
    while len(chosen):
        wanted = np.zeros(n, bool)
        wanted[chosen] = True
        before = np.concatenate([[0], np.cumsum(wanted)])
        need = before[high + 1] > before[low]
        p, q = index.begins[blocks[need]], index.begins[blocks[need] + 1]
        read = spans(p, q)
        factor, docs = np.repeat(of[need], q - p), index.docs[read]
        np.add.at(scores, docs, np.where(wanted[docs], index.scores[read] * factor, 0))
        if seen is not None:
            seen["read"] += len(read)
            seen["postings"] += int((index.begins[blocks[~need] + 1] - index.begins[blocks[~need]]).sum()) + len(read)
        done |= wanted
        if np.count_nonzero(scores) >= top:
            least = max(1, int(np.partition(scores, n - top)[n - top]))
        rest = np.flatnonzero(~done & (bound >= least))
        chosen = rest if len(rest) <= 16 * FIRST else rest[np.argpartition(-bound[rest], 16 * FIRST)[: 16 * FIRST]]
    found = np.flatnonzero(scores >= least)
    return list(zip(found.tolist(), scores[found].tolist()))


def spans(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The numbers from each a to its z, z excluded, end to end."""
    n = z - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(a) else np.zeros(0, np.int64)


def searched(shard_rows: DataFrame, queries, statistics, top: int) -> DataFrame:
    """shards -> (item_id, doc_id, score): of each shard and query, the best `top` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n_docs, n_terms = statistics.value
        for b in batches:
            for k in range(b.num_rows):
                index = index_of({x: b.column(j)[k].as_py() for j, x in enumerate(b.schema.names)}, weights, n_docs, n_terms)
                rows = []
                for item, terms, times in queries.value.items if index else ():
                    found = [(-score, index.ids[d] is None, index.ids[d] or 0, index.ids[d]) for d, score in best(index, terms, times, top)]
                    rows += [(item, d, -s) for s, _, _, d in sorted(found, key=lambda x: x[:3])[:top]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return mapped(shard_rows, run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> (item_id, rank, doc_id, score): for each item the `top` documents of
    the highest scores over 0, equal scores by ascending doc_id.

    Terms are runs of letters and digits, bytes of other scripts among them, A-Z lower-cased. Each task turns its documents
    into shards of bounded size, in memory a few MB each; documents, terms and document frequencies are summed over all shards
    before any is searched, so scores are those of the whole table. A shard gives its best for every item, and the
    best of those are the answer. A row is a document: rows that repeat are ranked each, a null doc_id after others of its score.
    Null and empty texts have no terms: such a document is never found and not counted, such an item finds nothing. Rows
    that share an item_id (or have none) are one item with the terms of all. Empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    for block in query_blocks(items):
        queries = spark.sparkContext.broadcast(block)
        made = cut(shards(docs, queries))
        counts = made.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs"))
        df = dict(counts.collect())  # a row for each of the block's terms at most
        n, total = df.pop(-1, 0), df.pop(-2, 0)
        weights = np.zeros(len(block.terms), np.int64)
        for t, held in df.items():
            weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))
        found = searched(made, queries, spark.sparkContext.broadcast((weights, n, total)), top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
