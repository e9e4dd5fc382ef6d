"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import mapped, pieces, utf8
from lexforge.llm.licenses import WORDS

#: Least similarity: 1 - (edits in words) / (the item's words).
SIMILARITY = 0.8
#: Sampled symbols for a key; keys for each walk; most walks; share of worst-case windows to be found.
SAMPLED, KEYS, WALKS, RECALL = 3, 12, 16, 0.999
#: Items, and words of them, that one index holds; more items take more indexes, which a task asks one after another in the
#: same pass over the documents. An item has KEYS entries of 12 bytes for each walk and its words, so an index has at
#: most BLOCK * KEYS * WALKS * 12 + WORDS_HELD * 120 bytes, some 60 MB; with two or three walks, as is usual, 15 MB.
BLOCK, WORDS_HELD = 16_384, 262_144
#: Items of one length up to this many are compared with a stretch's words one by one before any walk.
FEW = 16


def words_of(text: bytes) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return text.decode("utf-8", "replace").lower().encode().translate(WORDS).split()


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


class Walk:
    """One CGK embedding: at each step it writes the symbol under the pointer and moves on by a random bit of it.

    The bits are those of a hash of walk, step and symbol, so a walk holds no table over symbols.
    """

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed * 1_000_003 + size)
        self.steps = 3 * size
        self.salt = rng.integers(1, 1 << 62, self.steps, dtype=np.int64) | 1
        self.picked = rng.integers(0, self.steps, (KEYS, SAMPLED))
        self.mix = rng.integers(1, 1 << 62, SAMPLED, dtype=np.int64) | 1

    def moves(self, t: int, symbol: np.ndarray) -> np.ndarray:
        """A bit for each symbol at step t."""
        with np.errstate(over="ignore"):
            h = (symbol.astype(np.int64) + 3) * self.salt[t]
            return ((h ^ (h >> 32)) * np.int64(0x1B873593A7F4C15) >> 61) & 1

    def embed(self, x: np.ndarray) -> np.ndarray:
        """x: (rows, size) of symbols 0.. -> (rows, steps); past the end the symbol is -1."""
        rows, size = x.shape
        padded = np.concatenate((x, np.full((rows, 1), -1, x.dtype)), axis=1)
        out, at, row = np.empty((rows, self.steps), np.int32), np.zeros(rows, np.int64), np.arange(rows)
        for t in range(self.steps):
            now = padded[row, at]
            out[:, t] = now
            at = np.minimum(at + self.moves(t, now), size)
        return out

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, KEYS): hashes of the sampled symbols."""
        sampled = self.embed(x)[:, self.picked].astype(np.int64) + 7
        with np.errstate(over="ignore"):
            h = (sampled * self.mix).cumsum(axis=2)[:, :, -1]
            return (h ^ (h >> 29)) * np.int64(0x1B873593A7F4C15) + np.arange(KEYS)


def edited(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """x after k random edits, cut or filled with unknown words (0) to its old length."""
    out = x.tolist()
    for _ in range(k):
        at, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        if kind == 0:
            out[at] = 0
        elif kind == 1:
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return np.array((out + [0] * len(x))[: len(x)], x.dtype)


@dataclass
class Group:
    """The items of one length, and the walks that find their windows."""

    size: int
    edits: int
    items: np.ndarray  # (items, size)
    ids: np.ndarray
    walks: list[Walk]  # none: all items are compared with each possible stretch
    table: list[list[tuple[np.ndarray, np.ndarray]]]  # by walk and key: sorted hashes, items
    any: np.ndarray  # (symbols): whether any of the items has it
    different: int  # fewest different words of an item
    mix: np.ndarray  # weights of a stretch's hash, by which equal stretches are looked at once


def group_of(size: int, items: np.ndarray, ids: np.ndarray, symbols: int) -> Group:
    """Walks are added until RECALL of windows with the most edits allowed would be found, going by trials on the items.

    If WALKS of them do not suffice, there are none and every item is compared exactly.
    """
    k, rng = edits_allowed(size), np.random.default_rng(size)
    trials = 400
    which = rng.integers(0, len(items), trials)
    windows = np.stack([edited(items[i], k, rng) for i in which])
    found, walks, table = np.zeros(trials, bool), [], []
    for seed in range(WALKS):
        walk = Walk(seed, size)
        keys = walk.keys(items)
        walks.append(walk)
        order = np.argsort(keys, axis=0, kind="stable").astype(np.int32)
        table.append([(keys[order[:, j], j], order[:, j]) for j in range(KEYS)])
        found |= (walk.keys(windows) == keys[which]).any(axis=1)
        if found.mean() >= RECALL:
            break
    else:
        walks, table = [], []
    any_ = np.zeros(symbols, bool)
    any_[items] = True
    different = min(len(np.unique(x)) for x in items)
    return Group(size, k, items, ids, walks, table, any_, different, rng.integers(1, 1 << 62, size + k, dtype=np.int64) | 1)


def shared(rooms: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Of each row of rooms, how many of its words the same row of items has."""
    out = np.zeros(len(rooms), np.int64)
    for j in range(rooms.shape[1]):
        out += (items == rooms[:, j : j + 1]).any(axis=1)
    return out


def distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """(rows, size) against (rows, length): the fewest edits between each item and any stretch of its text."""
    rows, size = items.shape
    column = np.broadcast_to(np.arange(size + 1), (rows, size + 1)).copy()
    best, step = column[:, -1].copy(), np.arange(size + 1)
    for j in range(texts.shape[1]):
        up = np.empty_like(column)
        up[:, 0] = 0
        up[:, 1:] = np.minimum(column[:, :-1] + (items != texts[:, j : j + 1]), column[:, 1:] + 1)
        column = np.minimum.accumulate(up - step, axis=1) + step
        best = np.minimum(best, column[:, -1])
    return best


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    groups: list[Group]


def index_of(items: list[tuple[int, bytes]]) -> Index:
    vocabulary: dict[bytes, int] = {}
    by: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for item, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if words:
            by[len(words)].append((item, words))
    symbols = len(vocabulary) + 1
    return Index(vocabulary, [group_of(n, np.array([w for _, w in x], np.int32), np.array([i for i, _ in x]), symbols) for n, x in sorted(by.items())])


def possible(g: Group, views: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the stretch from at[k] on has as many words of some one item, and as many different ones, as a match needs.

    With more than FEW items the first is left to the walks, whose cost does not grow with the items.
    """
    out = np.zeros(len(at), bool)
    for a in range(0, len(at), 20_000):
        room = views[at[a : a + 20_000]]
        one = np.zeros(len(room), bool)
        if len(g.items) > FEW:
            one[:] = True
        else:
            has = np.zeros(len(g.any), bool)
            for item in g.items:
                has[item] = True
                one |= has[room[:, : g.size]].sum(axis=1) >= g.size - g.edits
                has[item] = False
        room = np.sort(room[one], axis=1)
        one[one] = (room[:, 1:] != room[:, :-1]).sum(axis=1) + 1 >= g.different - g.edits
        out[a : a + 20_000] = one
    return out


def verified(g: Group, views: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row of at, item, edits) of the stretches from at[row] on that share a key with an item and are close enough."""
    for a in range(0, len(at), 20_000):
        windows = views[at[a : a + 20_000]][:, : g.size]
        pairs = []
        for walk, tables in zip(g.walks, g.table):
            keys = walk.keys(windows)
            for j, (hashes, items) in enumerate(tables):
                low, high = np.searchsorted(hashes, keys[:, j], "left"), np.searchsorted(hashes, keys[:, j], "right")
                n = high - low
                row = np.repeat(np.arange(len(windows)), n)
                pairs.append(row * len(g.ids) + items[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        pairs = np.unique(np.concatenate(pairs)) if g.walks else range(len(windows) * len(g.ids))
        for c in range(0, len(pairs), 4096):
            row, item = np.divmod(np.asarray(pairs[c : c + 4096]), len(g.ids))
            room = views[at[a + row]]
            near = shared(room, g.items[item]) >= g.size - g.edits
            row, item, room = row[near], item[near], room[near]
            held = np.zeros(len(row), np.int64)  # of the item's words, how many the stretch has at all
            for k in range(g.size):
                held += (room == g.items[item, k][:, None]).any(axis=1)
            near = held >= g.size - g.edits
            row, item, room = row[near], item[near], room[near]
            d = distances(g.items[item], room)
            good = d <= g.edits
            yield from zip((a + row[good]).tolist(), item[good].tolist(), d[good].tolist())


def matches(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text, item, start word, edits): the best stretch of each text for each item that is similar enough."""
    if not index.groups:
        return []
    longest = index.groups[-1].size + index.groups[-1].edits
    get, ids, first, sizes = index.vocabulary.get, [], [], []
    for text in texts:
        first.append(len(ids))
        ids += [get(w, 0) for w in words_of(text)]
        sizes.append(len(ids) - first[-1])
        ids += [0] * longest  # no window of one text reaches another's words
    x = np.array(ids, np.int32)
    first, sizes = np.array(first), np.array(sizes)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for g in index.groups:
        # a window with a match at its start holds all but `edits` of the item's words, so of the group's
        known = np.zeros(len(x) + 1, np.int32)
        np.cumsum(g.any[x], out=known[1:])
        at = np.flatnonzero(known[g.size :] - known[: -g.size] >= g.size - g.edits)
        doc = np.searchsorted(first, at, "right") - 1
        at = at[at - first[doc] < sizes[doc]]  # none begins in the gap after a text
        if not len(at):
            continue
        views = np.lib.stride_tricks.sliding_window_view(x, g.size + g.edits)
        code = np.concatenate([views[at[k : k + 65_536]] @ g.mix for k in range(0, len(at), 65_536)])
        _, once, which = np.unique(code, return_index=True, return_inverse=True)
        likely = np.flatnonzero(possible(g, views, at[once]))
        for row, item, dist in verified(g, views, at[once[likely]]):
            for s in at[which == likely[row]].tolist():
                doc = int(np.searchsorted(first, s, "right")) - 1
                key, now = (doc, int(g.ids[item])), (dist, s - int(first[doc]))
                best[key] = min(best.get(key, now), now)
    return [(doc, item, start, dist) for (doc, item), (dist, start) in sorted(best.items())]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of BLOCK items or WORDS_HELD words at most, in the order of item_id."""
    now: list[tuple[int, bytes]] = []
    held = 0
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.encode("text", "UTF-8")).orderBy("item_id")
    for item, text in rows.toLocalIterator():
        n = len(words_of(bytes(text)))
        if now and (len(now) == BLOCK or held + n > WORDS_HELD):
            yield index_of(now)
            now, held = [], 0
        now.append((item, bytes(text)))
        held += n
    if now:
        yield index_of(now)


def shared_indexes(docs: DataFrame, benchmark: DataFrame) -> list:
    """The benchmark's indexes, each a broadcast of bounded size of its own."""
    return [docs.sparkSession.sparkContext.broadcast(x) for x in indexes(benchmark)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> (doc_id, item_id, start_word, edits, similarity).

    A row for each document row and item of which some stretch of the document is within 20 % of the item's words in
    edits (words replaced, put in or left out); the best stretch, the first of equals. Words are lower-case runs of
    letters and digits. Windows of each item's length that hold too few of the benchmark's words cannot match and are
    passed over, by an exact count; the others are embedded by random walks, keyed by sampled symbols and, where a key
    meets an item's, compared exactly. The benchmark is a query set that all tasks hold as indexes of bounded size; the
    documents are read once, however many there are. Null and wordless texts and items never match; repeated rows match
    each; items with the same id are taken as one; an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, start_word long, edits long, similarity double"
    held = shared_indexes(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            doc, texts, best = b.column(0).to_pylist(), utf8(b.column(1)), {}
            for x in held:
                sizes = {int(i): g.size for g in x.value.groups for i in g.ids}
                for k, item, start, edits in matches(x.value, texts):
                    now = (edits, start, sizes[item])
                    best[k, item] = min(best.get((k, item), now), now)
            rows = [(doc[k], item, start, edits, 1 - edits / size) for (k, item), (edits, start, size) in sorted(best.items())]
            if rows:
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "start_word", "edits", "similarity"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with the columns of docs. Texts stay where they are: each task drops its own. Null and wordless
    texts have no leak and stay, as do all if there is no item; repeated rows are judged each; an empty table gives no rows."""
    at, held = docs.columns.index("text"), shared_indexes(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            texts = utf8(b.column(at))
            bad = {k for x in held for k, *_ in matches(x.value, texts)}
            yield b.filter(pa.array([k not in bad for k in range(b.num_rows)]))

    return mapped(docs, run, docs.schema)
