"""Ordered folds in parallel. Rows are dealt by source and stretch of seq; what a stretch does to any state that enters it is summed
up in a few numbers, the states at the stretches' starts follow from these, and then every stretch is run by itself."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.prefix import SPAN, stretch_of
from lexforge.sources.shared import saved


def dealt(docs: DataFrame, span: int) -> DataFrame:
    """docs (seq, source, n) -> those columns and `stretch`, a number that about `span` rows of a source share; computed once."""
    rows = saved(docs.select("source", "seq", F.col("n").cast("long").alias("n")))
    return rows.withColumn("stretch", stretch_of(rows, "seq", span))


def by_stretch(rows: DataFrame, run: Callable, schema: str, names: list[str]) -> DataFrame:
    """run(source, stretch, seqs, ns, state) -> columns, for each source and stretch of rows (source, stretch, seq, n, state...)
    in order of seq. A task holds one stretch at a time, as arrays of two numbers a row."""
    kinds = [f.dataType.simpleString() for f in rows.sparkSession.createDataFrame([], schema).schema.fields]
    types = [{"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}[k] for k in kinds]
    first = ["source", "stretch", "seq", "n"]
    rest = [c for c in rows.columns if c not in first]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            state = [t.column(c)[0].as_py() for c in rest]
            seqs, ns = (t.column(c).to_numpy() for c in ("seq", "n"))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(run(*key, seqs, ns, *state), types)], names)

        for b in batches:
            if not b.num_rows:
                continue
            source = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            stretch = b.column(1).to_numpy()
            at = [0, *(1 + np.flatnonzero((np.diff(source) != 0) | (np.diff(stretch) != 0))).tolist(), b.num_rows]
            for a, z in zip(at, at[1:]):
                now = (b.column(0)[a].as_py(), b.column(1)[a].as_py())
                if held and now != key:
                    yield done()
                    held = []
                key = now
                held.append(b.slice(a, z - a))
        if held:
            yield done()

    return rows.select(*first, *rest).repartition("source", "stretch").sortWithinPartitions("source", "stretch", "seq").mapInArrow(work, schema)


def along(sums: DataFrame, start: Callable, step: Callable, schema: str, names: list[str]) -> DataFrame:
    """step(state, row) -> (row out or None, state) over each source's rows of `sums` in order of stretch: a row for each stretch, so
    for a source of ten thousand million rows some ten thousand."""
    kinds = [f.dataType.simpleString() for f in sums.sparkSession.createDataFrame([], schema).schema.fields]
    types = [{"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}[k] for k in kinds]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state, begun = None, None, False
        for b in batches:
            out = []
            for row in b.to_pylist():
                if not begun or row["source"] != source:
                    source, state, begun = row["source"], start(), True
                made, state = step(state, row)
                if made is not None:
                    out.append((source, row["stretch"], *made))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return sums.repartition("source").sortWithinPartitions("source", "stretch").mapInArrow(work, schema)


def entered(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows with the state that enters their stretch; rows of other stretches go."""
    s = states.withColumnsRenamed({"source": "__source", "stretch": "__stretch"})
    return rows.join(s, rows["source"].eqNullSafe(F.col("__source")) & (rows["stretch"] == F.col("__stretch"))).drop("__source", "__stretch")


# --- next-fit ---------------------------------------------------------------------------------------------------------


def breaks_of(before: list[int], room: int, size: int) -> list[int]:
    """The documents that begin a block, if `room` tokens are left in the block at hand; before: the tokens before each
    document, and all."""
    out = []
    at = bisect_right(before, room) - 1
    while at < len(before) - 1:
        out.append(at)
        at = bisect_right(before, before[at] + size) - 1
    return out


def effect(ns: np.ndarray, size: int) -> tuple[list[int], list[int], list[int], int]:
    """(rooms, blocks, fills, total): with room r left, rooms[k] <= r < rooms[k + 1], the stretch begins blocks[k] blocks and leaves
    the last with fills[k] tokens; with `total` of room or more it begins none.

    The first document that doesn't fit, one of those that begin within `size` tokens, decides all after it, and
    paths that meet go on as one, so all of them together take about as long as one.
    """
    before = [0, *np.cumsum(ns).tolist()]
    end, known = len(ns), {}
    firsts = [k for k in range(bisect_right(before, size)) if k < end and ns[k]]
    for k in reversed(firsts):
        path, at = [], k
        while at < end and at not in known:
            path.append(at)
            at = bisect_right(before, before[at] + size) - 1
        done = known.get(at)
        for p in reversed(path):
            done = known[p] = (1, before[end] - before[p]) if done is None else (done[0] + 1, done[1])
    rooms, blocks, fills = [], [], []
    for k in firsts:
        if not blocks or known[k] != (blocks[-1], fills[-1]):
            rooms.append(before[k])
            blocks.append(known[k][0])
            fills.append(known[k][1])
    return rooms, blocks, fills, before[-1]


def next_fit(docs: DataFrame, size: int, span: int = SPAN) -> DataFrame:
    """docs (seq, source, n) -> (source, seq, block, start, end): blocks of `size` tokens, a new one when the next document
    does not fit; larger documents are passed over.

    A stretch's effect is a step function of the room left in the block at hand, of at most as many steps as documents
    begin in one block. A source with nearly all rows is spread over its stretches.
    """
    rows = dealt(docs.filter(F.col("n") <= size), span)

    def summed(source, stretch, seqs, ns):
        rooms, blocks, fills, total = effect(ns, size)
        return [source], [stretch], [rooms], [blocks], [fills], [total]

    names = ["source", "stretch", "rooms", "blocks", "fills", "total"]
    sums = by_stretch(rows, summed, "source string, stretch long, rooms array<long>, blocks array<long>, fills array<long>, total long", names)

    def step(state: tuple[int, int], row: dict):
        block, fill = state
        if row["total"] <= size - fill:
            return state, (block, fill + row["total"])
        k = bisect_right(row["rooms"], size - fill) - 1
        return state, (block + row["blocks"][k], row["fills"][k])

    states = along(sums, lambda: (0, 0), step, "source string, stretch long, block long, fill long", ["source", "stretch", "block", "fill"])

    def placed(source, stretch, seqs, ns, block, fill):
        before = np.concatenate([[0], np.cumsum(ns)])
        begins = np.array(breaks_of(before.tolist(), size - fill, size), np.int64)
        nth = np.searchsorted(begins, np.arange(len(ns)), "right")
        start = before[:-1] - np.concatenate([[-fill], before[begins]])[nth]
        return [source] * len(ns), seqs, block + nth, start, start + ns

    return by_stretch(entered(rows, saved(states)), placed, "source string, seq long, block long, start long, end long", ["source", "seq", "block", "start", "end"])


# --- phases -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phase:
    name: str
    least: int
    target: int


def route(docs: DataFrame, phases: list[Phase], overshoot: int = 100_000, span: int = SPAN) -> DataFrame:
    """docs (seq, source, n) -> (source, seq, phase, take): each document to the first phase, longest first, that it is
    long enough for and that has tokens left.

    It goes in whole if it fits with `overshoot`, else cut to the rest; if the rest is under the phase's least length it is
    passed over and not offered to another phase. A source is done when no phase has room for its shortest document.

    While every phase keeps room for its shortest document, where a document goes depends on its length alone, so a
    stretch only adds to the phases what its sums by length class say. That ends twice for each phase at most: when its
    rest gets short, and when it closes. Only stretches in which that happens are gone through before the states behind
    them are known, for all sources at once, in two rounds for each phase at most.
    """
    marks = sorted({p.least for p in phases})
    fits = [[k for k, p in enumerate(phases) if p.least <= m] for m in marks]  # phases for each class of lengths, in order

    def phase_of(written: list[int], n: int) -> int | None:
        return next((k for k in (fits[bisect_right(marks, n) - 1] if n >= marks[0] else ()) if phases[k].target > written[k]), None)

    def is_done(written: list[int]) -> bool:
        return all(p.target - w < p.least for p, w in zip(phases, written))

    def taken(written: list[int], ns: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, phase, tokens) of the documents that go in; counts them in `written`."""
        for i, n in enumerate(ns):
            if is_done(written):
                return
            k = phase_of(written, n)
            if k is None:
                continue
            rest = phases[k].target - written[k]
            if n > rest + overshoot and rest < phases[k].least:
                continue
            take = n if n <= rest + overshoot else rest
            written[k] += take
            yield i, k, take

    def skipped(written: list[int], row: dict) -> list[int] | None:
        """What is written after a stretch, by its sums; None if a phase gets short or closes in it."""
        if is_done(written):
            return written
        after = list(written)
        for c, mark in enumerate(marks):
            if not row[f"n{c}"]:
                continue
            k = phase_of(written, mark)
            if k is None:
                continue
            rest = phases[k].target - written[k]
            if rest >= phases[k].least:
                after[k] += row[f"sum{c}"]
            elif row[f"min{c}"] <= rest + overshoot:
                return None
        ends = any(a > w and p.target - a < max(p.least, 1) for p, w, a in zip(phases, written, after))
        return None if ends else after

    rows = dealt(docs.filter(F.col("n").isNotNull()), span)
    class_of = [(F.col("n") >= m) & (F.col("n") < up if up is not None else F.lit(True)) for m, up in zip(marks, [*marks[1:], None])]
    sums = rows.groupBy("source", "stretch").agg(*[f for c, x in enumerate(class_of) for f in (F.count_if(x).alias(f"n{c}"), F.sum(F.when(x, F.col("n"))).alias(f"sum{c}"), F.min(F.when(x, F.col("n"))).alias(f"min{c}"))])
    sums = saved(sums.withColumn("last", F.col("stretch") == F.max("stretch").over(Window.partitionBy("source"))))

    def step(state: list[int] | None, row: dict):
        if state is None:
            return None, None  # behind a stretch that is still to be gone through
        after = row["left"] if row["left"] is not None else skipped(state, row)
        return (state, after is None and not row["last"]), after

    known = None
    while True:
        left = sums.withColumn("left", F.lit(None).cast("array<long>"))
        if known is not None:
            k = known.withColumnsRenamed({"source": "__source", "stretch": "__stretch"})
            left = sums.join(k, sums["source"].eqNullSafe(F.col("__source")) & (sums["stretch"] == F.col("__stretch")), "left").drop("__source", "__stretch")
        states = saved(along(left, lambda: [0] * len(phases), step, "source string, stretch long, written array<long>, ask boolean", ["source", "stretch", "written", "ask"]))
        asked = states.filter("ask").drop("ask")
        if asked.isEmpty():
            break

        def left_by(source, stretch, seqs, ns, written):
            for _ in taken(written, ns.tolist()):
                pass
            return [source], [stretch], [written]

        more = by_stretch(entered(rows, asked), left_by, "source string, stretch long, left array<long>", ["source", "stretch", "left"])
        known = saved(more if known is None else known.unionByName(more))

    def routed(source, stretch, seqs, ns, written):
        got = list(taken(written, ns.tolist()))
        return [source] * len(got), seqs[[i for i, _, _ in got]] if got else [], [phases[k].name for _, k, _ in got], [t for _, _, t in got]

    return by_stretch(entered(rows, states.drop("ask")), routed, "source string, seq long, phase string, take long", ["source", "seq", "phase", "take"])
