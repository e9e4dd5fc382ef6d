"""SimHash near-duplicates: fingerprints linked by bit-sliced comparison within pigeonhole buckets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, in_files, mapped, partitions, pieces, utf8
from lexforge.llm.components import connected_components
from lexforge.operators.bitmap import bitmap, marked

BITS, SEED, SHINGLE, RADIUS = 64, 42, 4, 4
#: Fingerprints of one bucket that one task compares; larger buckets are tiled.
TILE = 16_384
#: Buckets up to this size are compared together, many in one pass.
SMALL = 512
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows up to this many, 16 bytes each, are broadcast when documents are taken out; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of one text's UTF-8 bytes; 0 without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, votes = len(words) - SHINGLE + 1, np.zeros(BITS, np.int64)
    starts, ends = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, 32_768):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + 32_768], ends[at : at + 32_768])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def same() -> F.Column:
    """A hash of the text; a null text is an empty one. Texts that differ share it with a chance of 2^-64."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, same long, fp long): the fingerprint's 64 bits as a signed long, and a hash that equal
    texts share. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fp = np.fromiter(map(fingerprint, utf8(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "same", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long"), same().alias("same"), "text"), run, "doc_id long, same long, fp long")


def bucket_masks(n: int) -> list[int]:
    """Masks of which any two fingerprints within RADIUS agree under at least one.

    64 bits are cut into RADIUS + c blocks; at most RADIUS of them differ, so c agree. c grows with the number n of
    fingerprints so that a bucket of unrelated ones stays near a thousand.
    """
    c = next((c for c in range(1, 4) if n >> (BITS * c // (RADIUS + c)) <= 1024), 4)
    edges = [BITS * k // (RADIUS + c) for k in range(RADIUS + c + 1)]
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, c)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, n / 64) words: bit i of word w in plane j is bit j of fingerprint 64 w + i. n is a multiple of 64."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of block word[k] lie within RADIUS (4) bits of fingerprint query[k]: (k, lane).

    Distances are kept as carry-save counters, one bit of 64 distances per word; a lane over the radius stays marked in
    `over` (which comes in with the lanes not asked for), and blocks with all lanes marked are abandoned.
    """
    at = np.arange(len(query))
    one, two, four = (np.zeros(len(query), np.uint64) for _ in range(3))
    for j in range(0, BITS, 2):
        a = planes[j][word] ^ (np.uint64(0) - ((query >> np.uint64(j)) & np.uint64(1)))
        b = planes[j + 1][word] ^ (np.uint64(0) - ((query >> np.uint64(j + 1)) & np.uint64(1)))
        half = one ^ a
        carry = (one & a) | (half & b)
        one = half ^ b
        carry2 = two & carry
        two = two ^ carry
        over = over | (four & carry2)
        four = four | carry2
        over = over | (four & (one | two))
        if j % 8 == 6:
            alive = over != ONES
            if 4 * np.count_nonzero(alive) < 3 * len(alive):
                at, query, word, over, one, two, four = (x[alive] for x in (at, query, word, over, one, two, four))
    hit = np.flatnonzero(over != ONES)
    lanes = np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return at[hit[row]], word[hit[row]] * 64 + lane


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _padded(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of fps, and for each word the lanes that hold none."""
    n = -(-len(fps) // 64) * 64
    lanes = np.zeros(n, np.uint64)
    lanes[: len(fps)] = fps
    empty = np.packbits(np.arange(n) >= len(fps), bitorder="little").view("<u8")
    return planes_of(lanes), empty


def links_of_large(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs within the radius connect, for one large bucket.

    Components are taken in one after another. What a component has reached is no longer compared with others but asks
    itself, before any new query: a dense group is taken in by its first members, so a bucket of many near copies costs
    about its size, not its square. New queries are asked many at once; those without a link are done, the first with
    links begins the next component and the rest are asked again.
    """
    left, frontier, out, step = np.arange(len(fps)), np.empty(0, np.int64), [(np.empty(0, np.int64),) * 2], 1
    while len(left):
        grown = len(frontier) > 0
        if grown:
            asked, frontier = frontier[:256], frontier[256:]
        else:
            asked, step = left[:step], min(256, 2 * step)
        planes, empty = _padded(fps[left])
        w = len(empty)
        at = max(1, (1 << 20) // w)
        q, lane = [], []
        for k in range(0, len(asked), at):
            part = asked[k : k + at]
            i, j = within(planes, np.repeat(fps[part], w), np.tile(np.arange(w), len(part)), np.tile(empty, len(part)))
            q.append(part[i // w])
            lane.append(left[j])
        q, lane = np.concatenate(q), np.concatenate(lane)
        q, lane = q[q != lane], lane[q != lane]
        if not grown:
            alone = np.setdiff1d(asked, q)
            left = left[~np.isin(left, alone)]
            if not len(q):
                continue
            first = q == q.min()
            q, lane = q[first], lane[first]
            left = left[left != q[0]]
        _, once = np.unique(lane, return_index=True)
        q, lane = q[once], lane[once]
        out.append((q, lane))
        frontier = np.concatenate((frontier, lane))
        left = left[~np.isin(left, lane)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links_of(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices a, b) that connect what pairs within the radius in one bucket connect. bucket is sorted."""
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bucket) else np.empty(0, np.int64)
    sizes = np.diff(starts, append=len(bucket))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        x, y = links_of_large(fps[s : s + n])
        a.append(x + s)
        b.append(y + s)
    few = (sizes > 1) & (sizes <= SMALL)
    starts, sizes = starts[few], sizes[few]
    words = -(-sizes // 64)
    cost = np.cumsum(sizes * words) // (1 << 19)
    for g in np.unique(cost).tolist():
        s, n, w = starts[cost == g], sizes[cost == g], words[cost == g]
        first = np.concatenate(([0], np.cumsum(w)))[:-1]  # word at which each bucket begins
        own = np.repeat(np.arange(len(s)), n)  # bucket of each member
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        index = np.repeat(s, n) + rank
        place = np.repeat(first * 64, n) + rank
        lanes, back = np.zeros(int(w.sum()) * 64, np.uint64), np.full(int(w.sum()) * 64, -1)
        lanes[place], back[place] = fps[index], index
        empty = np.packbits(back < 0, bitorder="little").view("<u8")
        times = w[own] - rank // 64  # later words only
        k = np.repeat(np.arange(len(rank)), times)
        off = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        word = first[own[k]] + rank[k] // 64 + off
        low = np.where(off == 0, ONES >> (np.uint64(63) - (rank[k] % 64).astype(np.uint64)), np.uint64(0))
        i, lane = within(planes_of(lanes), fps[index[k]], word, empty[word] | low)
        a.append(index[k[i]])
        b.append(back[lane])
    a, b = np.concatenate(a), np.concatenate(b)
    root = roots_of(len(bucket), a, b)
    node = np.unique(np.concatenate((a, b)))
    node = node[root[node] != node]
    return node, root[node]


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, fp, rep) rows -> links (u, v). A bucket may span batches; it is held until it is whole."""
    held: list[pa.RecordBatch] = []
    n = 0

    def links(rows: pa.Table) -> pa.RecordBatch:
        bucket, fp, rep = (rows.column(k).to_numpy() for k in range(3))
        _, bucket = np.unique(bucket, return_inverse=True)
        x, y = links_of(bucket, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[y])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < 200_000:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        bucket = rows.column(0).to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))
        if last:
            yield links(rows.slice(0, last))
            rows = rows.slice(last)
        held, n = rows.to_batches(), rows.num_rows
    if held:
        yield links(pa.Table.from_batches(held))


def links(distinct: DataFrame, n: int) -> DataFrame:
    """distinct (fp long, rep long), n rows -> links (u, v) between reps whose fingerprints differ in RADIUS bits at most,
    thinned to a spanning forest of each bucket.

    Each fingerprint goes into one bucket for each mask. A bucket of over TILE fingerprints is dealt into parts, and
    each pair of parts is compared by another task, so no task holds more than about twice TILE and no pair is lost.
    """
    masks = bucket_masks(n)
    keyed = distinct.select(
        "fp",
        "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("t", "key"),
    )
    spark = distinct.sparkSession
    tiled = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if n > TILE:  # else no bucket is over it
        hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        tiled = (
            keyed.join(hot, ["t", "key"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("p", part)
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("fp", "rep", "t", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
        )
    ready = tiled.select(F.xxhash64("t", "key", "i", "j").alias("bucket"), "fp", "rep")
    # two buckets that share a hash are compared as one: more pairs are looked at, none is lost or made up
    return ready.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_bucketed, "u long, v long")


def grouped(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp, ...), checkpointed -> (fp, root): the smallest fingerprint reachable, as signed longs go, for each
    distinct one. Fingerprints are the nodes, so rows without a doc_id link like any other."""
    distinct = cut(fps.select("fp").distinct(), fps.count())
    roots = connected_components(links(distinct.withColumn("rep", F.col("fp")), distinct.count()))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint string, component_id long), a row for each row.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are four words, repeats included; XXH64 with
    seed 42; a bit is set if over half of the hashes have it. Null, empty and wordless texts have fingerprint 0 and are
    linked like any other. Equal fingerprints and those up to 4 bits apart are linked; component_id is the smallest
    doc_id reachable. Repeated rows stay; an empty table gives no rows. A row without a doc_id links others and gets
    their component_id, which is null only if no row of its component has a doc_id.
    """
    fps = cut(fingerprints(docs))
    group = grouped(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("m")).join(group, "fp")
    of_root = least.groupBy("root").agg(F.min("m").alias("component_id"))
    named = group.join(of_root, "root").select("fp", "component_id")
    out = fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return in_files(out, fps.count())


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with the columns of docs: that of the smallest doc_id, a null one being larger
    than any other; of several texts with that doc_id, the one of the smallest hash.

    Rows that share doc_id and text are one. A null text is an empty one. Texts move only where a row's doc_id and text
    repeat: what goes is found on ids and hashes, and taken out by a broadcast of these, or of a bitmap of them if they are many.
    An empty table gives no rows.
    """
    fps = cut(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    best = fps.groupBy("fp").agg(F.min(order).alias("w"))  # before any join: copies are many
    first = best.join(grouped(fps), "fp").groupBy("root").agg(F.min("w").alias("w"))
    kept = first.select(F.col("w.doc_id").alias("k_id"), F.col("w.same").alias("k_same"))
    rows = fps.groupBy(F.col("doc_id").alias("__id"), F.col("same").alias("__same")).agg(F.count("*").alias("rows"))
    is_kept = F.col("__id").eqNullSafe(F.col("k_id")) & (F.col("__same") == F.col("k_same"))
    judged = cut(rows.join(kept, is_kept, "left").select("__id", "__same", F.col("k_same").isNotNull().alias("kept"), "rows").filter("NOT kept OR rows > 1"), fps.count())
    gone, twice = (judged.filter(x).select("__id", "__same") for x in ("NOT kept", "kept"))

    (gone, n), (twice, repeated) = ((x, x.count()) for x in (gone, twice))
    key = F.struct(docs["doc_id"].cast("long"), same())
    out = matching(docs, key, gone, n, "left_anti")
    if not repeated:
        return out
    alone = matching(out, key, twice, repeated, "left_anti")
    marked = matching(out, key, twice, repeated, "left_semi").withColumns({"__id": F.col("doc_id").cast("long"), "__same": same()})
    return alone.unionByName(marked.dropDuplicates(["__id", "__same"]).select(*docs.columns))


def matching(docs: DataFrame, key: F.Column, listed: DataFrame, n: int, how: str) -> DataFrame:
    """docs joined (left_anti or left_semi) with listed (__id, __same), n rows: by a broadcast while they are few; beyond, a bitmap of
    them, 64 MB at most, is broadcast, and only the documents it lets through, the listed ones and few others, are shuffled."""
    here = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (same() == F.col("__same"))
    if n <= BROADCAST_ROWS:
        return docs.join(F.broadcast(listed), here, how)
    pages, size = bitmap(listed, F.struct("__id", "__same"), n)
    each = marked(docs, key, pages, size)
    hit = each.filter("__hit").drop("__hit").join(listed, here, how)
    return hit if how == "left_semi" else each.filter("NOT __hit").drop("__hit").unionByName(hit)
