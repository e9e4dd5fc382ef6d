"""Shortest-pack-first packing over the histogram of piece lengths (Krell et al., 2021)."""

from __future__ import annotations

import bisect
import gc
import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut, in_files, mapped, partitions, pieces, utf8

LENGTH, END = 2048, 1
#: Distinct chunks between white space whose ids a worker keeps, and as many units; beyond, the later half goes. Words
#: and marks are short, so these are some 150 MB.
CACHE = 400_000
#: How the word-end vocabulary splits text, fixed by its file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks (and the spaces between them) of these characters alone are lower-cased and split alike by Python and by the tokenizer, and NFC keeps them.
SIMPLE = re.compile("[ -~\u00c0-\u012f\u0131-\u024f]+")
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+| ")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies, as a table for str.translate."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own and b != 32]
    shifted = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + shifted.index(b)) for b in other}


def trimmed(known: dict) -> dict:
    """known, or its first half if it is over CACHE: what came first is what comes often."""
    return known if len(known) <= CACHE else dict(islice(known.items(), CACHE // 2))


class Encoder:
    """Ids of texts as little-endian 32-bit words.

    With the word-end vocabulary no token spans white space, so each chunk between is encoded once and its ids are kept;
    new simple chunks are split here and run through the same merges together. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.units = Tokenizer.from_file(path), {b"": b""}, {" ": b""}
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        steps = [x.get("type") for x in (how.get("normalizer") or {}).get("normalizers", [])]
        split = [(x.get("pattern") or {}).get("Regex") for x in (how.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_chunk = steps == ["NFC", "Replace", "Lowercase"] and split == [SPLIT, None] and how["model"].get("end_of_word_suffix") == "</w>"
        if self.by_chunk:
            self.merges, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def simple(self, chunks: str) -> list[bytes]:
        """Ids of chunks of SIMPLE characters, one space between: those of their units, which are kept too, as a new chunk
        often is known words and marks put together."""
        units = UNIT.findall(chunks.lower())
        new = list(set(units).difference(self.units))
        for unit, plain in zip(new, " ".join(new).encode().decode("latin1").translate(self.letters).split(" ")):
            self.units[unit] = array("I", [t.id for t in self.merges(plain)]).tobytes()
        each = list(map(self.units.__getitem__, units))
        at = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))[[k for k, x in enumerate(each) if not x]].tolist()
        self.units, ids = trimmed(self.units), b"".join(each)
        return [ids[a:b] for a, b in zip([0, *at], [*at, len(ids)])]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, bytes]:
        """The texts' ids one after another, and where in these bytes each text begins, and the last ends. Nulls are empty.

        Splitting, finding a batch's distinct chunks and laying their ids out again are Arrow's; only distinct chunks are
        looked up here.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_chunk:
            ids = self.whole(texts.to_pylist())
            return np.cumsum([0, *map(len, ids)]), b"".join(ids)
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.flatten())
        chunks = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, chunks))
        new = [k for k, x in enumerate(ids) if x is None]
        self.learn([chunks[k] for k in new])
        for k in new:
            ids[k] = self.known[chunks[k]]
        each = pa.array(ids, pa.binary()).take(coded.indices)
        self.known = trimmed(self.known)
        ends = np.frombuffer(each.buffers()[1], np.int32, len(each) + 1) if len(each) else np.zeros(1, np.int32)
        at = ends[np.asarray(split.offsets) - split.offsets[0].as_py()].astype(np.int64)
        return at, (each.buffers()[2] or b"") if len(each) else b""

    def learn(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            flat = b" ".join(part).decode()
            if SIMPLE.fullmatch(flat) and "<|" not in flat:
                self.known.update(zip(part, self.simple(flat)))
                continue
            named = [c.decode() for c in part]
            easy = [SIMPLE.fullmatch(x) is not None and "<|" not in x for x in named]
            if plain := [x for x, e in zip(named, easy) if e]:
                self.known.update(zip([x for x, e in zip(part, easy) if e], self.simple(" ".join(plain))))
            if odd := [x for x, e in zip(named, easy) if not e]:
                self.known.update(zip([x for x, e in zip(part, easy) if not e], self.whole(odd)))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process; its chunks serve all of the worker's tasks."""
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): full pieces from the front, then the rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        gc.disable()  # chunks by the hundred thousand, none of them in a cycle
        try:
            for b in pieces(batches, "text"):
                rows: list[tuple] = []
                at, flat = encode(b.column(1))
                flat = memoryview(flat)
                for doc, a, z in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    ids = bytes(flat[a:z]) + end
                    n = len(ids) // 4
                    rows += [(doc, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        finally:
            gc.enable()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, ", ".join(f"{x} long" for x in names))


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths in a pack): lengths are placed longest first, each on the packs that are shortest so far."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # free space -> packs
    spaces: list[int] = []  # the keys of room that hold packs, ascending
    for size in sorted(histogram, reverse=True):
        left, moved = histogram[size], []
        while left and spaces and spaces[-1] >= size:
            space = spaces[-1]
            n, pack = room[space].pop()
            if not room[space]:
                spaces.pop()
            took = min(n, left)
            left -= took
            if n > took:
                if not room[space]:
                    bisect.insort(spaces, space)
                room[space].append((n - took, pack))
            moved.append((space - size, took, (*pack, size)))
        if left:
            each = length // size  # of one length alone: as many to a pack as fit
            full, rest = divmod(left, each)
            moved += [(length - each * size, full, (size,) * each)] * bool(full)
            moved += [(length - rest * size, 1, (size,) * rest)] * bool(rest)
        for space, n, pack in moved:
            if not room[space]:
                bisect.insort(spaces, space)
            room[space].append((n, pack))
    return [x for space in sorted(room) for x in room[space]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset): the places for pieces of that length, by rank."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for n, pack in packs:
        at = 0
        for size in pack:
            places[size].append((ranks[size], first, at))
            ranks[size] += n
            at += size
        first += n
    return {k: np.array(v, np.int64) for k, v in places.items()}


def ranked(cuts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """cuts with `rank` from 0 for each length. A length's rows are dealt into as many parts as it needs."""
    many = max(64, sum(histogram.values()) // (2 * partitions(cuts.sparkSession)))
    parts = {k: -(-n // many) for k, n in histogram.items() if n > many}
    part = F.lit(0)
    if parts:
        share = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])  # at most LENGTH entries
        part = F.pmod(F.xxhash64("doc_id", "start", F.lit(7)), F.coalesce(share[F.col("length")], F.lit(1))).cast("int")
    dealt = cuts.withColumn("part", part)
    sums = dealt.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start")
    return dealt.withColumn("nth", F.row_number().over(inside)).join(sums, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("part", "nth", "before")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document's ids are those of the tokenizer file without special tokens, then END; null and empty texts are END
    alone. Only the histogram of lengths, `length` numbers at most, goes to the driver; the packs made from it go back as
    places by length and rank. Repeated rows are packed each; an empty table gives no rows.
    """
    cuts = cut(pieces_of(docs, tokenizer, length))
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}
    places = slots(patterns(histogram, length))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for k in np.unique(size).tolist():
                of, mine = places[k], size == k
                i = np.searchsorted(of[:, 0], rank[mine], "right") - 1
                seq[mine], off[mine] = of[i, 1] + rank[mine] - of[i, 0], of[i, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{x} long" for x in [*names, "sequence_id", "offset"])
    return in_files(ranked(cuts, histogram).select(*names, "rank").mapInArrow(run, schema), sum(histogram.values()))
