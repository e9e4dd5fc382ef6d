"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, a linear hinge-loss model on them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, fold, mapped, pieces, utf8
from lexforge.operators.bitmap import bitmap, may_have

#: Slots that n-grams are hashed into.
SLOTS = 1 << 18
#: Labelled documents that the hinge-loss model is fitted on, drawn by a hash: the bound of its sample. The log-count
#: ratios come from all labelled documents of the training folds.
SAMPLE = 6_000
#: Bytes of the sample's slots that the driver holds at most; where long texts have more, the sample is halved by its hash.
SAMPLE_BYTES = 256 << 20
#: Labels up to this many are broadcast, some 20 bytes each; more meet the texts in a shuffle.
BROADCAST_LABELS = 1_000_000
COST, EPOCHS, THRESHOLD = 1.0, 12, 0.3
#: Words whose hashes a worker keeps.
CACHE = 300_000

_known: dict[bytes, tuple[int, int]] = {}


def shape(word: bytes) -> bytes:
    """A for upper case, a for other letters, 0 for digits, other characters as they are; runs count once."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word.decode("utf-8", "replace"))
    return re.sub(r"(.)\1+", r"\1", "".join(kinds)).encode()


def hashes(word: bytes) -> tuple[int, int]:
    found = _known.get(word)
    if found is None:
        found = zlib.crc32(word), zlib.crc32(shape(word), 1)
        if len(_known) < CACHE:
            _known[word] = found
    return found


def slots_of(text: bytes) -> np.ndarray:
    """Distinct slots of a text's n-grams: words (1, 2), their shapes (1, 2, 3), and graded shares of shapes and repeats."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    both = np.array([hashes(w) for w in words], np.uint64)
    w, s = both[:, 0], both[:, 1]
    mix = np.uint64(0x9E3779B97F4A7C15)
    out = [w * mix, s * mix + np.uint64(1)]
    if len(words) > 1:
        out += [(w[:-1] * mix + w[1:]) * mix + np.uint64(2), (s[:-1] * mix + s[1:]) * mix + np.uint64(3)]
    if len(words) > 2:
        out.append(((s[:-2] * mix + s[1:-1]) * mix + s[2:]) * mix + np.uint64(4))
    kinds, n = np.unique(s, return_counts=True)
    grade = np.ceil(-np.log2(n / len(words))).astype(np.uint64)
    out.append((kinds * mix + grade) * mix + np.uint64(5))
    same = int((w[1:] == w[:-1]).sum())
    new = len(np.unique(w))
    extra = [(6, same.bit_length()), (7, 16 * same // len(words)), (8, 16 * new // len(words)), (9, len(words).bit_length())]
    out.append(np.array([(k * 1000 + v) for k, v in extra], np.uint64) * mix)
    return np.unique(np.concatenate(out) >> np.uint64(64 - 18)).astype(np.int64)


def counted(labelled: DataFrame) -> DataFrame:
    """labelled (text, y) -> (slot, ones, zeros): documents of either label that have the slot; slot -1: all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SLOTS + 1), np.int64)
        for b in pieces(batches, "text"):
            for text, y in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                n[y, slots_of(text)] += 1
                n[y, SLOTS] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == SLOTS, -1, at)), pa.array(n[1, at]), pa.array(n[0, at])], ["slot", "ones", "zeros"])

    return mapped(labelled.select("text", "y"), run, "slot long, ones long, zeros long").groupBy("slot").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for the hinge loss (Hsieh et al., 2008). rows: slots; y: -1 or 1. The last weight is the bias."""
    w = np.zeros(len(ratio) + 1)
    scaled = [ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-9) for x in rows]
    alpha, norm = np.zeros(len(rows)), np.array([float((x**2).sum()) + 1 for x in scaled])
    weight = cost * len(y) / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))  # both labels alike
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i], scaled[i]
            slope = y[i] * (float(w[at] @ x) + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        x = self.ratio[slots]
        return float(self.weights[slots] @ x) / max(float(np.sqrt((x**2).sum())), 1e-9) + float(self.weights[-1])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots_of(text)) + self.shift, -30, 30))))


def sigmoid_of(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid, by Newton steps on the smoothed labels."""
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, v = p - t, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def bounded(rows: Iterable[tuple[int, int, bytes, float]], most: int) -> list[tuple[int, int, bytes, float]]:
    """rows (doc_id, y, slots, u), sorted; if the slots have over `most` bytes, those of the lower half of u, and so on: a row
    stays or goes by its hash, not by its length."""
    kept, held, below = [], 0, 2.0
    for r in rows:
        if r[3] >= below:
            continue
        kept.append(r)
        held += len(r[2])
        while held > most and len(kept) > 1:
            below = sorted(x[3] for x in kept)[len(kept) // 2]
            kept = [x for x in kept if x[3] < below]
            held = sum(len(x[2]) for x in kept)
    return sorted(kept)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """docs (doc_id, text), labels (doc_id, quality) -> a model from the folds other than 0 of 5; None without labels.

    Texts meet labels in a join that broadcasts these behind a count; beyond, a bitmap of the labels' ids (64 MB at most) is broadcast,
    and only texts that it lets through, the labelled ones and few others, are shuffled. The
    counts go to the driver as SLOTS numbers for each label, the sample as slots of `most` documents about.
    """
    known = labels.filter("quality IN (0, 1)").filter(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    texts = docs.select("doc_id", "text").filter(fold("doc_id", 5) != 0)
    known = cut(known)
    labelled = known.count()
    if labelled <= BROADCAST_LABELS:
        met = texts.join(F.broadcast(known), "doc_id")
    else:
        met = may_have(texts, F.col("doc_id"), *bitmap(known, F.col("doc_id"), labelled)).join(known.hint("shuffle_hash"), "doc_id")
    n = {r["slot"]: (r["ones"], r["zeros"]) for r in counted(met).collect()}
    all_ones, all_zeros = n.pop(-1, (0, 0))
    if not all_ones + all_zeros:
        return None
    ones, zeros = np.ones(SLOTS), np.ones(SLOTS)
    at = np.fromiter(n, np.int64, len(n))
    ones[at] += [x for x, _ in n.values()]
    zeros[at] += [x for _, x in n.values()]
    ratio = np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("quality")), 11) / float(1 << 53)
    drawn = known.withColumn("u", u).filter(F.col("u") < min(1.0, most / (all_ones + all_zeros)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            slots = [slots_of(x).astype(np.int32).tobytes() for x in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(slots, pa.binary())], ["doc_id", "y", "u", "slots"])

    sample = mapped(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "u", "text"), run, "doc_id long, y int, u double, slots binary")
    rows = bounded(((r["doc_id"], r["y"], bytes(r["slots"]), r["u"]) for r in sample.toLocalIterator(prefetchPartitions=True)), SAMPLE_BYTES)
    if not rows:
        return None
    x, y = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in rows], np.array([2 * r[1] - 1 for r in rows])
    apart = np.arange(len(rows)) % 4 == 0  # a quarter sets the sigmoid, on a model of the rest
    model = Model(ratio, np.zeros(SLOTS + 1), 1.0, 0.0)
    if len(rows) >= 40:
        model.weights = descend([v for v, a in zip(x, apart) if not a], y[~apart], ratio)
        model.slope, model.shift = sigmoid_of(np.array([model.margin(v) for v, a in zip(x, apart) if a]), y[apart])
    model.weights = descend(x, y, ratio)
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> (doc_id, held_out, score, predicted), a row for each row.

    A document's score depends on its text alone. Null and empty texts get the score of no n-grams; labels other than 0
    and 1 are not learned from; of several labels of a document the larger counts; without any label every score is 0.5.
    Repeated rows are scored each; an empty table gives no rows.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text"):
            score = np.array([0.5 if m is None else m.score(x) for x in utf8(b.column(2))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return mapped(slim, run, "doc_id long, held_out boolean, score double, predicted int")
