"""Language-model scores: exact add-one unigrams, and a log-bilinear model trained by noise-contrastive estimation.

The output is factored: a class, then a word of the class, both log-bilinear in the context and both normalised exactly, by
batched matrix products over all contexts. The most frequent words are classes of their own; the others are classed by how
they end, which is known of any word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, fold, mapped, most_frequent, partitions, pieces

#: Classes, the end and SINGLES words of their own among them; contexts with vectors, the most frequent words and one for the
#: other words of each class; size of all vectors.
CLASSES, SINGLES, CODES, WIDTH = 256, 96, 8192, 16
#: Noise classes shared by a batch; positions in a batch; learning rate.
NOISE, BATCH, RATE = 32, 4096, 0.15
#: Words with weights and counts of their own in every task: the most frequent ones. The other words' counts are joined.
HEAD = 200_000
#: Distinct words that a task holds before it passes them on, or forgets them; leaves whose weights are sent together.
HELD, BLOCK = 300_000, 1024
END, START = 0, 0  # the end's class, and the code of what stands before a text
#: Stands for the end token among the words' hashes.
END_HASH = -1


def hash_of(word: bytes) -> int:
    """A word's 64 bits as a signed long. Words that share all 64 bits are counted as one; END_HASH is kept free."""
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return min(h - (1 << 64) if h >> 63 else h, -2) if h == (1 << 64) - 1 else (h - (1 << 64) if h >> 63 else h)


def ending(word: bytes) -> int:
    """The last four bytes, the last one first, as a number: words of like endings have like numbers."""
    return int.from_bytes(word[:-5:-1].ljust(4, b"\0"), "big")


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of texts: their distinct words, the place of each token's word among these, and the number of tokens of each text.

    Words are runs without ASCII white space, A-Z lower-cased; nulls have none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = pc.dictionary_encode(split.flatten())
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    at, ends = np.asarray(coded.indices), np.asarray(split.offsets).astype(np.int64)
    if b"" in words:  # white space at an end of a text leaves an empty word there
        there = at != words.index(b"")
        ends = np.concatenate(([0], np.cumsum(there)))[ends - ends[0]]
        at = at[there]
    return words, at, np.diff(ends)


def word_counts(train: DataFrame) -> DataFrame:
    """train (text) -> (h, n, e): every token's occurrences, the end's too, and its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        ends = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(map(hash_of, held), pa.int64()), pa.array(held.values(), pa.int64()), pa.array(map(ending, held), pa.int64())], ["h", "n", "e"])

        for b in pieces(batches, "text"):
            words, at, _ = words_of(b.column(0))
            ends += b.num_rows
            for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                if n:
                    held[w] = held.get(w, 0) + n
            if len(held) >= HELD:
                yield out()
                held = {}
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends]), pa.array([0])], ["h", "n", "e"])

    counts = mapped(train.select("text"), run, "h long, n long, e long")
    return counts.groupBy("h").agg(F.sum("n").alias("n"), F.max("e").alias("e")).filter("n > 0")


@dataclass
class Vocabulary:
    """What every task knows of the counts. Arrays `head*` are by sorted hash, of the most frequent tokens.

    The words of a class of several are its leaves, one after another, and after them a leaf for all words of the class beyond
    the head, which has the class's last place. Classes of one word have no leaves.
    """

    tokens: int  # N
    distinct: int  # V
    head: np.ndarray
    head_n: np.ndarray
    head_class: np.ndarray
    head_leaf: np.ndarray  # -1: none
    head_code: np.ndarray  # as a context
    bounds: np.ndarray  # endings at which the next class of several begins
    first: int  # the first class of several words
    start: np.ndarray  # of each such class its first leaf, and after the last the number of leaves
    mass: np.ndarray  # of each leaf its occurrences and one for each of its words; of a last leaf also one for unseen words
    class_mass: np.ndarray

    @property
    def many(self) -> int:
        return len(self.start) - 1

    def of(self, h: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count (-1: not in the head), class, leaf and code of words by hash and ending."""
        m = np.searchsorted(self.bounds, e, "right")
        kind, leaf, code, n = self.first + m, self.start[m + 1] - 1, CODES - CLASSES + self.first + m, np.full(len(h), -1, np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            own = self.head[at] == h
            at = at[own]
            n[own], kind[own], leaf[own], code[own] = self.head_n[at], self.head_class[at], self.head_leaf[at], self.head_code[at]
        return n, kind, leaf, code


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The head and the ends of classes go to the driver, and the mass of the other words as a number for each class."""
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    rows = most_frequent(counts, "n", HEAD).toPandas().sort_values(["n", "h"], ascending=[False, True])
    h, c, e = (rows[x].to_numpy(np.int64) for x in ("h", "n", "e"))
    ends = counts.filter(F.col("h") == END_HASH).select("n").first()
    least = int(c[h != END_HASH].min()) if (h != END_HASH).any() else None  # whole count levels are in the head
    own = h != END_HASH
    h, c, e = h[own], c[own], e[own]  # words, the most frequent first
    first = 1 + SINGLES
    rest = np.arange(SINGLES, len(h))
    rest = rest[np.lexsort((h[rest], e[rest]))]
    upto = np.cumsum(c[rest] + 1)
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, CLASSES - first) / (CLASSES - first)) if len(rest) else np.empty(0, np.int64)
    bounds = np.unique(e[rest][np.minimum(cuts, len(rest) - 1)]) if len(rest) else np.empty(0, np.int64)
    m = np.searchsorted(bounds, e[rest], "right")
    sizes = np.bincount(m, minlength=len(bounds) + 1) + 1
    start = np.concatenate(([0], np.cumsum(sizes)))
    leaf = np.arange(len(rest)) + m  # each class's last leaf shifts what follows by one
    mass = np.ones(start[-1], np.int64)
    mass[leaf] = c[rest] + 1

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1)
        for b in batches:
            total += np.bincount(np.searchsorted(bounds, b.column(0).to_numpy(), "right"), b.column(1).to_numpy() + 1, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total.astype(np.int64))], ["m", "mass"])

    if len(h) + 1 < (v or 0):
        far = counts.filter((F.col("h") != END_HASH) & (F.col("n") < least if least is not None else F.lit(True))).select("e", "n")
        for r in mapped(far, beyond, "m long, mass long").groupBy("m").agg(F.sum("mass").alias("mass")).collect():  # a row for each class
            mass[start[r["m"] + 1] - 1] += r["mass"]
    kinds, leaves, codes = np.arange(1, len(h) + 1), np.full(len(h), -1), np.arange(1, len(h) + 1)
    kinds[rest], leaves[rest] = first + m, leaf
    far = codes >= CODES - CLASSES
    codes[far] = CODES - CLASSES + kinds[far]
    class_mass = np.zeros(CLASSES)
    class_mass[END] = ends[0] if ends else 0
    class_mass[1 : 1 + min(SINGLES, len(h))] = c[:SINGLES]
    class_mass[first : first + len(sizes)] = np.add.reduceat(mass, start[:-1])
    order = np.argsort(h)
    return Vocabulary(n or 0, v or 0, h[order], c[order], kinds[order], leaves[order], codes[order], bounds, first, start, mass, class_mass)


class Reader:
    """Turns texts into tokens; keeps what it knows of words, up to HELD of them."""

    def __init__(self, vocabulary: Vocabulary, end_n: int = 0):
        self.v, self.index, self.rows = vocabulary, {}, np.empty((HELD, 5), np.int64)
        self.end = np.array([END_HASH, end_n, END, -1, START])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 5): of all tokens of the texts, ends included, hash, count (-1: not in the head), class, leaf and code; and the
        tokens of each text."""
        if len(self.index) > HELD:
            self.index = {}
        words, at, sizes = words_of(texts)
        known = list(map(self.index.get, words))
        new = [k for k, x in enumerate(known) if x is None]
        if new:
            h = np.fromiter((hash_of(words[k]) for k in new), np.int64, len(new))
            e = np.fromiter((ending(words[k]) for k in new), np.int64, len(new))
            base = len(self.index)
            if base + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.empty((len(new) + len(self.rows) // 2, 5), np.int64)))
            self.rows[base : base + len(new)] = np.stack((h, *self.v.of(h, e)), axis=1)
            for j, k in enumerate(new):
                known[k] = self.index[words[k]] = base + j
        out = np.empty((len(at) + len(sizes), 5), np.int64)
        own = np.ones(len(out), bool)
        own[np.cumsum(sizes + 1) - 1] = False
        out[own] = self.rows[np.array(known, np.int64)[at]] if len(at) else 0
        out[~own] = self.end
        return out, sizes + 1


def contexts(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the token before each, START at a text's begin, and the class of the one before that, CLASSES there."""
    first = np.cumsum(sizes) - sizes
    one, two = np.concatenate(([START], tokens[:-1, 4])), np.concatenate(([CLASSES] * 2, tokens[:, 2]))[: len(tokens)]
    one[first] = START
    two[first] = CLASSES
    two[first[sizes > 1] + 1] = CLASSES
    return one, two


@dataclass
class Weights:
    """A context predicts the vector R[code before] C1 + S[class two before] C2; a class scores its product with Q, plus b.
    Within a class of several words a leaf scores the product of R[code before] C1 with q, plus a and the log of its share."""

    R: np.ndarray
    S: np.ndarray
    C1: np.ndarray
    C2: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    q: np.ndarray
    a: np.ndarray

    @staticmethod
    def shared() -> list[tuple[int, ...]]:
        """Shapes of what all tasks learn: all but the leaves'."""
        return [(CODES, WIDTH), (CLASSES + 1, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (CLASSES, WIDTH), (CLASSES,)]

    @classmethod
    def start(cls, v: Vocabulary) -> Weights:
        rng = np.random.default_rng(11)
        r, s, q = (rng.normal(0, 0.1, x).astype(np.float32) for x in ((CODES, WIDTH), (CLASSES + 1, WIDTH), (CLASSES, WIDTH)))
        b = np.log(np.maximum(v.class_mass / max(1.0, v.class_mass.sum()), 1e-9)).astype(np.float32)
        leaf = 0.1 * np.random.default_rng(12).standard_normal((len(v.mass), WIDTH), np.float32)
        return cls(r, s, np.eye(WIDTH, dtype=np.float32), 0.5 * np.eye(WIDTH, dtype=np.float32), q, b, leaf, np.zeros(len(v.mass), np.float32))

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.S, self.C1, self.C2, self.Q, self.b)])

    def unpack(self, flat: np.ndarray) -> None:
        at = np.cumsum([0] + [int(np.prod(s)) for s in self.shared()])
        self.R, self.S, self.C1, self.C2, self.Q, self.b = (flat[a:z].reshape(s).astype(np.float32) for a, z, s in zip(at, at[1:], self.shared()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def by_row(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at, and the sums of their rows."""
    order = np.argsort(at, kind="stable" if at.itemsize <= 2 else None)
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return sorted_[first], np.add.reduceat(rows[order], first, axis=0)


def noise_gradients(h: np.ndarray, own_q: np.ndarray, own_b: np.ndarray, own_log: np.ndarray, z_q: np.ndarray, z_b: np.ndarray, z_log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Noise-contrastive estimation: each row of h against its own vector and against all noise vectors z; *_log: log of the noise
    words' number times their probability. The errors (data, noise), and the gradient of h."""
    own = sigmoid((h * own_q).sum(axis=1) + own_b - own_log) - 1
    other = sigmoid(h @ z_q.T + z_b - z_log)
    return own, other, own[:, None] * own_q + other @ z_q


class Trainer:
    """Noise-contrastive estimation with Adagrad, a rate for each row: each token's class against NOISE classes drawn from their
    distribution, and its leaf against one drawn from the same class."""

    def __init__(self, v: Vocabulary, seed: int):
        self.v, self.w, self.rng = v, Weights.start(v), np.random.default_rng(seed)
        p = v.class_mass / max(1.0, v.class_mass.sum())
        self.log_kp, self.cum = np.log(NOISE * np.maximum(p, 1e-9)).astype(np.float32), np.cumsum(p)
        self.leaf_cum = np.concatenate(([0], np.cumsum(v.mass)))
        self.seen = {k: np.full((len(x), 1), 0.1, np.float32) for k, x in vars(self.w).items()}
        self.tokens, self.leaf_n = 0, np.zeros(len(v.mass), np.float32)

    def _move(self, name: str, at: np.ndarray, g: np.ndarray) -> None:
        x, seen = getattr(self.w, name), self.seen[name]
        g = g if x.ndim == 2 else g[:, None]
        seen[at] += (g * g).mean(axis=1, keepdims=True)
        g = RATE * g / np.sqrt(seen[at])
        x[at] -= g if x.ndim == 2 else g[:, 0]

    def learn(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray, leaf: np.ndarray) -> None:
        each = *(x.astype(np.int16) for x in (one, two, kind)), leaf.astype(np.int32)
        for k in range(0, len(kind), BATCH):
            self._step(*(x[k : k + BATCH] for x in each))
        self.tokens += len(kind)

    def _step(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray, leaf: np.ndarray) -> None:
        w = self.w
        z = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1], "right"), CLASSES - 1)
        r, s = w.R[one], w.S[two]
        before = r @ w.C1
        h = before + s @ w.C2
        own, other, dh = noise_gradients(h, w.Q[kind], w.b[kind], self.log_kp[kind], w.Q[z], w.b[z], self.log_kp[z])
        db = dh  # the gradient of `before`, to which leaves add theirs
        many = np.flatnonzero(leaf >= 0)
        if len(many):
            m, l = kind[many] - self.v.first, leaf[many]  # noqa: E741
            low, high = self.leaf_cum[self.v.start[m]], self.leaf_cum[self.v.start[m + 1]]
            n = (np.searchsorted(self.leaf_cum, low + self.rng.random(len(many)) * (high - low), "right") - 1).astype(np.int32)
            x, ql, qn = before[many], w.q[l], w.q[n]
            # one noise word: its share cancels against the leaf's own, which its score begins with
            e1, e2 = sigmoid((x * ql).sum(axis=1) + w.a[l]) - 1, sigmoid((x * qn).sum(axis=1) + w.a[n])
            db = dh.copy()
            db[many] += e1[:, None] * ql + e2[:, None] * qn
            e = np.concatenate((e1, e2)).astype(np.float32)
            rows = np.empty((2 * len(l), WIDTH + 2), np.float32)
            rows[:, WIDTH], rows[: len(l), WIDTH + 1], rows[len(l) :, WIDTH + 1] = e, 1, 0
            np.multiply(e1[:, None], x, out=rows[: len(l), :WIDTH])
            np.multiply(e2[:, None], x, out=rows[len(l) :, :WIDTH])
            at, g = by_row(np.concatenate((l, n)), rows)
            self._move("q", at, g[:, :WIDTH])
            self._move("a", at, g[:, WIDTH])
            self.leaf_n[at] += g[:, WIDTH + 1]
        size = len(one)
        at, g = by_row(kind, np.hstack((own[:, None] * h, own[:, None])))
        dq = np.zeros((CLASSES, WIDTH + 1), np.float32)
        dq[at] = g
        np.add.at(dq, z, np.hstack((other.T @ h, other.sum(axis=0)[:, None])))
        at = np.union1d(at, z)
        c1, c2 = r.T @ db / size, s.T @ dh / size
        dr, ds = by_row(one, db @ w.C1.T), by_row(two, dh @ w.C2.T)
        self._move("Q", at, dq[at, :WIDTH])
        self._move("b", at, dq[at, WIDTH])
        self._move("R", *dr)
        self._move("S", *ds)
        every = np.arange(WIDTH)
        self._move("C1", every, c1)
        self._move("C2", every, c2)

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """What the task has learned, in parts of bounded size: part, places (none: all), and rows of weight and half floats: the
        tokens behind each number or leaf, then the numbers, leaves as q and a."""
        flat = self.w.packed().reshape(-1, 1)
        for k in range(0, len(flat), 32 * BLOCK):
            yield -1 - k // (32 * BLOCK), b"", np.float32(self.tokens).tobytes() + flat[k : k + 32 * BLOCK].astype(np.float16).tobytes()
        seen = np.flatnonzero(self.leaf_n > 0).astype(np.int32)
        for k in np.split(seen, np.flatnonzero(np.diff(seen // BLOCK)) + 1):
            if len(k):
                yield int(k[0]) // BLOCK, k.tobytes(), self.leaf_n[k].tobytes() + np.hstack((self.w.q[k], self.w.a[k, None])).astype(np.float16).tobytes()


class Mean:
    """The mean of a part's rows by tokens, one row after another."""

    def __init__(self, part: int):
        self.part = part
        self.n = np.zeros((1 if part < 0 else BLOCK, 1))
        self.sum = np.zeros((1, 32 * BLOCK) if part < 0 else (BLOCK, WIDTH + 1))

    def add(self, places: bytes, data: bytes) -> None:
        at = np.frombuffer(places, np.int32) - self.part * BLOCK if places else np.zeros(1, np.int64)
        n = np.frombuffer(data, np.float32, len(at))[:, None].astype(np.float64)
        x = np.frombuffer(data, np.float16, offset=4 * len(at)).reshape(len(at), -1)
        self.sum[at, : x.shape[1]] += n * x.astype(np.float64)
        self.n[at] += n
        self.width = x.shape[1]

    def row(self) -> tuple[int, bytes, bytes]:
        at = np.flatnonzero(self.n > 0)
        x = (self.sum[at, : self.width] / self.n[at]).astype(np.float32)
        return self.part, b"" if self.part < 0 else (at + self.part * BLOCK).astype(np.int32).tobytes(), x.tobytes()


def train(texts: DataFrame, v: Vocabulary) -> Weights:
    """Every task trains on all of its tokens from one start; the mean of the tasks' weights by tokens is the model, of a leaf by the
    tokens of it that each task saw. So the model depends on how the texts are dealt to tasks, as any parallel training does.

    Means are taken over sorted streams of parts, one row in hand at a time, so no task and not the driver holds the weights
    of many tasks, however many there are.
    """
    out = Weights.start(v)
    if not v.tokens:
        return out
    shared = texts.sparkSession.sparkContext.broadcast(v)  # HEAD entries
    schema, names = "part long, places binary, data binary", ["part", "places", "data"]

    def batch(rows: Iterable[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, t = Reader(shared.value), None
        for b in pieces(batches, "text", 2 << 20):
            t = t or Trainer(shared.value, TaskContext.get().partitionId())
            tokens, sizes = read(b.column(0))
            t.learn(*contexts(tokens, sizes), tokens[:, 2], tokens[:, 3])
        if t:
            for row in t.parts():
                yield batch([row])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for part, places, data in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.part != part:
                    if now is not None:
                        yield batch([now.row()])
                    now = Mean(part)
                now.add(places, data)
        if now is not None:
            yield batch([now.row()])

    each = mapped(texts.select("text"), run, schema)
    flat = out.packed()
    for r in mapped(each.repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part"), mean, schema).collect():
        x = np.frombuffer(bytes(r["data"]), np.float32)
        if r["part"] < 0:
            at = (-1 - r["part"]) * 32 * BLOCK
            flat[at : at + len(x)] = x
        else:
            at, x = np.frombuffer(bytes(r["places"]), np.int32), x.reshape(-1, WIDTH + 1)
            out.q[at], out.a[at] = x[:, :WIDTH], x[:, WIDTH]
    out.unpack(flat)
    return out


@dataclass
class Model:
    """log10 probabilities as look-ups: classes by first[code, class] + second[class before, class] + bias[class] - norm[code, class
    before]; a leaf by the product of its vector with the code's, plus its bias, less within[class, code]."""

    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    h: np.ndarray
    q: np.ndarray
    leaf_bias: np.ndarray
    within: np.ndarray
    first_many: int

    @classmethod
    def of(cls, w: Weights, v: Vocabulary) -> Model:
        """The model is bilinear in context and word, so all pairs of a context and a class are two products, and the normaliser of
        every context comes from a product of their exponentials; those within classes from products over the leaves, block
        by block. Classes never seen are left out; the end always has a share."""
        h = w.R @ w.C1
        first, second = np.clip(h @ w.Q.T, -40, 40), np.clip(w.S @ w.C2 @ w.Q.T, -40, 40)
        bias = np.where(v.class_mass > 0, w.b, -np.inf).astype(np.float32)
        bias[END] = max(bias[END], -30.0)
        open_ = np.isfinite(bias)
        norm = np.log(np.exp(first[:, open_] + bias[open_]) @ np.exp(second[:, open_]).T)
        log_share = np.log(v.mass) - np.log(np.repeat(np.add.reduceat(v.mass, v.start[:-1]), np.diff(v.start)))
        leaf_bias = (w.a + log_share).astype(np.float32)
        within = np.zeros((v.many, CODES), np.float32)
        for m in range(v.many):
            for k in range(v.start[m], v.start[m + 1], 4096):
                a, z = k, min(k + 4096, v.start[m + 1])
                within[m] += np.exp(np.clip(w.q[a:z] @ h.T, -40, 40) + leaf_bias[a:z, None]).sum(axis=0)
        ten = np.float32(1 / np.log(10))
        scaled = (first * ten, second * ten, bias * ten, norm.astype(np.float32) * ten)
        return cls(*scaled, h, w.q, leaf_bias * ten, np.log(within) * ten, v.first)

    def scores(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each token's class, and where it has one of its leaf."""
        out = (self.first[one, kind] + self.second[two, kind] + self.bias[kind] - self.norm[one, two]).astype(np.float64)
        for a in range(0, len(kind), 16_384):
            k = a + np.flatnonzero(leaf[a : a + 16_384] >= 0)
            c, l = one[k], leaf[k]  # noqa: E741
            x = np.clip(np.einsum("ij,ij->i", self.h[c], self.q[l]), -40, 40) * np.float32(1 / np.log(10))
            out[k] += x + self.leaf_bias[l] - self.within[kind[k] - self.first_many, c]
        return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Tokens are words without ASCII white space, A-Z lower-cased, then one end. Learned from documents outside fold 2 of
    7; null texts are empty texts, which count as such. base_score is exact: every word's count is either among those
    that each task has, or joined. score is the log-bilinear model's log10 probability given two tokens before: of the
    token's class, times that of the word within it. Each of the HEAD most frequent words has a vector of its own there;
    the words of a class beyond them, and those never seen, share one and are drawn by their counts plus one. Repeated
    rows are scored each; with nothing to learn from, counts are 0; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", fold("doc_id", 7) == 2)
    learn = slim.filter("NOT held_out")
    counts = cut(word_counts(learn))
    v = vocabulary_of(counts)
    shared = docs.sparkSession.sparkContext.broadcast((v, Model.of(train(learn, v), v)))
    base = float(np.log10(v.tokens + v.distinct + 1))
    end_n = int(v.class_mass[END])
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, tail array<long>, tail_n array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        read, uid = Reader(v, end_n), TaskContext.get().partitionId() << 36
        last = np.zeros(len(v.mass), bool)
        last[v.start[1:] - 1] = True
        for b in pieces(batches, "text", 2 << 20):
            tokens, sizes = read(b.column(1))
            h, n, kind, leaf, _ = tokens.T
            first = np.cumsum(sizes) - sizes

            def each(x: np.ndarray) -> np.ndarray:
                return np.add.reduceat(x, first)

            one, two = contexts(tokens, sizes)
            logs = np.log10(np.maximum(n, 0) + 1.0)
            scores = model.scores(one, two, kind, leaf)
            beyond = np.flatnonzero(last[leaf] & (leaf >= 0))
            scores[beyond] -= np.log10(v.mass[leaf[beyond]])  # what a word has of its leaf is joined
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tail = np.flatnonzero(n < 0)
            order = tail[np.lexsort((h[tail], doc[tail]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            at = np.flatnonzero(new)
            times = np.diff(at, append=len(order))
            offsets = np.searchsorted(doc[order[at]], np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[order[at]], times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(sizes))), b.column(0), b.column(2), pa.array(sizes), pa.array(each((n > 0).astype(np.int64))), pa.array(each(logs)),
                    pa.array(each(scores)), *lists,
                ],
                names,
            )
            uid += len(sizes)

    scored = cut(mapped(slim.select("doc_id", "text", "held_out"), run, schema))
    rare = scored.select("uid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("uid", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("times"))
    joined = (
        rare.join(counts, "h")  # words never seen in training add nothing
        .groupBy("uid")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum("times").alias("rare_known"))
    )
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(joined, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
