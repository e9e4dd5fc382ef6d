"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import cut, fold, mapped, pieces, utf8

#: Longest context in bytes.
ORDER = 3
#: Training documents of each language, drawn by a hash; the bound of the sample the classifier is fitted on.
DOCUMENTS = 4_000
#: Counted (context, byte) pairs that go to the driver as columns of numbers, about 24 bytes each: shared evenly by the
#: languages, but LEAST for each.
PAIRS, LEAST = 1_500_000, 20_000
#: Bytes of the tables of code lengths for contexts of two and three bytes, and of a whole model, which every executor holds.
#: Contexts of none and one byte, and the way from three bytes to a row, are in the latter; languages beyond it are an error.
TABLE, WHOLE = 64 << 20, 256 << 20
NONE = "und"


def lowered(text: bytes) -> bytes:
    """Lower-cased UTF-8 without the zero byte, which marks a text's start."""
    return text.decode("utf-8", "replace").lower().encode().replace(b"\0", b" ")


def counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang) -> (lang, gram, n): occurrences of each four bytes, three zero bytes before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(b"\0\0\0" + lowered(text))
            for lang, texts in by.items():
                x = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
                gram = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
                gram, n = np.unique(gram[x[3:] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    return mapped(docs.select("text", "lang"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Code lengths by context. state: three symbols -> row; bits: (row * symbols + symbol) -> bits for each language."""

    langs: list[str]
    symbol: bytes  # byte -> symbol; 0 is the start, 1 any byte without a symbol of its own
    n: int
    state: np.ndarray
    bits: np.ndarray
    usual: np.ndarray  # of each language, bits that a byte of its own training texts costs


def model_of(rows: pa.Table | list[tuple[str, int, int]]) -> Model | None:
    """Context trees of orders 0 to 3 for each language, and from them the bits of every symbol in every context.

    Escapes by method C with exclusion: in a context with n occurrences of q different symbols, an unseen one costs the
    share q / (n + q), and the shorter context leaves out what the longer one has seen. A context that a language never
    saw passes to the next shorter one at no cost; below order 0 all symbols are equal.
    """
    if not len(rows):
        return None
    if not isinstance(rows, pa.Table):
        rows = pa.table({"lang": pa.array([r[0] for r in rows]), "gram": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())})
    langs = sorted(rows.column("lang").unique().to_pylist())
    lang = pc.index_in(rows.column("lang"), pa.array(langs)).to_numpy().astype(np.int64)
    gram, times = rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((gram, lang))  # sums don't depend on how rows came
    lang, gram, times = lang[order], gram[order], times[order]
    seen = np.bincount(gram & 255, times, 256)
    order = [int(b) for b in np.argsort(-seen, kind="stable") if seen[b] and b]  # UTF-8 has 243 different bytes
    table = np.ones(256, np.uint8)
    table[0] = 0
    table[order] = np.arange(2, len(order) + 2)
    n = len(order) + 2
    s = [table[(gram >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
    c3, c2, c1 = (s[0] * n + s[1]) * n + s[2], s[1] * n + s[2], s[2]

    def most_used(context: np.ndarray, most: int) -> np.ndarray:
        """The contexts that have tables, sorted: those that occur most."""
        each, total = np.unique(context, return_inverse=True)
        return np.sort(each[np.argsort(-np.bincount(total, times), kind="stable")[:most]])

    rest = WHOLE - 4 * n**3 - 4 * n * (n + 1) * len(langs)
    if rest < 0:
        raise ValueError(f"{len(langs)} languages of {n} symbols take {WHOLE - rest} bytes, over the {WHOLE} of a model: learn fewer at a time")
    most = min(TABLE, rest) // (4 * n * len(langs))
    two = most_used(c2, most)
    own = most_used(c3, max(0, most - len(two)))
    k3, k2 = len(own), len(two)
    rows_n = k3 + k2 + n + 1
    context = [  # of each row, by order; -1 where the row has no context of that order
        np.concatenate((own, np.full(k2 + n + 1, -1))),
        np.concatenate((own % (n * n), two, np.full(n + 1, -1))),  # a three-byte context goes on to its two last bytes
        np.concatenate((own % n, two % n, np.arange(n), [-1])),
    ]
    state = np.full(n**3, rows_n - 1, np.int32)
    shaped = state.reshape(n, n, n)
    shaped[:] = k3 + k2 + np.arange(n)
    state.reshape(n, n * n)[:, two] = k3 + np.arange(k2)
    state[own] = np.arange(k3)

    def occurrences(context: np.ndarray, keys: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """(rows, symbols): how often each symbol followed each row's context."""
        uniq, where = np.unique(keys[mine], return_inverse=True)
        flat = np.bincount(where * n + s[3][mine], times[mine], len(uniq) * n).reshape(-1, n)
        at = np.minimum(np.searchsorted(uniq, context), len(uniq) - 1)
        return np.where((uniq[at] == context)[:, None], flat[at], 0)

    bits = np.empty((rows_n, n, len(langs)), np.float32)
    for k in range(len(langs)):
        mine = np.flatnonzero(lang == k)
        p, mass, out = np.zeros((rows_n, n)), np.ones((rows_n, 1)), np.zeros((rows_n, n), bool)
        out[:, 0] = True  # nothing codes a start
        levels = [occurrences(c, keys, mine) for c, keys in zip(context, (c3, c2, c1))]
        levels.append(np.broadcast_to(np.bincount(s[3][mine], times[mine], n), (rows_n, n)))
        for c in levels:
            left = np.where(out, 0, c)
            new = (left > 0).sum(axis=1, keepdims=True)
            whole = left.sum(axis=1, keepdims=True) + new
            p += mass * left / np.maximum(whole, 1)
            mass = np.where(whole > 0, mass * new / np.maximum(whole, 1), mass)
            out = out | (c > 0)
        rest = (~out).sum(axis=1, keepdims=True)
        p += np.where(out, 0, mass / np.maximum(rest, 1))
        bits[:, :, k] = -np.log2(np.maximum(p, 1e-12))
    bits[:, 1, :] += np.log2(max(1, 256 - len(order)))
    bits = bits.reshape(rows_n * n, len(langs))
    row = state[c3].astype(np.int64) * n + s[3]
    usual = np.array([times[m] @ bits[row[m], k] / max(1.0, times[m].sum()) for k in range(len(langs)) for m in [lang == k]])
    return Model(langs, table.tobytes(), n, state, bits, usual)


def code_lengths(model: Model, texts: list[bytes], window: int | None = None) -> np.ndarray:
    """(texts, languages): bits of each whole text, `window` bytes at a time: by default 8 MB of them for all languages."""
    window = window or max(1024, (1 << 21) // len(model.langs))
    out = np.zeros((len(texts), len(model.langs)))
    flat = b"".join([b"\0\0\0" + x for x in texts])
    starts = np.cumsum([0] + [len(x) + 3 for x in texts])[:-1]
    s = np.frombuffer(flat.translate(model.symbol), np.uint8).astype(np.int32)
    for a in range(3, len(s), window):
        z = min(len(s), a + window)
        now = s[a:z]
        row = model.state[(s[a - 3 : z - 3] * model.n + s[a - 2 : z - 2]) * model.n + s[a - 1 : z - 1]] * model.n + now
        bits = model.bits[row]
        bits[now == 0] = 0  # the marks between texts
        first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        last = int(np.searchsorted(starts, z, "left"))
        at = np.maximum(starts[first:last] - a, 0)
        out[first:last] += np.add.reduceat(bits, at, axis=0, dtype=np.float64)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", most: int = DOCUMENTS) -> Model | None:
    """Learns from text and lang of docs outside fold 1 of 3, from about `most` documents of each language at most."""
    train = docs.filter(f"text IS NOT NULL AND lang IS NOT NULL AND lang <> '{NONE}'").filter(fold(id_col, 3) != 1)
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.select(F.col("lang").alias("__lang"), (F.lit(float(most)) / F.col("n")).alias("__share"))
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("lang")), 11) / float(1 << 53)
    drawn = train.join(F.broadcast(share), F.col("lang") == F.col("__lang")).filter(u < F.col("__share"))  # a row for each language
    each = cut(counts(drawn))
    return model_of(most_of_each(each).select("lang", "gram", "n").toArrow())


def most_of_each(each: DataFrame, most: int | None = None) -> DataFrame:
    """each (lang, gram, n) -> of every language its grams of the highest counts, about as many as its even share of PAIRS allows
    and LEAST at any rate; what a language has is independent of how much others have. Of the count that is reached last,
    grams are taken by a hash."""
    langs = each.select("lang").distinct().count()
    most = most or max(LEAST, PAIRS // max(1, langs))
    levels = each.groupBy("lang", "n").agg(F.count("*").alias("grams"))
    before = F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each count
    open_ = levels.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most)
    last = open_.groupBy("lang").agg(F.min_by(F.struct("n", ((most - F.col("before")) / F.col("grams")).alias("share")), "n").alias("last"))
    u = F.shiftrightunsigned(F.xxhash64("lang", "gram"), 11) / float(1 << 53)
    return each.join(F.broadcast(last), "lang").filter((F.col("n") > F.col("last.n")) | ((F.col("n") == F.col("last.n")) & (u < F.col("last.share")))).drop("last")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text)


def predicted(docs: DataFrame, model: Model | None, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns `keep` of docs, with lang_pred, score, bits_per_byte (of the language predicted) and cost: these bits over
    what is usual in that language."""
    schema = docs.select(*keep).schema
    names = [prefix + x for x in ("lang_pred", "score", "bits_per_byte", "cost")]
    for x, kind in zip(names, ("string", "double", "double", "double")):
        schema = schema.add(x, kind)
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = source.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WHOLE bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, "text", 2 << 20):
            texts = [lowered(x) for x in utf8(b.column(at))]
            lang, score, each, cost = [NONE] * len(texts), *([0.0] * len(texts) for _ in range(3))
            if m is not None:
                bits = code_lengths(m, texts)
                best = bits.argmin(axis=1)
                p = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for k, text in enumerate(texts):
                    if has_letter(text.decode()):
                        lang[k], score[k], each[k] = m.langs[best[k]], float(p[k]), float(bits[k, best[k]]) / len(text)
                        cost[k] = each[k] / max(float(m.usual[best[k]]), 0.01)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, (lang, score, each, cost))], [*keep, *names])

    return mapped(source, run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score, bits_per_byte, cost), a row for each row.

    score is the posterior of the language predicted, all languages being equally likely before. Null texts and texts
    without a letter are `und` with score 0, as is every text if nothing can be learned; repeated rows are predicted
    each; an empty table gives no rows. Texts of unseen bytes still get the language that codes them shortest.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    return predicted(slim, fit(slim), ["doc_id", "held_out"])


def recognised(docs: DataFrame, least: float = 0.5, dearest: float = 2.5) -> DataFrame:
    """The documents whose language is recognised with a posterior of `least` or more, with the columns of docs. Null texts and
    those without a letter go; repeated rows are judged each; an empty table, or one without a language, gives no rows.

    The posterior only weighs the learned languages against each other; a text in none of them, or in no language, shows by
    a byte costing over `dearest` times what is usual in the language that fits it best.
    """
    p = "__lang_"
    kept = predicted(docs, fit(docs), docs.columns, p).filter((F.col(f"{p}lang_pred") != NONE) & (F.col(f"{p}score") >= least) & (F.col(f"{p}cost") <= dearest))
    return kept.select(*docs.columns)
