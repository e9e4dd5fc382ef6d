"""Pluggable subword encoders as Arrow functions: one tokenizer for each worker, whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@cache
def loaded(path: str) -> tuple[Callable, Callable, Callable]:
    """(encode a list of texts, decode a list of ids, piece of an id) by the file's kind: .json (tokenizers), .tiktoken (ranks; the
    pattern is that of byte-level vocabularies) or .model (sentencepiece)."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)], t.decode_batch, t.id_to_token
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda xs: [t.encode_ordinary(x) for x in xs], lambda xs: [t.decode(x) for x in xs], lambda i: t.decode_single_token_bytes(i).decode("utf-8", "replace")
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda xs: s.encode(list(xs), num_threads=1), lambda xs: [s.decode(list(x)) for x in xs], s.id_to_piece


#: Characters that are encoded together: what the encoder keeps of a text is many times as large.
SLICE_CHARS = 1 << 20


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of `most` characters about, one text at least."""
    out, n = [], 0
    for x in texts:
        if out and n + len(x) > most:
            yield out
            out, n = [], 0
        out.append(x)
        n += len(x)
    if out:
        yield out


def encode(path: str):
    """A function of a text column: array<int>; null texts have no ids."""

    @F.pandas_udf("array<int>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to_ids = loaded(path)[0]
        for b in batches:
            yield pd.Series([np.array(i, np.int32) for x in slices(b.fillna("").tolist()) for i in to_ids(x)], dtype="object")

    return f


def decode(path: str):
    """A function of an array<int> column: string."""

    @F.pandas_udf("string")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to_text = loaded(path)[1]
        for b in batches:
            yield pd.Series(to_text([list(map(int, x)) for x in b]), dtype="object")

    return f


def count(path: str):
    """A function of a text column: its number of ids."""

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to_ids = loaded(path)[0]
        for b in batches:
            yield pd.Series([len(i) for x in slices(b.fillna("").tolist()) for i in to_ids(x)], dtype="int64")

    return f


def prefix(path: str, most: int):
    """A function of a text column: the text itself if it has `most` ids at most, else what its first `most` ids stand for."""

    @F.pandas_udf("string")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to_ids, to_text, _ = loaded(path)
        for b in batches:
            each = ((x, i) for part in slices(b.fillna("").tolist()) for x, i in zip(part, to_ids(part)))
            yield pd.Series([x if len(i) <= most else to_text([list(map(int, i[: max(0, most)]))])[0] for x, i in each], dtype="object")

    return f


def encoded_by(encode: Callable[[list[str]], list[list[int]]], most: int | None = None):
    """The same as encode() by a function of the caller's own: texts -> ids. An id that is negative or over `most` fails."""

    @F.pandas_udf("array<int>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            ids = encode(b.fillna("").tolist())
            if any(i < 0 or (most is not None and i > most) for x in ids for i in x):
                raise ValueError("an id is out of range")
            yield pd.Series(ids)

    return f
