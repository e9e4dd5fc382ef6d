"""Encoders against their libraries, and back."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexforge.functions import encode
from lexforge.plans import more

TEXTS = ["Hello world, it's 2024!", "", None, "größer — été", "  two  spaces\n", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_encode_and_decode(spark, name):
    path = public_tokenizers.path(name)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)
    rows = df.withColumn("ids", encode.encode(path)("t")).withColumn("n", encode.count(path)("t")).withColumn("back", encode.decode(path)("ids")).orderBy("i").collect()
    expected = encode.loaded(path)[0]([t or "" for t in TEXTS])
    assert [r["ids"] for r in rows] == expected and [r["n"] for r in rows] == [len(x) for x in expected]
    if not name.endswith(".model"):
        assert [r["back"] for r in rows] == [t or "" for t in TEXTS]


def test_two_files_of_one_vocabulary_agree():
    a, b = (encode.loaded(public_tokenizers.path(x))[0](["Some text, 12 words."])[0] for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    assert a == b


def test_query(spark):
    from lexforge.operators import corpus
    from lexforge.plans.common import documents

    sf = "/root/testdata/sf0.001"
    texts = {r["seq"]: r["text"] for r in corpus.cleaned(documents(spark, sf)).collect()}
    to_ids = encode.loaded(public_tokenizers.path(more.VOCABULARY))[0]
    for r in more.bpe_encode(spark, sf).collect():
        ids = to_ids([texts[r["seq"]]])[0]
        assert (r["chars"], r["tokens"], r["ids_crc32"]) == (len(texts[r["seq"]]), len(ids), zlib.crc32(",".join(map(str, ids)).encode()))
