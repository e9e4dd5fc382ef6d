import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SPARE, prose  # noqa: E402

@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): prose, copies, near copies, license lines, repeats, odd texts and nulls."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(5, 160)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c"])) for i in range(60)]
    out += [(60 + k, out[3][1], "en", "a") for k in range(25)]  # exact copies
    long_text = prose(rng, 300)
    for k in range(25):  # near copies
        words = long_text.split()
        words[rng.randrange(300)] = f"x{k}"
        out.append((90 + k, " ".join(words), "en", "a"))
    out += [
        (120, "Released Under the MIT License. " + prose(rng, 30), "en", "b"),
        (121, "Apache License, Version 2.0 and CC BY-NC 4.0", "en", "b"),
        (122, "under the mit license under the mit license", None, "b"),
        (123, "Same line here\n" * 40, "en", "c"),
        (124, "WORD!! " * 80, "de", "c"),
        (125, "a*** b### c$$$ " * 30, "de", None),
        (126, "", "en", "a"),
        (127, None, "en", "a"),
        (128, " \t\n\x0b\x0c\r ", None, "b"),
        (129, "12345 678", "en", "b"),
        (130, " ".join(SPARE) + " nbsp　wide \x1cfs", None, None),
        (131, "one two three", "en", "a"),
        (132, "x" * 30_000, "en", "a"),
        (133, prose(rng, 9_000), "en", "a"),
        (134, "<|endoftext|> it's 2024 <|startoftext|>ÀÉÎ ǅ İ Σας", "en", "a"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, one of them twice, with columns whose names clash with those that operators use."""
    clash = "score double, kept boolean, labels string, n_words int, fp long, part int, rank int, component_id long, key string, h long, uid long, lang_pred string, n_chars long"
    extra = (0.5, True, "x", 1, 1, 1, 1, 1, "k", 1, 1, "zz", None)
    return spark.createDataFrame([(*r, *extra) for r in [*rows, rows[7]]], f"doc_id long, text string, lang string, source string, {clash}").repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
