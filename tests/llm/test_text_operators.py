"""Licenses, quality rules, language, quality, language-model scores and decontamination."""

import math
from collections import Counter
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import plain
from fixtures import prose
from lexforge.llm import decontaminate, hostrules, langid, lbl, licenses, nbsvm


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


# --- licenses --------------------------------------------------------------------------------------------------------


def test_phrases_are_found_everywhere(docs, rows):
    got = by_id(licenses.licenses(docs))
    assert len(got[rows[7][0]]) == 2
    for doc, text, *_ in rows:
        for r in got[doc]:
            first, last = r["first_word"], r["last_word"]
            assert (r["n_words"], r["n_base"], first, last, r["base_labels"]) == plain.licenses(text), doc
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def labels_of(text):
    flat = b" ".join(text.encode().translate(licenses.WORDS).split())
    return [d.label for d in licenses.scan(flat)]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU GPL v3 or later.", ["gpl-3.0"]),
        ("Licensed under the Apache License, Version 2.0", ["apache-2"]),
        ("licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]),
        ("Distributed under the BSD 3-Clause License; see also the MIT license.", ["bsd-3-clause", "mit"]),
        ("SPDX-License-Identifier: MIT", ["mit"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("er kam mit der Bahn", []),
        ("the summit licensed nothing", []),
    ],
)
def test_rules(text, labels):
    assert labels_of(text) == labels


def test_there_are_hundreds_of_rules_and_each_is_gated_by_its_own_words():
    found = licenses.rules()
    assert len(found) > 300 and [r.priority for r in found] == sorted((r.priority for r in found), reverse=True)


def spelled(parsed):
    """Strings of a parsed regex: every alternative, each repeat at its least and once more, of ranges the first."""
    out = [""]
    for kind, x in parsed:
        name = str(kind)
        if name == "LITERAL":
            ways = [chr(x)]
        elif name == "IN":
            ways = [chr(y[0] if str(k) == "RANGE" else y) for k, y in x]
        elif name == "SUBPATTERN":
            ways = spelled(x[-1])
        elif name == "BRANCH":
            ways = [w for y in x[1] for w in spelled(y)]
        elif name == "MAX_REPEAT":
            ways = [w * n for n in {x[0], min(x[0] + 1, x[1])} for w in spelled(x[2])]
        else:
            assert name == "ASSERT_NOT"
            ways = [""]
        out = [a + b for a in out for b in dict.fromkeys(ways)]
    return out


def test_every_alternative_of_a_rule_contains_its_keywords():
    pairs = [line.split(" | ", 2)[1:] for line in (licenses.NAMES.strip() + licenses.SENTENCES.rstrip()).split("\n")]
    pairs += [(word, frame.format("x")) for frame, words, *_ in licenses.FRAMES for word in words]
    for keyword, regex in pairs:
        assert all(keyword in text for text in spelled(re._parser.parse(regex))), (keyword, regex)


@pytest.mark.parametrize(
    "text, labels",
    [(f"SPDX-License-Identifier: {x}", [x.lower()]) for x in ("MS-PL", "MS-RL", "OSL-3.0", "AFL-3.0", "BUSL-1.1")]
    + [("SPDX-License-Identifier: BSL-1.0", ["boost-1.0"]), ("MIT No Attribution License", ["mit-0"]), ("under the Open RAIL-M license", ["openrail"]), ("For personal use only.", ["no-commercial-use"]), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", ["isc"])],
)
def test_short_names_stand_alone(text, labels):
    assert labels_of(text) == labels


def test_the_prefilter_changes_nothing():
    rng = random.Random(1)
    parts = ["licensed under", "the gnu gpl v2", "mit license", "cc by sa 4 0", "apache license version 2 0", "all rights reserved", "bsd 2 clause license", "some words", "public domain", "spdx license identifier isc"]
    for _ in range(60):
        flat = " ".join(rng.choice(parts) for _ in range(8)).encode()
        full = [licenses.Detection(r.label, m.start(), m.end(), r.priority, r.confidence) for r in licenses.rules() for m in r.pattern.finditer(flat)]
        assert licenses.scan(flat) == licenses.resolved(full)


def test_contained_detections_are_suppressed():
    d = licenses.Detection
    outer, inner, other = d("a", 0, 30, 3, 0.9), d("b", 5, 10, 2, 0.8), d("c", 25, 40, 2, 0.8)
    assert licenses.resolved([inner, other, outer]) == [outer, other]


def test_resolution_is_that_of_all_pairs():
    rng = random.Random(8)
    for n in (0, 1, 5, 40, 200):
        found = [licenses.Detection(rng.choice("abc"), a := rng.randrange(60), a + rng.randrange(1, 20), rng.randrange(1, 4), 0.5) for _ in range(n)]
        order = sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label))
        expected = [d for k, d in enumerate(order) if not any(e.start <= d.start and d.end <= e.end for e in order[:k])]
        assert licenses.resolved(found) == sorted(expected, key=lambda d: (d.start, d.end, d.label))


def test_very_many_detections_in_one_text(spark):
    import time

    df = spark.createDataFrame([(1, "mit license x " * 100_000)], "doc_id long, text string")
    t = time.time()
    r = licenses.licenses(df).first()
    assert (r["n_words"], r["labels"], len(r["detections"]), r["detections"][-1]["word"]) == (300_000, "mit", 100_000, 299_997) and time.time() - t < 60


@pytest.mark.parametrize(
    "text, label",
    [("GNU General Public License version 2", "gpl-2.0"), ("GNU Lesser General Public License, version 2.1 or later", "lgpl-2.1"), ("the Mozilla Public License v 1.1", "mpl-1.1"), ("under the Universal Permissive License", "upl-1.0"), ("may not be used to train machine learning models", "no-ai-training")],
)
def test_long_names_have_their_version(text, label):
    assert labels_of(text) == [label]


# --- quality rules ----------------------------------------------------------------------------------------------------


def test_counts_and_base_rules(docs, rows):
    got = by_id(hostrules.quality_rules(docs))
    for doc, text, *_ in rows:
        for r in got[doc]:
            assert tuple(r[c] for c in hostrules.STATS) == (e := plain.rules(text)), doc
            assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
            assert not (r["base_failed"] and r["kept"])
    assert sum(map(len, got.values())) == len(rows) + 1


def test_a_failing_host_takes_its_doubtful_documents_along(spark):
    rng = random.Random(2)
    bad = [(i, "w$1 " * 60 if i % 10 else prose(rng, 100), "bad") for i in range(200)]
    mild = " ".join(f"w{k}" + "$" * (k % 4 == 0) for k in range(100))
    good = [(1000 + i, prose(rng, 100), f"host{i % 7}") for i in range(300)]
    docs = spark.createDataFrame([*bad, (5000, mild, "bad"), (5001, mild, "host1"), *good], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in hostrules.quality_rules(docs).collect()}
    assert not got[5000] and got[5001] and got[0] and all(got[i] for i, *_ in good)


def test_priors():
    a, b = hostrules.beta_prior([1000] * 50, [100] * 50)
    assert a / (a + b) == pytest.approx(0.1) and a + b > 1000  # hosts alike: heavy shrinkage
    a, b = hostrules.beta_prior([1000] * 50, [0, 900] * 25)
    assert a + b < 10


def test_stage_keeps_columns_and_clean_documents(docs, rows):
    out = hostrules.passing(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in hostrules.quality_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept


# --- language ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    words = {"en": "the ship came with thought through weather", "de": "das schiff kam mit gedanken durch wetter", "fr": "le bateau avec pensée à travers été où"}
    rows = [(i, prose(rng, rng.randrange(3, 40), words[x].split()), x if i % 11 else None, x) for i in range(240) for x in [list(words)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_languages(languages):
    got = languages.join(langid.languages(languages), "doc_id").collect()
    assert len(got) == 240
    assert sum(r["lang_pred"] == r["truth"] for r in got) >= 236
    assert all(r["held_out"] == (plain.fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(languages):
    wrong = languages.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert "xx" not in {r["lang_pred"] for r in langid.languages(wrong).select("lang_pred").distinct().collect()}


def test_texts_without_letters_are_undetermined(docs):
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (126, 127, 128, 129))
    assert got[131]["lang_pred"] in ("en", "de")


def test_nothing_to_learn_from(docs):
    got = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_texts_in_no_learned_language_are_not_recognised(languages, spark):
    odd = ["Съешь же ещё этих мягких французских булок да выпей чаю", "qzxkvj wvqpx jjkzqx xvzqk qqwxz kxjvz pzqxj", "東京都で雨が降っています今日は"]
    df = languages.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + k, x * 3, None) for k, x in enumerate(odd)], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in langid.recognised(df).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 236


def test_many_languages_and_scripts_keep_contexts_of_their_own(spark, monkeypatch):
    """Each language has letters of its own; the rare ones have two documents to learn from, the common one hundreds."""
    monkeypatch.setattr(langid, "PAIRS", 1000)
    monkeypatch.setattr(langid, "LEAST", 400)
    monkeypatch.setattr(langid, "TABLE", 32 << 20)
    rng, rows = random.Random(2), []
    letters = [[chr(a + k) for k in range(5)] for a in range(0x4E00, 0x4E00 + 8 * 150, 8)]  # no upper case
    for n, own in enumerate(letters):
        for _ in range(400 if n == 0 else 12):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(8)), f"l{n:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = df.join(langid.languages(df), "doc_id").filter("held_out").collect()
    assert len({r["lang_pred"] for r in got}) > 140
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def plain_ppm(texts, text, order=3):
    """Code length of the text by method C with exclusion, from contexts of the texts, over their bytes and one symbol for all others."""
    from collections import Counter, defaultdict

    tree, symbols = defaultdict(Counter), set()
    for t in texts:
        padded = b"\0" * order + t
        symbols |= set(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                tree[padded[i - k : i]][padded[i]] += 1
    padded, bits = b"\0" * order + text, 0.0
    for i in range(order, len(padded)):
        s, out, p = padded[i], set(), 1.0
        for k in range(order, -1, -1):
            seen = tree.get(padded[i - k : i])
            if seen is None:
                continue
            left = {x: n for x, n in seen.items() if x not in out}
            whole = sum(left.values()) + len(left)
            if s in left:
                p *= left[s] / whole
                break
            if whole:
                p *= len(left) / whole
            out |= set(seen)
        else:
            rest = len(symbols) + 1 - len(out)
            p *= 1 / rest / (1 if s in symbols else 256 - len(symbols))
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_those_of_the_tree():
    texts = [b"the cat sat on the mat", b"then the rat ate", b"a tent"]
    grams = {}
    for t in texts:
        p = b"\0\0\0" + t
        for i in range(3, len(p)):
            g = int.from_bytes(p[i - 3 : i + 1], "big")
            grams[g] = grams.get(g, 0) + 1
    model = langid.model_of([("en", g, n) for g, n in grams.items()])
    asked = [b"the tent", b"zebra the mat", b"", b"tttt", b"at once!"]
    got = langid.code_lengths(model, asked, window=5)[:, 0]
    for text, bits in zip(asked, got):
        assert bits == pytest.approx(plain_ppm(texts, text), rel=1e-4, abs=1e-4), text


def test_a_model_of_a_thousand_languages_keeps_to_its_bound():
    """Grams of five scripts in a thousand languages: the tables that executors hold are counted whole; more is an error."""
    import pickle

    rng = random.Random(4)
    scripts = [range(0x61, 0x7B), range(0x430, 0x450), range(0x5D0, 0x5EB), range(0x904, 0x93A), range(0x4E00, 0x4F00)]
    rows = []
    for k in range(1_000):
        raw = b"\0\0\0" + "".join(chr(rng.choice(scripts[k % 5])) + " " * (rng.random() < 0.2) for _ in range(60)).encode()
        grams = Counter(int.from_bytes(raw[i - 3 : i + 1], "big") for i in range(3, len(raw)))
        rows += [(f"l{k:04d}", g, n) for g, n in grams.items()]
    model = langid.model_of(rows)
    size = len(pickle.dumps(model))
    assert len(model.langs) == 1_000 and 4 * model.n**2 * 1_000 < size <= langid.WHOLE + (1 << 20)
    some = [f"{chr(0x430)}{chr(0x431)} {chr(0x430)}".encode()]
    assert langid.code_lengths(model, some).shape == (1, 1_000)
    with pytest.raises(ValueError, match="fewer at a time"):
        langid.model_of([(f"l{k}", (a << 8) | b, 1) for k in range(1_200) for a, b in [(k % 230 + 10, k * 7 % 230 + 10)]])


# --- quality classifier -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        good = i % 4 > 0
        text = prose(rng, rng.randrange(20, 90))
        rows.append((i, text if good else rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), "spam " * 50]), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, None, 0), (900, 7, 0)], "doc_id long, quality int, toxic int")


def test_labels_beyond_a_broadcast_give_the_same_scores(marked, monkeypatch):
    docs, labels = marked
    scores = lambda: {r["doc_id"]: round(r["score"], 9) for r in nbsvm.quality(docs, labels).collect()}
    few = scores()
    monkeypatch.setattr(nbsvm, "BROADCAST_LABELS", -1)
    assert scores() == few and len(set(few.values())) > 10


def test_quality_of_held_out_documents(marked):
    docs, labels = marked
    got = {r["doc_id"]: r for r in nbsvm.quality(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("quality IN (0, 1)").collect()}
    held = [i for i in truth if plain.fold(i, 5) == 0]
    assert len(got) == 402 and all(got[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_used(marked):
    docs, labels = marked
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in nbsvm.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_without_labels_every_score_is_even(marked):
    docs, labels = marked
    assert {r["score"] for r in nbsvm.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_descent_separates():
    import numpy as np

    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1, 1, -1, -1])
    w = nbsvm.descend(rows, y, np.array([1.0, -1.0, 0.1, -0.1]), epochs=50)
    ratio = np.array([1.0, -1.0, 0.1, -0.1])
    assert all(y[i] * ((w[r] * ratio[r]).sum() / np.linalg.norm(ratio[r]) + w[-1]) > 0.9 for i, r in enumerate(rows))


def test_counts_and_ratios_are_the_plain_ones(marked):
    docs, labels = marked
    quality = {r["doc_id"]: r["quality"] for r in labels.filter("quality IN (0, 1)").collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect() if r["doc_id"] in quality and plain.fold(r["doc_id"], 5)}
    n = {0: Counter(), 1: Counter()}
    for i, text in texts.items():
        n[quality[i]].update(nbsvm.slots_of(text).tolist())
    total = {y: sum(n[y].values()) + nbsvm.SLOTS for y in n}
    for bound in (nbsvm.BROADCAST_LABELS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(nbsvm, "BROADCAST_LABELS", bound)
            model = nbsvm.fit(docs, labels)
        for slot in {*n[0], *n[1], 17}:
            assert model.ratio[slot] == pytest.approx(math.log((n[1][slot] + 1) / total[1]) - math.log((n[0][slot] + 1) / total[0]))


def test_descent_reaches_the_least_objective():
    """The dual of the hinge loss by projected gradients on the whole kernel, against coordinate descent."""
    import numpy as np

    rng = np.random.default_rng(4)
    ratio = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.4, 1, -1)
    x = np.zeros((40, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 30] = 1
    most = np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))
    w = nbsvm.descend(rows, y, ratio, epochs=400)

    def objective(w):
        return 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()

    alpha, q = np.zeros(40), (x * y[:, None]) @ (x * y[:, None]).T
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    best = (alpha * y) @ x
    assert objective(w) == pytest.approx(objective(best), rel=1e-3)


def test_a_sample_of_long_texts_is_thinned_by_its_hash():
    rng = random.Random(1)
    rows = [(k, k % 2, b"x" * rng.choice([4, 4000]), rng.random()) for k in range(500)]
    kept = nbsvm.bounded(rows, 200_000)
    below = max(r[3] for r in kept)
    assert 0 < sum(len(r[2]) for r in kept) <= 200_000 and kept == sorted(r for r in rows if r[3] <= below)
    assert nbsvm.bounded(rows, 1 << 30) == sorted(rows)


# --- language-model scores ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [200_000, 5])
def test_unigram_scores_are_exact(docs, rows, monkeypatch, head):
    monkeypatch.setattr(lbl, "HEAD", head)  # with few words at hand, the others are joined
    every = [*rows, rows[7]]
    expected = {}
    for (i, *_), e in zip(every, plain.unigrams([(r[0], r[1]) for r in every])):
        expected[i] = e
    got = lbl.lm_scores(docs).collect()
    assert len(got) == len(every)
    for r in got:
        n, known, total, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total), r["doc_id"]
        assert r["base_score"] == pytest.approx(score, abs=1e-6) and r["held_out"] == (plain.fold(r["doc_id"], 7) == 2)
        assert -1e9 < r["score"] <= 0


def test_model_learns_order(spark):
    text = "red green blue " * 30
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(100, "red green blue red green blue"), (101, "blue green red blue green red")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lbl.lm_scores(df).collect()}
    assert got[100]["score"] > got[101]["score"] and got[100]["score"] > got[100]["base_score"]


def test_rare_words_have_probabilities_of_their_own(spark):
    rng = random.Random(4)
    common = " ".join(f"c{k}" for k in range(600)) + " "  # more words than are named, each more often than the rest
    pairs = [(f"left{k}", f"right{k}") for k in range(8)]
    rows = [(i, common * 12 + " ".join(" ".join(rng.choice(pairs)) for _ in range(85))) for i in range(60)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], " ".join(f"{a} {b}" for a, b in pairs)), (held[1], " ".join(f"{a} {pairs[k - 1][1]}" for k, (a, _) in enumerate(pairs)))]
    got = {r["doc_id"]: r for r in lbl.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.5


@pytest.fixture(scope="module")
def learned(spark):
    """A vocabulary with words of their own, words of classes and words beyond the head, and a model trained on its texts."""
    rng = random.Random(3)
    words = [f"{w}{e}" for w in "ab cd ef gh ij kl mn op qr st uv wx".split() for e in "ing ed ly er est ion al us".split() * 3 for w in [w + str(rng.randrange(40))]]
    texts = [" ".join(rng.choice(words[: rng.randrange(5, len(words))]) for _ in range(200)) for _ in range(150)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lbl, "HEAD", 160)
        v = lbl.vocabulary_of(lbl.word_counts(spark.createDataFrame([(x,) for x in texts], "text string")))
    import pyarrow as pa

    read, trainer = lbl.Reader(v, len(texts)), lbl.Trainer(v, 1)
    tokens, sizes = read(pa.array(texts))
    trainer.learn(*lbl.contexts(tokens, sizes), tokens[:, 2], tokens[:, 3])
    return v, trainer, read, texts


def test_probabilities_of_all_words_sum_to_one(learned):
    import numpy as np

    v, trainer, *_ = learned
    assert v.many > 1 and 0 < len(v.head) < v.distinct - 1
    model = lbl.Model.of(trainer.w, v)
    leaves = np.arange(len(v.mass))
    kinds = np.concatenate((np.arange(v.first), v.first + np.repeat(np.arange(v.many), np.diff(v.start))))
    every = np.concatenate((np.full(v.first, -1), leaves))
    for one, two in ((lbl.START, lbl.CLASSES), (1, 3), (90, v.first), (lbl.CODES - 1, 2), (lbl.CODES - lbl.CLASSES + v.first, v.first + 1)):
        p = 10.0 ** model.scores(np.full(len(every), one), np.full(len(every), two), kinds, every)
        assert p.sum() == pytest.approx(1, abs=2e-3) and (p > 0).all()
    for m in range(v.many):  # a class's mass is that of its words, and one for what was never seen
        assert v.class_mass[v.first + m] == v.mass[v.start[m] : v.start[m + 1]].sum()
    # each class's words and those beyond: (n + 1) of each token, the end and words of their own without the one
    own = min(lbl.SINGLES, len(v.head))
    assert v.class_mass.sum() == v.tokens + (v.distinct - 1 - own) + v.many


def test_scores_are_those_of_a_loop(learned):
    """The text's sum by the definition: a softmax over all classes, then over the leaves of the class, token by token."""
    import numpy as np
    import pyarrow as pa

    v, trainer, read, texts = learned
    w, model = trainer.w, lbl.Model.of(trainer.w, v)
    tokens, sizes = read(pa.array([texts[0], "never seen words", "", None, texts[3]]))
    one, two = lbl.contexts(tokens, sizes)
    got, at = model.scores(one, two, tokens[:, 2], tokens[:, 3]), 0
    for n in sizes.tolist():
        for k in range(n):
            _, _, kind, leaf, _ = tokens[at + k].tolist()
            before = w.R[tokens[at + k - 1, 4] if k else lbl.START].astype(float) @ w.C1
            h = before + w.S[tokens[at + k - 2, 2] if k > 1 else lbl.CLASSES].astype(float) @ w.C2
            z = np.where(v.class_mass > 0, w.Q @ h + w.b, -np.inf)
            p = z[kind] - np.log(np.exp(z).sum())
            if leaf >= 0:
                a, b = v.start[kind - v.first], v.start[kind - v.first + 1]
                share = v.mass[a:b] / v.mass[a:b].sum()
                z = w.q[a:b] @ before + w.a[a:b] + np.log(share)
                p += z[leaf - a] - np.log(np.exp(z).sum())
            assert got[at + k] == pytest.approx(p / math.log(10), abs=2e-3)
        at += n


def test_gradients_are_those_of_the_loss():
    """Errors and the context's gradient of noise-contrastive estimation against differences of its loss."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, k, d = 4, 3, lbl.WIDTH
    h, q, z = (rng.normal(size=(x, d)) for x in (n, n, k))
    b, log_q, zb, log_z = (rng.normal(size=x) for x in (n, n, k, k))

    def loss(h, b, zb):
        own = (h * q).sum(axis=1) + b - log_q
        other = h @ z.T + zb - log_z
        return -np.log(lbl.sigmoid(own)).sum() - np.log(1 - lbl.sigmoid(other)).sum()

    own, other, dh = lbl.noise_gradients(h, q, b, log_q, z, zb, log_z)
    step = 1e-6

    def slope(f, x):
        out = np.zeros(x.shape)
        for i in np.ndindex(x.shape):
            e = np.zeros(x.shape)
            e[i] = step
            out[i] = (f(x + e) - f(x - e)) / (2 * step)
        return out

    assert dh == pytest.approx(slope(lambda x: loss(x, b, zb), h), abs=1e-5)
    assert own == pytest.approx(slope(lambda x: loss(h, x, zb), b), abs=1e-5)
    assert other.sum(axis=0) == pytest.approx(slope(lambda x: loss(h, b, x), zb), abs=1e-5)


def test_sums_by_row_and_means_by_tokens(learned):
    import numpy as np

    rng = np.random.default_rng(2)
    for kind in (np.int16, np.int32):
        at, rows = rng.integers(0, 9, 50).astype(kind), rng.normal(size=(50, 3))
        u, g = lbl.by_row(at, rows)
        assert u.tolist() == sorted(set(at.tolist())) and all(g[k] == pytest.approx(rows[at == x].sum(axis=0)) for k, x in enumerate(u))
    v, trainer, *_ = learned
    other = lbl.Trainer(v, 2)
    other.w.R[:] += 1
    other.w.q[:] -= 1
    other.tokens, other.leaf_n[:] = 3 * trainer.tokens, 5
    by = {}
    for t in (trainer, other):
        for part, places, data in t.parts():
            by.setdefault(part, lbl.Mean(part)).add(places, data)
    flat, q = trainer.w.packed() * 0, trainer.w.q * 0
    for m in by.values():
        part, places, data = m.row()
        x = np.frombuffer(data, np.float32)
        if part < 0:
            flat[(-1 - part) * 32 * lbl.BLOCK :][: len(x)] = x
        else:
            q[np.frombuffer(places, np.int32)] = x.reshape(-1, lbl.WIDTH + 1)[:, : lbl.WIDTH]
    assert flat == pytest.approx((trainer.w.packed() + 3 * other.w.packed()) / 4, abs=0.02)
    n = trainer.leaf_n[:, None]
    assert q == pytest.approx((n * trainer.w.q + 5 * other.w.q) / (n + 5), abs=0.02)


def test_words_are_counted_and_classed_alike_by_any_reader(learned):
    import numpy as np
    import pyarrow as pa

    texts = [" Ab  cd\tAB \n", None, "", "É é\x0bx", "ab"]
    words, at, sizes = lbl.words_of(pa.array(texts))
    assert sizes.tolist() == [3, 0, 0, 3, 1] and [words[k].decode() for k in at] == ["ab", "cd", "ab", "É", "é", "x", "ab"]
    assert [x.tolist() for x in lbl.words_of(pa.array(texts).slice(2, 2))[1:]] == [[0, 1, 2], [0, 3]] or lbl.words_of(pa.array(texts).slice(2, 2))[2].tolist() == [0, 3]
    v, _, read, own = learned
    small = lbl.Reader(v, len(own))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lbl, "HELD", 3)
        parts = [small(pa.array([x])) for x in own[:6]]
    whole, sizes = read(pa.array(own[:6]))
    assert np.array_equal(np.concatenate([p for p, _ in parts]), whole) and np.concatenate([n for _, n in parts]).tolist() == sizes.tolist()


def test_any_dealing_to_tasks_gives_a_model_that_beats_unigrams(spark):
    """The weights depend on how texts are dealt to tasks; counts and base scores do not."""
    rng = random.Random(7)
    chain = {w: rng.sample(range(60), 3) for w in range(60)}
    rows = []
    for i in range(300):
        w, out = rng.randrange(60), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = None
    for parts in (1, 5):
        got = lbl.lm_scores(df.repartition(parts)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        assert got[0] > 0.98 * got[1] and got[1] == pytest.approx(base or got[1])
        base = got[1]


# --- decontamination ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaked(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([4, 9, 15, 22, 22, 40])] + [(50, None), (51, " ... ")]
    docs, truth = [], set()
    for i in range(120):
        words = prose(rng, 120).split()
        if i % 2:
            k = rng.randrange(1, 6)
            item = items[k][1].split()
            for _ in range(rng.randrange(0, decontaminate.edits_allowed(len(item)) + 1)):
                at, what = rng.randrange(len(item)), rng.random()
                if what < 0.4:
                    item[at] = "zzz"
                elif what < 0.7:
                    item.insert(at, "yyy")
                else:
                    del item[at]
            at = rng.randrange(0, 100)
            words[at:at] = item
            truth.add((i, k))
        docs.append((i, ", ".join(words).upper() if i % 3 == 0 else " ".join(words)))
    docs += [(200, None), (201, ""), (202, "word " * 3000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items, truth


def test_leaks_are_those_of_brute_force(leaked):
    docs, benchmark, texts, items, truth = leaked
    expected = set()
    for i, text in texts:
        words = decontaminate.words_of((text or "").encode())
        for k, item in items:
            own = decontaminate.words_of((item or "").encode())
            if own and plain.edits(own, words) <= decontaminate.edits_allowed(len(own)):
                expected.add((i, k))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(got) <= expected
    assert truth <= expected and len(set(got) & expected) >= 0.98 * len(expected)
    for (i, k), r in got.items():
        own = decontaminate.words_of(dict(items)[k].encode())
        assert r["edits"] >= plain.edits(own, decontaminate.words_of(dict(texts)[i].encode())) and r["similarity"] >= 0.8


def test_clean_documents_stay(leaked):
    docs, benchmark, texts, items, truth = leaked
    bad = {r["doc_id"] for r in decontaminate.leaks(docs, benchmark).collect()}
    out = decontaminate.clean(docs.withColumn("source", F.lit("s")), benchmark)
    assert out.columns == ["doc_id", "text", "source"]
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in texts} - bad


def test_blocks_of_items_give_the_same(leaked, monkeypatch):
    docs, benchmark, *_ = leaked
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == whole


def test_without_walks_every_item_is_compared_and_nothing_is_missed(leaked, monkeypatch):
    docs, benchmark, texts, items, _ = leaked
    monkeypatch.setattr(decontaminate, "WALKS", 0)
    index = decontaminate.index_of([(k, (x or "").encode()) for k, x in items])
    assert all(not g.walks for g in index.groups)
    words = [decontaminate.words_of((t or "").encode()) for _, t in texts]
    for few in (decontaminate.FEW, 0):
        monkeypatch.setattr(decontaminate, "FEW", few)
        got = {(texts[k][0], item) for k, item, *_ in decontaminate.matches(index, [(t or "").encode() for _, t in texts])}
        own = {k: w for k, x in items if (w := decontaminate.words_of((x or "").encode()))}
        assert got == {(i, k) for (i, _), w in zip(texts, words) for k, o in own.items() if plain.edits(o, w) <= decontaminate.edits_allowed(len(o))}


def test_an_index_of_many_items_is_small_and_finds_them():
    import pickle

    rng = random.Random(3)
    items = [(k, prose(rng, rng.randrange(6, 30)).encode()) for k in range(10_000)]
    index = decontaminate.index_of(items)
    assert len(pickle.dumps(index)) < 40 << 20
    asked = [items[k] for k in range(0, 10_000, 250)]
    found = {(k, item) for k, item, _, dist in decontaminate.matches(index, [b"some words " + x + b" and more" for _, x in asked]) if dist == 0}
    assert {(k, i) for k, (i, _) in enumerate(asked)} <= found


def test_an_empty_benchmark_removes_nothing(leaked):
    docs, benchmark, texts, *_ = leaked
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)


# --- all ---------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (licenses.licenses(empty), hostrules.quality_rules(empty), langid.languages(empty), nbsvm.quality(empty, labels), lbl.lm_scores(empty), hostrules.passing(empty), langid.recognised(empty)):
        assert df.count() == 0


def test_null_ids_do_no_harm(spark):
    df = spark.createDataFrame([(None, "some text here", None, None), (None, None, None, None), (1, "more text", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(None, 1), (1, 0)], "doc_id long, quality int")
    for out in (licenses.licenses(df), hostrules.quality_rules(df), langid.languages(df), nbsvm.quality(df, labels), lbl.lm_scores(df)):
        assert out.count() == 3
