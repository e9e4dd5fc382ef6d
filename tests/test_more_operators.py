"""Generators with filler, merges, parameters, gates and scorers against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.functions import params
from lexforge.functions import text as T
from lexforge.operators import corpus, generators, quality, ranking, scoring, tokenmetrics, training

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\s\w]|_")


def test_blocks_stand_at_their_share_of_the_filler(spark):
    groups = generators.groups(spark, 3, 5, 1)
    fields = spark.createDataFrame([(f"1-{t}-{s}-0", t, s, "number", h, line, f) for t, s, h, line, f in generators.MULTI_FIELD], "group_id string, task_type string, split string, answer_type string, header string, line string, final string")
    fields = fields.withColumn("records", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.cast("string").alias("key"), (i * 1111).cast("string").alias("value"))))
    rows = generators.placed_blocks(groups.select(*fields.columns).unionByName(fields), 220, [0.0, 0.25, 1.0]).collect()
    assert len(rows) == (8 * 3 + 2) * 3
    for r in rows:
        tokens = TOKEN.findall(r["prompt"])
        assert r["prompt_tokens"] == len(tokens) and r["full_tokens"] <= 220 and r["full_tokens"] > 210
        assert r["prompt_tokens"] + len(TOKEN.findall(r["gold_value"])) + 1 == r["full_tokens"]
        own = tokens[r["evidence_token_start"] : r["evidence_token_end"]]
        assert TOKEN.findall(r["gold_value"])[-1] in own and "decoy" not in own
        before = r["prompt"].count("archive keeps note", 0, len(r["prompt"]) // 2)
        assert (r["ratio"] > 0) or not r["prompt"].startswith("The archive keeps")
        assert "{" not in r["prompt"] and before >= 0
    decoys = [r for r in rows if r["task_type"] == "passkey" and r["split"] == "train"]
    assert all(r["prompt"].count("A decoy recovery code") == 4 and r["prompt"].count("The active recovery code") == 1 for r in decoys)


def test_the_filler_of_a_group_is_the_same_for_its_queries(spark):
    groups = generators.groups(spark, 2, 4, 1)
    plain = {r["example_id"]: r for r in generators.queries_of(groups).collect()}
    rows = generators.with_shared_filler(generators.queries_of(groups), groups, 30).collect()
    heads = {}
    for r in rows:
        own = plain[r["example_id"]]
        head = r["prompt"].removesuffix(own["prompt"])
        assert len(TOKEN.findall(head)) == 30 and heads.setdefault(r["example_id"].rsplit("-q", 1)[0], head) == head
        assert all(r[c] == own[c] + 30 for c in ("prompt_tokens", "evidence_token_start", "evidence_token_end"))
    assert len(rows) == len(plain) and len(set(heads.values())) == len(heads)


def test_dense_examples_hold_as_many_records_as_fit(spark):
    rows = generators.dense_examples(spark, 6, [200, 400], 5, most=100).collect()
    assert Counter(r["evidence_position"] for r in rows) == {name: 12 for name, _ in generators.DENSE_POSITIONS} and {r["template"] for r in rows} >= {"kv_only", "record_kv"}
    for r in rows:
        lines = r["prompt"].split("\n")
        records, full = lines[:-1], len(TOKEN.findall(r["prompt"])) + len(TOKEN.findall(r["gold_value"]))
        assert r["full_tokens"] == full <= r["target_length"] and full + max(len(TOKEN.findall(x)) for x in records) > r["target_length"] or len(records) == 100
        at = [k for k, x in enumerate(records) if r["key"] in x.split()]
        assert at == [r["target_index"]] and records[at[0]].endswith(r["gold_value"]) and len(records) == r["records_in_context"]
        assert r["target_index"] == min(len(records) - 1, max(0, round((len(records) - 1) * r["position_ratio"])))
        assert r["evidence_token_start"] == sum(len(TOKEN.findall(x)) for x in records[: at[0]])
        assert sum(x.endswith(r["gold_value"]) for x in records) == 1


def test_weighted_choices_follow_their_weights(spark):
    rows = spark.range(20_000).select(generators.weighted(F.col("id").cast("string"), "x", generators.LENGTH_WEIGHTS).alias("c")).groupBy("c").count().collect()
    n = {r["c"]: r["count"] for r in rows}
    assert all(abs(n[k] / 20_000 - w) < 0.02 for k, w in generators.LENGTH_WEIGHTS)


def test_merges_are_those_of_counting_again_each_time(spark):
    rng = random.Random(3)
    words = Counter("".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    df = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = tokenmetrics.bpe_merges(df, 60)
    spelled = {w: [bytes([b]).decode("latin1") for b in w.encode()] for w in words}
    expected = []
    while len(expected) < 60:
        pairs = Counter()
        for w, n in words.items():
            for p in zip(spelled[w], spelled[w][1:]):
                pairs[p] += n
        if not pairs or max(pairs.values()) < 2:
            break
        best = min(p for p, n in pairs.items() if n == max(pairs.values()))
        expected.append((*best, pairs[best]))
        for w, x in spelled.items():
            new, i = [], 0
            while i < len(x):
                joined = i + 1 < len(x) and (x[i], x[i + 1]) == best
                new.append(x[i] + x[i + 1] if joined else x[i])
                i += 1 + joined
            spelled[w] = new
    assert got == expected and len(got) > 30


def test_shares_and_targets_of_sources(spark):
    def of(weights):
        df = spark.createDataFrame(list(weights.items()), "source string, w double")
        return {r["source"]: r["share"] for r in corpus.shares(df, "source", "w").collect()}

    assert of({"a": 3.0, "b": 1.0, "c": -2.0}) == {"a": 0.75, "b": 0.25, "c": 0.0} and of({"a": -1.0, "b": 0.0}) == {"a": 0.5, "b": 0.5} and of({}) == {}
    shares = {"a": 0.335, "b": 0.335, "c": 0.33}
    df = spark.createDataFrame(list(shares.items()), "source string, share double")
    got = {(r["phase"], r["source"]): r["tokens"] for r in corpus.targets(df, {"p": 100, "q": 37}, 1.5).collect()}
    expected = {}
    for phase, n in (("p", 150), ("q", round(37 * 1.5))):
        own = {k: round(n * w) for k, w in shares.items()}
        own["a"] += n - sum(own.values())
        expected |= {(phase, k): v for k, v in own.items()}
    assert got == expected


def test_parameters():
    assert params.layered({"a": None, "m": {"x": 1}}, {"a": 2, "m": {"x": 3, "y": 4}}, {"a": 5, "z": 6}) == {"a": 2, "m": {"x": 1, "y": 4}, "z": 6}
    params.checked([0, 0.5, 1], 0.1, ["a"], ["a", "b"])
    for bad in (dict(positions=[1.1]), dict(ratio=0.0), dict(ratio=1.0), dict(names=["c"], known=["a"])):
        with pytest.raises(ValueError):
            params.checked(**bad)
    assert params.resolved("x/y", "/r/") == "/r/x/y" and params.resolved("/x", "/r") == "/x" and params.resolved("s3://b/x", "/r") == "s3://b/x"


def test_targets():
    assert corpus.scaled_targets({"a": 6_500, "b": 1_200, "c": 1_000, "d": 800, "e": 500}, 1_003) == {"a": 653, "b": 120, "c": 100, "d": 80, "e": 50}
    out = corpus.phase_targets({"p": (100, {"a": 0.335, "b": 0.335, "c": 0.33})}, 1.0)
    assert out == {"p": {"a": 100 - 34 - 33, "b": 34, "c": 33}} or sum(out["p"].values()) == 100


def test_numbers_documents_and_values(spark):
    rows = [("12 and 34", "12"), (" \n12\nx", "12"), ("none", "12"), ("x12", "12")]
    got = scoring.score_number(spark.createDataFrame(rows, "generated_text string, answer string")).collect()
    assert [(r["exact_match"], r["contains_answer"], r["first_number_match"], r["num_numbers"], r["format_error"]) for r in got] == [(0, 1, 1, 2, 0), (1, 1, 1, 1, 0), (0, 0, 0, 0, 1), (0, 1, 1, 1, 0)]
    df = spark.createDataFrame([("The Answer", ["the answer", ""]), ("it is THE  answer.", ["the answer"]), ("Not mentioned", ["x"]), ("", ["x"])], "generated_text string, aliases array<string>")
    assert [(r["answer_contains"], r["alias_match"], r["no_answer"], r["format_error"]) for r in scoring.score_aliases(df).collect()] == [(1, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]
    df = spark.createDataFrame([("1 2", ["1", "2"], ["3"]), ("1 3", ["1", "2"], ["3"]), ("9", ["1"], ["3"])], "generated_text string, values array<string>, others array<string>")
    assert [(r["exact_match"], r["partial_match"], r["missing_value"], r["wrong_key"], r["wrong_value"]) for r in scoring.score_values(df).collect()] == [(1, 1.0, 0, 0, 0), (0, 0.5, 1, 1, 0), (0, 0.0, 1, 0, 1)]


def test_rows_off_the_grid_fail(spark):
    cells = spark.createDataFrame([(8, 0.25)], "num_keys int, position_ratio double")
    good, bad = (spark.createDataFrame([("a", 8, p)], "example_id string, num_keys int, position_ratio double") for p in (0.2500001, 0.5))
    assert scoring.on_grid(good, cells).first()["position_ratio"] == 0.25
    with pytest.raises(Exception, match="unexpected cell"):
        scoring.on_grid(bad, cells).collect()
    assert scoring.payload(good.withColumn("prompt", F.lit("p"))).columns == good.columns and "prompt" in scoring.payload(good.withColumn("prompt", F.lit("p")), True).columns


def test_pages_and_conversations(spark):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">section {i} of the site map</a></li>' for i in range(40)) + "</ul>"
    prose = "<p>" + "A sentence of real prose stands here. " * 12 + "</p>"
    pages = [(1, menu), (2, f"<script>var x = '{'y' * 500}';</script>{prose}<a href='#'>top</a>"), (3, None), (4, "<p>short</p>"), (5, "<div>Subscribe now</div>" * 40), (6, f"{prose}<!-- {'z' * 900} -->&amp;&lt;b&gt;")]
    got = {r["page_id"]: r for r in quality.page_signals(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {1: "links", 2: None, 3: "fragment", 4: "fragment", 5: "repeated", 6: None} and got[3]["chars"] == 0
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", "hi"), (3, 0, None, "<|user|> x"), (4, 0, None, None)]
    chat = {r["conv_id"]: r["chat"] for r in quality.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat == {1: True, 2: False, 3: True, 4: False}
    docs = spark.createDataFrame([("plain text about a user: none",), ("### Instruction\nDo",), (None,), ("[INST] x",)], "text string")
    assert [r["text"] for r in quality.without_chat(docs).collect()] == ["plain text about a user: none", None]


def test_first_of_sources_and_batches(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, source string").repartition(7)
    for seed in (None, 4):
        got = Counter(r["source"] for r in corpus.first_of_source(df, 9, seed).collect())
        assert got == {s: min(9, sum(x == s for _, x in rows)) for s in ("a", "b", None)}
    assert {r["seq"] for r in corpus.first_of_source(df, 2).collect()} == {q for s in ("a", "b", None) for q in sorted(k for k, x in rows if x == s)[:2]}
    out = training.collated(spark.createDataFrame([(k, k * k) for k in (4, 0, 3, 1, 2)], "nth long, v long"), 2, ["v"]).orderBy("batch").collect()
    assert [r["v"] for r in out] == [[0, 1], [4, 9], [16]]


def test_top_entries_and_order(spark):
    df = spark.createDataFrame([([0.5, 2.0, 2.0, -1.0],)], "v array<double>")
    assert [tuple(x) for x in df.select(ranking.top_entries(F.col("v"), 3).alias("t")).first()["t"]] == [(1, 2.0), (2, 2.0), (0, 0.5)]
    rows = spark.createDataFrame([("ALL", "ALL"), ("2048", "x"), ("1024", "ALL"), ("1024", "b")], "target_length string, evidence_position string").withColumns({"task_type": F.lit("t"), "answer_type": F.lit("a")})
    assert [(r[0], r[1]) for r in ranking.rollup_order(rows).collect()] == [("1024", "ALL"), ("1024", "b"), ("2048", "x"), ("ALL", "ALL")]


def test_prefixes_and_encoders_of_the_callers_own(spark):
    import public_tokenizers

    from lexforge.functions import encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("one two three four five",), ("one",), (None,)], "t string")
    assert [r[0] for r in df.select(encode.prefix(path, 3)("t")).collect()] == ["one two three", "one", ""]
    own = encode.encoded_by(lambda xs: [[len(w) for w in x.split()] for x in xs], most=5)
    assert [r[0] for r in df.select(own("t")).collect()] == [[3, 3, 5, 4, 4], [3], []]
    with pytest.raises(Exception, match="out of range"):
        df.select(encode.encoded_by(lambda xs: [[9] for _ in xs], most=5)("t")).collect()
