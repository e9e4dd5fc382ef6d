"""SimHash, components, packing, sharding, archives and the pipeline."""

import io
import os
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from fixtures import prose
from lexforge.llm import packing, sharding, simhash, warc
from lexforge.llm.components import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FEW = settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- SimHash ----------------------------------------------------------------------------------------------------------


def test_near_duplicates(docs, rows):
    prints = [plain.fingerprint(r[1]) for r in rows]
    groups = plain.components([r[0] for r in rows], prints)
    expected = {r[0]: (f"{p:016x}", g) for r, p, g in zip(rows, prints, groups)}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected
    assert len(set(groups)) < len(rows) - 40


def test_one_of_each_group_survives(docs, rows):
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    out = simhash.survivors(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({g for g in groups.values()})


@FEW
@given(st.integers(0, 2**32), st.integers(2, 700), st.integers(1, 5), st.integers(0, 7), st.booleans())
def test_links_connect_what_all_pairs_connect(seed, n, centres, flips, one_bucket):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    fps = np.unique(fps)
    rng.shuffle(fps)
    bucket = np.sort(rng.integers(0, 1 if one_bucket else 5, len(fps)))
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS) & (bucket[:, None] == bucket[None, :])
    for links in (simhash.links_of, simhash.links_of_large) if one_bucket else (simhash.links_of,):
        a, b = links(bucket, fps) if links is simhash.links_of else links(fps)
        assert np.array_equal(simhash.roots_of(len(fps), a, b), simhash.roots_of(len(fps), *np.nonzero(near)))


@pytest.mark.parametrize("n", [10, 10**7, 10**9, 10**12, 10**15])
def test_any_pair_in_reach_shares_a_bucket(n):
    masks, rng = simhash.bucket_masks(n), random.Random(n)
    for _ in range(300):
        flipped = sum(1 << b for b in rng.sample(range(64), simhash.RADIUS))
        assert any(not flipped & m for m in masks)


def test_tiled_buckets_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(2**40) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(7) << rng.integers(0, 60, 900, dtype=np.uint64)))
    df = spark.createDataFrame([(int(x), k) for k, x in enumerate(fps.view(np.int64).tolist())], "fp long, rep long")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS
    monkeypatch.setattr(simhash, "TILE", 64)
    pairs = simhash.links(df, len(fps)).collect()
    a, b = (np.array([r[c] for r in pairs], int) for c in ("u", "v"))
    assert np.array_equal(simhash.roots_of(len(fps), a, b), simhash.roots_of(len(fps), *np.nonzero(near)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = packing.pack(docs, TOKENIZER).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        twice = 2 if doc == rows[7][0] else 1
        mine = sorted(by[doc], key=lambda r: (r["start"], r["sequence_id"]))[::twice]
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1]) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in by[doc])
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        x.sort()
        assert [o for o, _ in x] == list(np.cumsum([0] + [n for _, n in x])[:-1]) and sum(n for _, n in x) <= packing.LENGTH


@FEW
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=30))
def test_packs_place_every_length(histogram):
    packs = packing.patterns(histogram, 64)
    placed = Counter()
    for n, p in packs:
        assert n > 0 and sum(p) <= 64 and list(p) == sorted(p, reverse=True)
        for size in p:
            placed[size] += n
    assert placed == histogram
    used = set()
    for size, places in packing.slots(packs).items():
        ranks = [r for r, *_ in places]
        assert ranks == sorted(ranks)
        for (rank, first, at), stop in zip(places.tolist(), [*ranks[1:], histogram[size]]):
            for k in range(stop - rank):
                for t in range(at, at + size):
                    assert (first + k, t) not in used
                    used.add((first + k, t))


def test_packs_are_full():
    rng = random.Random(1)
    histogram = Counter(rng.randrange(1, 2049) if rng.random() < 0.5 else rng.randrange(1, 300) for _ in range(50_000))
    packs = packing.patterns(histogram)
    assert sum(k * n for k, n in histogram.items()) > 0.98 * 2048 * sum(n for n, _ in packs)


def encoded(encode, texts):
    at, flat = encode(pa.array(texts, pa.string()))
    return [bytes(flat[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = [r[1] or "" for r in rows] + ["don't I'll we've", "á é ́ x", "a b c d\x85e", "x²½ 12345", "İstanbul ΣΑΣ", "<|endoftext|>", "ǅungla", "a​b", "日本語 text", "\x00\x01", "_a__b_ '' 's", "ÀÉÎÕÜ ŸŽ"]
    assert encoded(encode, texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@FEW
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER) if not hasattr(test_encoder_on_any_text, "t") else test_encoder_on_any_text.t
    test_encoder_on_any_text.t = tokenizer
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(packing.encoder(TOKENIZER), texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_forgotten_chunks_are_encoded_again(rows, monkeypatch):
    texts = [r[1] or "" for r in rows]
    whole = encoded(packing.Encoder(TOKENIZER), texts)
    monkeypatch.setattr(packing, "CACHE", 50)
    small = packing.Encoder(TOKENIZER)
    for a in range(0, len(texts), 7):
        assert encoded(small, texts[a : a + 7]) == whole[a : a + 7] and len(small.known) <= 50
    assert encoded(small, [None, "", "  ", texts[0]]) == [b"", b"", b"", whole[0]] and encoded(small, []) == []
    assert [bytes(small(pa.array(texts[:9]).slice(3, 4))[1])] == [b"".join(whole[3:7])]


# --- sharding ---------------------------------------------------------------------------------------------------------


def test_shards(docs, rows):
    out = sharding.shard(docs, 8).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert len(out) == len(rows) + 1
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))


def test_shard_sizes_are_near_equal_with_a_hot_text(spark):
    rng = random.Random(3)
    copy = prose(rng, 60)
    df = spark.createDataFrame([(i, copy if i % 3 == 0 else prose(rng, rng.randrange(5, 100))) for i in range(3000)], "doc_id long, text string").repartition(6)
    out = sharding.shard(df).collect()
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in out)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(df.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in out}


def test_placement_is_the_plain_one(docs, rows):
    """All rows on one line of bytes by (text hash, doc_id), cut into equal shards at the rows' middles."""
    got = sharding.shard(docs, 7).collect()
    line = [r.asDict() for r in sharding.records(docs).collect()]
    line.sort(key=lambda r: (r["key"], r["tie"]))
    total, at, expected, seen = sum(r["size"] for r in line), 0, Counter(), Counter()
    for r in line:
        shard = min(6, int((at + r["size"] / 2) * 7 / total))
        expected[r["doc_id"], r["size"], r["text_crc32"], shard, seen[shard]] += 1
        seen[shard] += 1
        at += r["size"]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == expected


def test_rows_of_one_text_without_ids_are_parted(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 100)
    df = spark.createDataFrame([(None, "same text")] * 3000 + [(k, f"text {k}") for k in range(1000)], "doc_id long, text string").repartition(4)
    got = Counter(r["shard"] for r in sharding.shard(df, 8).collect())
    assert max(got.values()) - min(got.values()) < 0.1 * 4000 / 8


def test_ranges_follow_the_keys():
    rng = np.random.default_rng(1)
    key, doc = rng.integers(0, 20, 500), rng.integers(0, 50, 500)
    splitters = sorted({(int(k), int(d)) for k, d in zip(rng.integers(0, 20, 30), rng.integers(0, 50, 30))})
    assert sharding.ranges_of(key, doc, *np.array(splitters).T).tolist() == [sum(s <= (k, d) for s in splitters) for k, d in zip(key.tolist(), doc.tolist())]


# --- archives ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [False, True])
def test_zip_is_what_others_read_and_write(wide):
    out = io.BytesIO()
    z = warc.StoredZip(out, wide)
    for name, data in (("archive/a", b"hello"), ("empty", b""), ("indexes/é", b"x" * 1000)):
        z.begin(name)
        z.write(data[:3])
        z.write(data[3:])
        z.end()
    z.close()
    raw = out.getvalue()
    assert (b"PK\x06\x06" in raw) is wide
    with zipfile.ZipFile(io.BytesIO(raw)) as other:
        assert other.testzip() is None and other.read("archive/a") == b"hello" and other.read("indexes/é") == b"x" * 1000
    found = warc.members(io.BytesIO(raw), len(raw))
    assert {n: raw[at : at + size] for n, (_, at, size) in found.items()} == {"archive/a": b"hello", "empty": b"", "indexes/é": b"x" * 1000}
    theirs = io.BytesIO()
    with zipfile.ZipFile(theirs, "w") as other:
        other.writestr("q", b"123")
        with other.open("big", "w", force_zip64=True) as f:
            f.write(b"456")
        other.comment = b"a comment"
    found = warc.members(theirs, len(theirs.getvalue()))
    assert {n: theirs.getvalue()[at : at + size] for n, (_, at, size) in found.items()} == {"q": b"123", "big": b"456"}
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(4)
    html = [f"<p>{prose(rng, 50)} é</p>" for _ in range(30)]
    pages = [(i, f"http://h/{i}\r\nX: y" if i == 3 else f"http://h/{i}", html[i % 30] if i % 7 else None) for i in range(100)] + [(200, None, ""), (201, "u", "tiny")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, refers_to string, n int").repartition(4)
    first = {}
    for i, _, h in sorted(pages):
        first.setdefault(h or "", i)
    for least in (0, 10):
        got = {r["page_id"]: r for r in warc.warc_round_trip(df, f"file://{tmp_path}/w{least}", least, roll=4_000).collect()}
        assert len(got) == len(pages)
        for i, url, h in pages:
            r, raw = got[i], (h or "").encode()
            revisit = len(raw) >= least and first[h or ""] != i
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), warc.digest(raw), "revisit" if revisit else "response", first[h or ""] if revisit else None)
        names = os.listdir(tmp_path / f"w{least}")
        assert len(names) > 4 and all(n.endswith(".wacz") for n in names)
        with zipfile.ZipFile(tmp_path / f"w{least}" / names[0]) as z:
            assert sorted(z.namelist()) == [warc.WARC, warc.INDEX] and z.testzip() is None


# --- all, and the pipeline ---------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (simhash.near_duplicates(empty), simhash.survivors(empty), packing.pack(empty, TOKENIZER), sharding.shard(empty), warc.warc_round_trip(pages)):
        assert df.count() == 0


def test_null_ids_do_no_harm(spark):
    df = spark.createDataFrame([(None, "some text here"), (None, None), (1, "more text")], "doc_id long, text string")
    for out in (simhash.near_duplicates(df), packing.pack(df, TOKENIZER), sharding.shard(df)):
        assert out.count() == 3


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline
    from lexforge.llm import decontaminate

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [decontaminate.words_of((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in sorted(docs) if not ((x := plain.rules(docs[i]["text"]))[0] < 50 or 100 * x[4] > 50 * x[0])]
    groups = plain.components(left, [plain.fingerprint(docs[i]["text"]) for i in left])
    left = sorted({g for g in groups})
    clean = {i for i in left if not any(plain.edits(w, decontaminate.words_of(docs[i]["text"].encode())) <= decontaminate.edits_allowed(len(w)) for w in items)}
    out = corpus_pipeline.run(spark, sf).collect()
    got = {r["doc_id"] for r in out}
    # host rules and the language stage may take more, but only what has symbols, repeats or no sure language
    assert got <= clean and len(got) >= 0.9 * len(clean)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "packing"]
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, sf).columns == frame.columns
    assert corpus_pipeline.pack(spark, frame, sf).count() == 0


@pytest.mark.parametrize("name", ["op5_quality_rules", "op6_warc"])
def test_queries_with_sql(spark, name):
    from compare import difference, views
    from lexforge.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    assert difference(queries()[name](spark, sf), oracle_sql()[name], views(sf)) == ""


# --- null and repeated ids ---------------------------------------------------------------------------------------------


def with_print(spark, monkeypatch, rows):
    """A table whose texts are their fingerprints, in decimal."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text: int(text or b"0"))
    return spark.createDataFrame(rows, "doc_id long, text string, kept boolean, root long").repartition(3)


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    df = with_print(spark, monkeypatch, [(1, "0", True, 1), (None, "15", True, 1), (3, "255", True, 1), (None, str(2**63), True, 1), (9, str(2**40 * 1023), True, 1)])
    got = {r["fingerprint"].lstrip("0"): (r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {"": (1, 1), "f": (None, 1), "ff": (3, 1), "8" + "0" * 15: (None, 1), "3ff0000000000": (9, 9)}
    df = with_print(spark, monkeypatch, [(None, "0", True, 1), (None, "1048575", True, 1)])
    assert [r["component_id"] for r in simhash.near_duplicates(df).collect()] == [None, None]


def test_one_row_of_each_group_survives_whatever_its_id(spark, monkeypatch):
    far = str(2**63 + 2**62 + 2**61 + 2**60 + 2**59 + 2**58)
    rows = [(5, "0"), (4, "1"), (4, "1"), (4, "3"), (None, "7"), (None, far), (None, far), (7, str(2**40 * 1023)), (7, str(2**40 * 1023))]
    df = with_print(spark, monkeypatch, [(*r, True, 1) for r in rows])
    for bound in (simhash.BROADCAST_ROWS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
        out = simhash.survivors(df)
        got = sorted(out.collect(), key=str)
        assert out.columns == df.columns and len(got) == 3
        assert {r["doc_id"] for r in got} == {4, 7, None} and {r["text"] for r in got if r["doc_id"] is None} == {far}


def test_repeated_and_missing_page_ids_write_a_record_each(spark, tmp_path):
    rows = [(1, "x"), (1, "x"), (2, "x"), (None, "y"), (None, "y"), (None, "z"), (3, "z"), (4, None), (4, ""), (1, "w"), (None, "x")]
    df = spark.createDataFrame([(i, "u", h, "c") for i, h in rows], "page_id long, url string, html string, row string").repartition(4)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(df, f"file://{tmp_path}/w").collect())
    assert got == Counter(
        [(1, 1, "response", None), (1, 1, "revisit", 1), (2, 1, "revisit", 1), (None, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "revisit", None)]
        + [(3, 1, "response", None), (None, 1, "revisit", 3), (4, 0, "response", None), (4, 0, "revisit", 4), (1, 1, "response", None)]
    )
    raw = b"".join((tmp_path / "w" / n).read_bytes() for n in os.listdir(tmp_path / "w"))
    names = []
    for part in raw.split(b"\x1f\x8b\x08\x00")[1:]:
        try:
            names.append(zlib.decompressobj(31).decompress(b"\x1f\x8b\x08\x00" + part).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0])
        except (zlib.error, IndexError):
            pass
    assert len(names) == len(set(names)) == len(rows)


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace as N

    from lexforge.llm import common

    context = N(getConf=lambda: N(get=lambda *_: None), master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(N(sparkContext=context, conf=N(get=lambda *_: None)))


# --- listed rows beyond a broadcast ------------------------------------------------------------------------------------


def test_lists_beyond_a_broadcast_give_the_same(spark, docs, monkeypatch):
    """Survivors, kept documents and archive records by bitmaps are those by broadcasts."""
    from lexforge.llm import hostrules

    twice = docs.filter("doc_id IN (3, 130)").unionByName(docs)
    pages = spark.createDataFrame([(k, f"u{k}", "h" * (k % 7)) for k in range(40)] + [(None, None, None), (5, "u", "h" * 5)], "page_id long, url string, html string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    results = lambda: [sorted(map(key, f.collect())) for f in (simhash.survivors(twice), hostrules.passing(twice), warc.warc_round_trip(pages).select("page_id", "payload_digest", "record_type", "refers_to"))]
    few = results()
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(hostrules, "BROADCAST_HOSTS", -1)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert results() == few and all(few)
