"""Queries of readers and sinks: each writes files to the shared folder and returns what the readers find there."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import corpus, folds, listing, scoring, shards
from lexforge.plans import corpus as C
from lexforge.plans import evaluation as E
from lexforge.plans.common import Query, plain, table, token_id_sql, tokens_sql
from lexforge.plans.training import _listing
from lexforge.sources import readers, sinks
from lexforge.sources.shardsink import write_shards
from lexforge.sources.shared import fresh_folder
from lexforge.sources.zstframes import zst_lines
from lexforge.streaming import predictions

LENGTH, VOCABULARY, SEED, FRAME_BYTES = 16, 60_000, 42, 30_000


def _texts(rows):
    return plain(rows.select("source", F.md5("text").alias("text_md5")))


def _docs(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''")


def src_parquet(spark, d):
    folder = fresh_folder(spark, "parquet")
    _docs(spark, d).select("doc_id", F.col("text").alias("content"), F.lit("").alias("abstract")).write.parquet(f"{folder}/a.parquet")
    return _texts(readers.corpora(spark, {"web": [f"{folder}/a.parquet"]}))


def src_jsonl(spark, d):
    folder = fresh_folder(spark, "jsonl")
    sinks.write_lines(_docs(spark, d).select("doc_id", "text"), folder).collect()  # a path for each partition
    return _texts(readers.corpus(spark, f"{folder}/*.jsonl", "web", strict=True))


def src_zst(spark, d):
    """Compressed lines, one of each file malformed and one blank."""
    folder = fresh_folder(spark, "zst")
    sinks.write_lines(_docs(spark, d).select("doc_id", "text"), folder, ".jsonl.zst", "zstd").collect()
    store, base = readers.store_of(f"{folder}/broken.jsonl.zst")
    with store.open_output_stream(base, compression="zstd") as f:
        f.write(b'{broken\n\n{"text": "one more"}\n')
    return _texts(readers.corpus(spark, f"{folder}/*.zst", "web"))


def src_listing(spark, d):
    """A folder of all formats, listed once each and read by their endings."""
    folder, docs = fresh_folder(spark, "mixed"), _docs(spark, d).select("doc_id", "text")
    part = F.col("doc_id") % 3
    docs.filter(part == 0).write.parquet(f"{folder}/a.parquet")
    sinks.write_lines(docs.filter(part == 1), folder).collect()
    sinks.write_lines(docs.filter(part == 2), folder, ".jsonl.zst", "zstd").collect()
    return _texts(readers.corpora(spark, {"web": readers.source_files(folder)}))


def src_nested(spark, d):
    rows = table(spark, d, "pages").select(F.struct(F.lit("").alias("text"), F.struct(F.array(F.lit(""), F.col("html"), F.col("url")).alias("content")).alias("body")).alias("r"))
    return plain(rows.select(F.md5(readers.extract_text(rows.schema["r"].dataType, F.col("r"))).alias("text_md5")))


def src_text_folder(spark, d):
    folder = fresh_folder(spark, "txt")
    for r in table(spark, d, "region").collect():  # five rows
        sinks.put_text(r["r_name"], f"{folder}/{r['r_regionkey']}.txt")
    return plain(readers.corpus_text(spark, folder))


def src_kv_records(spark, d):
    """Groups of orders as the largest benchmark file; a size that has none reads it."""
    folder = fresh_folder(spark, "kv")
    rows = E._sources(spark, d).select("key", "value", F.transform("records", lambda r: F.array(r["key"], r["value"])).alias("ordered_kv_records"))
    sinks.write_lines(rows, f"{folder}/kv-retrieval-300_keys.jsonl.gz", ".jsonl.gz", "gzip").collect()  # a path for each part
    out = readers.kv_records(spark, folder, 40)
    return plain(out.select("key", "value", F.size("ordered_kv_records").alias("records"), F.get(F.get("ordered_kv_records", F.lit(0)), F.lit(1)).alias("first_value")))


def src_csv(spark, d):
    folder = fresh_folder(spark, "csv")
    sinks.write_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("num_keys"), F.col("s_nationkey").alias("n"), F.round("s_acctbal", 2).alias("accuracy")), folder, "sorted")
    return plain(readers.csv(spark, folder))


def src_rows(spark, d):
    folder = fresh_folder(spark, "rows")
    sinks.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value"), folder)
    sinks.write_jsonl(spark.createDataFrame([(-1, "more", 0.5)], "event_id long, event_type string, value double"), folder, append=True)
    return plain(readers.jsonl(spark, folder, "event_id long, event_type string, value double"))


def src_reuse(spark, d):
    """Generated the first time, read the second."""
    folder = fresh_folder(spark, "reuse")
    schema, made = "r_regionkey int, r_name string", lambda: table(spark, d, "region")
    sinks.write_jsonl(readers.read_or_make(spark, folder, made, schema), folder)
    return plain(readers.read_or_make(spark, folder, lambda: made().limit(0), schema))


def src_zst_frames(spark, d):
    """Documents as lines in files of many frames, cut anywhere, each file read by several tasks."""
    folder = fresh_folder(spark, "frames")
    lines = _docs(spark, d).select(F.to_json(F.struct("doc_id", "text")).alias("line"))

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        store, base = readers.store_of(folder)
        store.create_dir(base, recursive=True)
        at = f"{base}/part-{TaskContext.get().partitionId():05d}.jsonl.zst"
        pack, n = zstandard.ZstdCompressor(), 0
        with store.open_output_stream(f"{at}.{TaskContext.get().taskAttemptId()}") as f:
            for b in batches:
                raw = "".join(x + "\n" for x in b.column(0).to_pylist()).encode()
                for k in range(0, len(raw), FRAME_BYTES):
                    f.write(pack.compress(raw[k : k + FRAME_BYTES]))
                    n += 1
        store.move(f"{at}.{TaskContext.get().taskAttemptId()}", at)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at.rsplit('/', 1)[-1]}"]), pa.array([n], pa.int64())], ["path", "frames"])

    paths = [r["path"] for r in lines.mapInArrow(write, "path string, frames long").filter("frames > 0").collect()]  # a path for each part
    read = zst_lines(spark, paths).select(F.from_json("line", "doc_id long, text string").alias("r"))
    return plain(read.select(F.col("r.doc_id").alias("doc_id"), F.md5("r.text").alias("text_md5")))


def positional_lines(spark, d):
    """Two files' lines matched by their places in them: documents' ids, and beside them what was said of each, both in order but
    cut into parts at other places."""
    folder = fresh_folder(spark, "lines")
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("said"))
    docs.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id"))).write.text(f"{folder}/asked")
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("said").write.text(f"{folder}/said")
    asked, said = (readers.numbered_lines(spark, f"{folder}/{x}") for x in ("asked", "said"))
    out = asked.withColumnRenamed("value", "line").join(said.select("n", F.col("value").alias("said")), "n")
    return plain(out.select("n", F.from_json("line", "doc_id long")["doc_id"].alias("doc_id"), "said"))


def stream_landed(spark, d):
    """Predictions that arrive in two lots, half of the first again in the second, taken in by a stream that is stopped between them
    and goes on from its checkpoint; rates by cell of what it has written."""
    folder = fresh_folder(spark, "stream")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_index") % 3_000)  # all within the watermark
    rows = E._predictions(spark, d).withColumn("at", at)
    names = [x.split(" ")[0] for x in predictions.SCHEMA.split(", ")]
    for lot in ("source_index % 2 = 0", "source_index % 4 IN (0, 1, 3)"):
        rows.filter(lot).select(*names).write.mode("append").json(f"{folder}/in")
        scored = scoring.score_kv(predictions.once(predictions.read(spark, f"{folder}/in", files=8)))
        predictions.land(scored.select("example_id", "num_keys", "position_ratio", "first_value_match", "format_error"), f"{folder}/out", f"{folder}/checkpoint")
    cells = predictions.landed(spark, f"{folder}/out").groupBy("num_keys", "position_ratio")
    return plain(cells.agg(F.count("*").alias("n"), F.count_distinct("example_id").alias("examples"), F.avg("first_value_match").alias("first_value_match"), F.avg("format_error").alias("format_error_rate")))


def src_synthetic(spark, d):
    """A row of ids for each customer."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row"))
    return plain(readers.synthetic(spark, rows, LENGTH, VOCABULARY, SEED).select("row", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))


def _written(spark, d):
    folder = fresh_folder(spark, "shards")
    sinks.prepare_folder(folder)
    pieces = C._pieces(spark, d)
    rows = sinks.write_token_shards(shards.payloads(pieces), folder, vocabulary=65_536).collect()  # a row for each file
    return folder, pieces, spark.createDataFrame(rows, "shard_idx long, path string, tokens long")


def src_token_shards(spark, d):
    folder, _, written = _written(spark, d)
    rows = readers.token_shards(spark, [r["path"] for r in written.collect()], block=1_000)
    index = F.regexp_extract("path", r"shard_(\d+)\.bin$", 1).cast("long").alias("shard_idx")
    each = rows.select(index, F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return plain(each.groupBy("shard_idx").agg(F.sum("n").alias("tokens"), F.sum("s").alias("id_sum")))


def src_manifest(spark, d):
    """The written shards by a manifest that leaves out every second count, which the files' sizes then give."""
    folder, _, written = _written(spark, d)
    whole = json.loads(sinks.manifest_json(written, "uint16", 65_536, 1))
    whole["shards"] = [s | ({"tokens": 0, "relpath": "x"} if k % 2 else {}) for k, s in enumerate(whole["shards"])]
    sinks.put_text(json.dumps(whole), f"{folder}/manifest.json")
    return plain(readers.manifest(spark, f"{folder}/manifest.json").select("shard_idx", "tokens", "dtype"))


def sink_manifest(spark, d):
    """The manifest with each source's targets, tokens by shard and statistics, read back: a row for each source."""
    folder, pieces, written = _written(spark, d)
    stats = corpus.source_stats(corpus.labelled(C.documents(spark, d), C.MIN_CHARS, C.LEAST, C.MOST, C.TARGET), C.MOST)
    names = [r["source"] for r in stats.select("source").orderBy("source").collect()]  # a row for each source
    text = sinks.manifest_json(written, "uint16", 65_536, 1, shards.manifest(pieces), stats, target_tokens=C.TARGET * len(names), shard_tokens=C.SHARD, source_token_targets={x: C.TARGET for x in names})
    sinks.put_text(text, f"{folder}/manifest.json")
    store, at = readers.store_of(f"{folder}/manifest.json")
    with store.open_input_file(at) as f:
        whole = json.loads(f.read().decode())
    rows = [(x, whole["source_token_targets"][x], s["docs_seen"], s["docs_written"], s["tokens_written"], sum(e["source_tokens"].get(x, 0) for e in whole["shards"]), whole["total_tokens"], whole["target_tokens"]) for x, s in whole["source_stats"].items()]
    return plain(spark.createDataFrame(rows, "source string, target long, docs_seen long, docs_written long, tokens_written long, tokens_in_shards long, total_tokens long, target_tokens long"))


def sink_phase_shards(spark, d):
    """Routed documents as shards of each phase, written as one transaction, and what the manifests and files then hold."""
    folder = fresh_folder(spark, "phases")
    routed = folds.route(C._sized(spark, d), C.PHASES, C.OVERSHOOT)
    ids = C._usable(spark, d).select("seq", F.concat(T.token_ids(F.col("text")), F.array(F.lit(C.END))).alias("ids"))
    taken = routed.join(ids, "seq").select("phase", "source", "seq", F.slice("ids", F.lit(1), F.col("take").cast("int")).alias("ids"))
    write_shards(shards.cut(taken, C.SHARD, keys=("phase",)), folder, vocabulary=VOCABULARY + 5, eod_id=C.END)
    out = None
    for p in C.PHASES:
        if not readers.store_of(f"{folder}/{p.name}/manifest.json")[0].get_file_info(readers.store_of(f"{folder}/{p.name}/manifest.json")[1]).is_file:
            continue  # no document went there
        m = readers.manifest(spark, f"{folder}/{p.name}/manifest.json").collect()
        read = readers.token_shards(spark, [r["path"] for r in m], counts=[r["tokens"] for r in m], block=1_000)
        index = F.regexp_extract("path", r"shard_(\d+)\.bin$", 1).cast("long").alias("shard_idx")
        each = read.select(index, F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
        rows = each.groupBy("shard_idx").agg(F.sum("n").alias("tokens"), F.sum("s").alias("id_sum")).withColumn("phase", F.lit(p.name))
        out = rows if out is None else out.unionByName(rows)
    return plain(out)


def sink_fetch_list(spark, d):
    files = listing.selected(_listing(spark, d), r"\.parquet$").withColumn("local_dir", F.concat(F.lit("/data/"), F.replace("dataset", F.lit("#"), F.lit("-"))))
    return plain(sinks.fetch_list(files))


_READ = "FROM documents WHERE text IS NOT NULL AND text <> ''"
_TEXTS = f"SELECT 'web' AS source, md5(text) AS text_md5 {_READ}"
_FILES = "SELECT 'https://host/org/repo/resolve/main/data/' || p_partkey || '.parquet' AS url, '  dir=/data/' || replace(p_brand, '#', '-') AS dir, '  out=' || p_partkey || '.parquet' AS out FROM part WHERE p_size % 3 = 0"
_LABELLED = C._LABELLED

QUERIES: dict[str, Query] = {
    "src_parquet": (src_parquet, _TEXTS),
    "src_jsonl": (src_jsonl, _TEXTS),
    "src_zst": (src_zst, f"{_TEXTS} UNION ALL SELECT 'web', md5('one more')"),
    "src_listing": (src_listing, _TEXTS),
    "src_nested": (src_nested, "SELECT md5(CASE WHEN html = '' THEN url WHEN url = '' THEN html ELSE html || chr(10) || chr(10) || url END) AS text_md5 FROM pages"),
    "src_text_folder": (src_text_folder, "SELECT string_agg(r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS text FROM region"),
    "src_kv_records": (src_kv_records, f"WITH {E._ALL} SELECT key, value, len(records)::BIGINT AS records, records[1].value AS first_value FROM s"),
    "src_csv": (src_csv, "SELECT s_suppkey::BIGINT AS num_keys, s_nationkey::BIGINT AS n, round(round(s_acctbal, 2), 6) AS accuracy FROM supplier"),
    "src_rows": (src_rows, "SELECT event_id, event_type, round(value, 6) AS value FROM events UNION ALL SELECT -1, 'more', 0.5::DOUBLE"),
    "src_reuse": (src_reuse, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "src_zst_frames": (src_zst_frames, "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''"),
    "positional_lines": (positional_lines, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, doc_id, md5(coalesce(text, '')) AS said FROM documents"),
    "stream_landed": (
        stream_landed,
        f"WITH {E._SC} SELECT num_keys, position_ratio, count(*) AS n, count(DISTINCT example_id) AS examples, round(avg(first_value_match), 6) AS first_value_match, round(avg(format_error), 6) AS format_error_rate FROM sc GROUP BY 1, 2",
    ),
    "src_synthetic": (
        src_synthetic,
        f"SELECT r AS row, array_to_string(list_transform(range(0, {LENGTH + 1}), lambda i: ('0x' || substr(md5('{SEED}:' || r || ':' || i), 1, 7))::BIGINT % {VOCABULARY}), ',') AS ids FROM (SELECT c_custkey AS r FROM customer)",
    ),
    "src_token_shards": (src_token_shards, f"WITH {C._PIECES} SELECT shard_idx::BIGINT AS shard_idx, sum(len(piece))::BIGINT AS tokens, sum(list_sum(piece))::BIGINT AS id_sum FROM pieces GROUP BY 1"),
    "src_manifest": (src_manifest, f"WITH {C._PIECES} SELECT shard_idx::BIGINT AS shard_idx, sum(len(piece))::BIGINT AS tokens, 'uint16' AS dtype FROM pieces GROUP BY 1"),
    "sink_manifest": (
        sink_manifest,
        f"WITH {_LABELLED}, {C._PIECES.replace(C._USABLE + ', ', '', 1)}, sh AS (SELECT source, sum(len(piece))::BIGINT AS n FROM pieces GROUP BY 1) SELECT stats.source, {C.TARGET}::BIGINT AS target, docs_seen, docs_written, tokens_written, coalesce(sh.n, 0)::BIGINT AS tokens_in_shards, (SELECT sum(n) FROM sh)::BIGINT AS total_tokens, ({C.TARGET} * (SELECT count(*) FROM stats))::BIGINT AS target_tokens FROM stats LEFT JOIN sh USING (source)",
    ),
    "sink_phase_shards": (
        sink_phase_shards,
        C._route_sql(
            f""", whole AS (SELECT seq, list_append(list_transform({tokens_sql('text')}, lambda t: {token_id_sql('t')}), {C.END}) AS ids FROM usable),
placed AS (SELECT phase, ids[1:take] AS ids, take, sum(take) OVER (PARTITION BY phase ORDER BY seq) - take AS p0 FROM routed JOIN whole USING (seq)),
each AS (SELECT phase, (p0 + generate_subscripts(ids, 1) - 1) // {C.SHARD} AS shard_idx, unnest(ids) AS id FROM placed)
SELECT phase, shard_idx::BIGINT AS shard_idx, count(*) AS tokens, sum(id)::BIGINT AS id_sum FROM each GROUP BY ALL"""
        ),
    ),
    "sink_fetch_list": (sink_fetch_list, f"WITH f AS ({_FILES}) SELECT url AS line FROM f UNION ALL SELECT dir FROM f UNION ALL SELECT out FROM f"),
}
