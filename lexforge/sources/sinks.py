"""Sinks: token shards with their manifest, JSON lines, CSV with a chosen header."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.sources.shared import small_batches


def write_token_shards(shards: DataFrame, folder: str, dtype: str = "uint16", vocabulary: int | None = None) -> DataFrame:
    """shards (shard_idx, ids) -> one file shard_<index>.bin each in a folder that all executors reach; returns (shard_idx, path, tokens).

    An id that is negative, or not below the vocabulary or the type's range, fails the write. Files are written under an
    attempt's name and moved when whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        most = min(np.iinfo(dtype).max + 1, vocabulary or 1 << 62)
        for b in batches:
            ids, indices = b.column(1), b.column(0).to_pylist()
            for k, index in enumerate(indices):
                x = ids[k].values.to_numpy(zero_copy_only=False)  # of one shard; lists of Python numbers take ten times as much
                if x.dtype.kind != "i":
                    raise ValueError(f"shard {index}: an id is null")
                if len(x) and (x.min() < 0 or x.max() >= most):
                    raise ValueError(f"shard {index}: an id is out of range")
                path = f"{base}/shard_{index:06d}.bin"
                temp = f"{path}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(temp) as f:
                    f.write(x.astype(dtype).tobytes())
                store.move(temp, path)
                yield pa.RecordBatch.from_arrays([pa.array([index], pa.int64()), pa.array([path]), pa.array([len(x)], pa.int64())], ["shard_idx", "path", "tokens"])

    small_batches(shards.sparkSession)
    return shards.select(F.col("shard_idx").cast("long"), "ids").mapInArrow(run, "shard_idx long, path string, tokens long")


def manifest_json(written: DataFrame, dtype: str, vocabulary: int, end: int, sources: DataFrame | None = None, stats: DataFrame | None = None, **fields) -> str:
    """The manifest of written shards, whose rows are one for each file: totals, the shards, and what is given of
    sources (shard_idx, source, tokens), the tokens of each source in each shard; stats (source, ...), a row of statistics
    for each source; and more fields such as targets, phase or tokenizer."""
    of: dict[int, dict[str, int]] = {}
    for r in sources.orderBy("shard_idx", "source").toLocalIterator() if sources is not None else ():
        of.setdefault(r["shard_idx"], {})[r["source"]] = r["tokens"]
    shards = [{"path": r["path"].rsplit("/", 1)[-1], "tokens": r["tokens"], "dtype": dtype} | ({"source_tokens": of.get(r["shard_idx"], {})} if sources is not None else {}) for r in written.orderBy("shard_idx").toLocalIterator()]
    whole = {"format": "raw_token_ids", "dtype": dtype, "total_tokens": sum(s["tokens"] for s in shards), "vocab_size": vocabulary, "eod_id": end} | fields
    if stats is not None:
        whole["source_stats"] = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in stats.orderBy("source").collect()}  # a row for each source
    return json.dumps(whole | {"shards": shards}, ensure_ascii=False, indent=2) + "\n"


def build_stats_json(stats: DataFrame, elapsed: float, **fields) -> str:
    rows = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in stats.orderBy("source").collect()}  # a row for each source
    return json.dumps({"manifest": "manifest.json", "elapsed_sec": round(elapsed, 3), "stats": rows} | fields, ensure_ascii=False, indent=2) + "\n"


def put_text(text: str, path: str) -> None:
    """A small text from the driver, written whole under its name."""
    from lexforge.sources.readers import store_of

    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at + ".new") as f:
        f.write(text.encode())
    store.move(at + ".new", at)


def prepare_folder(folder: str, overwrite: bool = False) -> None:
    """Makes a folder for shards. One that holds shards or a manifest fails, or with `overwrite` loses these, nothing else."""
    from pyarrow import fs

    from lexforge.sources.readers import store_of

    store, base = store_of(folder)
    store.create_dir(base, recursive=True)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.is_file]
    old = [x for x in names if x in ("manifest.json", "build_stats.json") or x.startswith("shard_") and x.endswith(".bin")]
    if not overwrite and [x for x in old if x != "build_stats.json"]:
        raise FileExistsError(f"{folder} holds shards or a manifest")
    for x in old:
        store.delete_file(f"{base}/{x}")


def write_lines(df: DataFrame, folder: str, ending: str = ".jsonl", compression: str | None = None) -> DataFrame:
    """df as JSON lines, one file for each partition, compressed by any codec that pyarrow has (zstd, gzip, ...); returns
    (path, rows). Nulls are left out. Files are moved to their names when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lexforge.sources.readers import store_of

        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():05d}{ending}"
        temp, n = f"{path}.{TaskContext.get().taskAttemptId()}", 0
        with store.open_output_stream(temp, compression=compression) as f:
            for b in batches:
                n += b.num_rows
                f.write("".join(x + "\n" for x in b.column(0).to_pylist()).encode())
        store.move(temp, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "rows"])

    return df.select(F.to_json(F.struct(*df.columns)).alias("line")).mapInArrow(run, "path string, rows long")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def header_of(rows: list[dict], order: str = "first") -> list[str]:
    """The columns of rows that need not have the same: as they come up first, or `sorted`."""
    seen = dict.fromkeys(k for r in rows for k in r)
    return sorted(seen) if order == "sorted" else list(seen)


def write_csv(df: DataFrame, path: str, columns: list[str] | str | None = None) -> None:
    """columns: the header's order, or "sorted"; else the table's own. A table without rows leaves a file without any line."""
    names = sorted(df.columns) if columns == "sorted" else (columns or df.columns)
    out = df.select(*names).write.mode("errorifexists")
    out.option("header", not df.isEmpty()).csv(path)


def write_merged(rows: DataFrame, summary: DataFrame, folder: str, order: list[str]) -> None:
    """Merged predictions as JSON lines in order, and their summary as CSV."""
    write_jsonl(rows.orderBy(*order), f"{folder}/predictions")
    write_csv(summary, f"{folder}/summary")


def fetch_list(files: DataFrame) -> DataFrame:
    """files (url, local_dir, filename) -> (line): a download manager's input, three lines for each file, by address."""
    lines = F.array(F.col("url"), F.concat(F.lit("  dir="), "local_dir"), F.concat(F.lit("  out="), "filename"))
    return files.select("url", F.posexplode(lines).alias("k", "line")).orderBy("url", "k").select("line")


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A report's table, of the first `most` rows."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", r"\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def memo(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    """A report: a heading, then sections that are prose or tables."""
    out = [f"# {title}"]
    for name, body in sections:
        out += ["", f"## {name}", "", body if isinstance(body, str) else markdown(body)]
    return "\n".join(out) + "\n"


def line_chart(series: dict[str, list[tuple[float, float]]], title: str, width: int = 640, height: int = 360) -> str:
    """An SVG of lines, y from 0 to 1, from the few points that a summary has."""
    from xml.sax.saxutils import escape

    xs = [x for line in series.values() for x, _ in line] or [0.0]
    low, span = min(xs), (max(xs) - min(xs)) or 1.0
    at = lambda x, y: f"{40 + (x - low) / span * (width - 60):.1f},{height - 30 - y * (height - 60):.1f}"
    body = [f'<polyline fill="none" stroke="hsl({k * 67 % 360},60%,40%)" points="{" ".join(at(*p) for p in sorted(line))}"><title>{escape(str(name))}</title></polyline>' for k, (name, line) in enumerate(series.items())]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="20" y="20">{escape(title)}</text>{"".join(body)}</svg>'


def heat_map(cells: dict[tuple[str, str], float], title: str, size: int = 36) -> str:
    """An SVG of cells (row, column) from 0 to 1, the higher the darker."""
    from xml.sax.saxutils import escape

    rows, columns = (sorted({k[i] for k in cells}, key=str) for i in range(2))
    body = [f'<rect x="{60 + columns.index(c) * size}" y="{40 + rows.index(r) * size}" width="{size}" height="{size}" fill="hsl(210,60%,{95 - 55 * v:.0f}%)"><title>{escape(f"{r}, {c}: {v:.3f}")}</title></rect>' for (r, c), v in cells.items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{80 + size * len(columns)}" height="{60 + size * len(rows)}"><text x="20" y="20">{escape(title)}</text>{"".join(body)}</svg>'


def stacked_bars(shares: dict[str, dict[str, float]], title: str, width: int = 480, bar: int = 24) -> str:
    """An SVG of a bar for each group, parted by its classes' shares."""
    from xml.sax.saxutils import escape

    classes, body = sorted({c for x in shares.values() for c in x}), []
    for k, (name, parts) in enumerate(shares.items()):
        at = 100.0
        body.append(f'<text x="10" y="{56 + k * (bar + 8)}">{escape(str(name))}</text>')
        for c in classes:
            w = parts.get(c, 0.0) * (width - 120)
            body.append(f'<rect x="{at:.1f}" y="{40 + k * (bar + 8)}" width="{w:.1f}" height="{bar}" fill="hsl({classes.index(c) * 67 % 360},50%,55%)"><title>{escape(f"{c}: {parts.get(c, 0.0):.3f}")}</title></rect>')
            at += w
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{60 + len(shares) * (bar + 8)}"><text x="20" y="20">{escape(title)}</text>{"".join(body)}</svg>'


def page(title: str, parts: list[str]) -> str:
    """An HTML page of charts and tables."""
    from html import escape

    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>" + "\n".join(parts) + "\n"


def observed(df: DataFrame, name: str, **columns) -> tuple[DataFrame, object]:
    """df, and what Spark has counted of it when an action over it is done: progress without a pass of its own."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in columns.items()]), o
