"""Readers: corpora in several formats as (source, text, path), token shards and manifests, benchmark files, CSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexforge.functions.text import TEXT_FIELDS, extract_text

#: Aliases of a manifest entry's fields and of the type of all its entries, first found first; fixed values.
PATH_ALIASES = ("path", "file", "filename", "name", "relative_path", "relpath", "token_path", "tokens_path", "shard_path")
COUNT_ALIASES = ("tokens", "num_tokens", "n_tokens", "token_count", "num_items", "length")
DTYPE_ALIASES = ("dtype", "token_dtype", "data_type")
#: Endings of corpus files in a source's folder; fixed values.
ENDINGS = (".parquet", ".jsonl", ".jsonl.zst", ".zst")


def store_of(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace(" ", "%20"))


def source_files(folder: str, shuffle: bool = False, seed: int = 0, limit: int | None = None) -> list[str]:
    """The corpus files of a folder, each once, by name; shuffled by a seeded hash of the name where asked; `limit` of them at
    most. One listing of one folder, on the driver."""
    import hashlib

    from pyarrow import fs

    store, base = store_of(folder)
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(ENDINGS))
    if shuffle:
        names.sort(key=lambda x: (hashlib.md5(f"{seed}:{x}".encode()).hexdigest(), x))
    return [f"{folder.rstrip('/')}/{x}" for x in names[:limit]]


def source_folders(root: str, folders: dict[str, str]) -> dict[str, str]:
    """source -> folder below the root."""
    return {name: f"{root.rstrip('/')}/{sub}" for name, sub in folders.items()}


def corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """A .txt file, or a folder's .txt files by name with an empty line between, as one row (text); fails without any.

    Bytes that are not UTF-8 become replacement characters. For small corpora: one text is one row.
    """
    rows = spark.read.text(path if path.endswith(".txt") else f"{path.rstrip('/')}/*.txt", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda r: r["value"]), "\n\n")
    return rows.agg(F.count("*").alias("n"), text.alias("text")).select(F.when(F.col("n") > 0, F.col("text")).otherwise(F.raise_error(F.lit("no .txt files"))).alias("text"))


def read_or_make(spark: SparkSession, path: str, make, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a JSON lines file if there is one, else those that make() gives; `limit` of them at most."""
    from pyarrow import fs

    store, at = store_of(path)
    rows = jsonl(spark, path, schema) if store.get_file_info(at).type != fs.FileType.NotFound else make()
    return rows if limit is None else rows.limit(limit)


def checkpoints(root: str, pattern: str, named: list[str] = (), wanted: list[str] = (), prefix: str = "") -> list[tuple[str, str]]:
    """(name, path) of checkpoint files: those given as name=path, or the files below root that match the pattern, named by
    their folder without the prefix; only wanted names. Fails if none is left or one is missing."""
    import fnmatch

    from pyarrow import fs

    if named:
        if any("=" not in x for x in named):
            raise ValueError("name=path is expected")
        found = [tuple(x.split("=", 1)) for x in named]
    else:
        store, base = store_of(root)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and fnmatch.fnmatch(x.path[len(base.rstrip("/")) + 1 :], pattern))
        found = [(x.split("/")[-2].removeprefix(prefix), x) for x in files]
    found = [x for x in found if not wanted or x[0] in wanted]
    if not found:
        raise FileNotFoundError("no checkpoints")
    for _, path in found:
        store, at = store_of(path)
        if not store.get_file_info(at).is_file:
            raise FileNotFoundError(path)
    return found


def text_of(df: DataFrame) -> F.Column:
    """The text of a table's rows: its first text field by name, else nothing; nested fields are followed."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name in TEXT_FIELDS:
        if name in fields:
            return extract_text(fields[name], F.col(name))
    return F.lit("")


def corpus(spark: SparkSession, path: str, source: str, strict: bool = False) -> DataFrame:
    """path: parquet, jsonl, jsonl.zst, jsonl.gz or txt by its ending -> (source, text, path). Each file is read once.

    strict: a malformed JSON line fails the read; else it is passed over, as compressed corpora have it.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif name.endswith(".txt"):
        df = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    elif name.endswith((".jsonl", ".json", ".jsonl.zst", ".zst", ".jsonl.gz", ".gz")):
        df = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    else:
        raise ValueError(f"unknown corpus format: {path}")
    return df.select(F.lit(source).alias("source"), text_of(df).alias("text"), F.col("_metadata.file_path").alias("path")).filter("text <> ''")


def corpora(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """source -> paths; all of them in one table."""
    out = None
    for source, all_of in paths.items():
        for p in dict.fromkeys(all_of):
            df = corpus(spark, p, source)
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no paths")
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (n, path, value): n is the line's place in all of them, from 0, by path and place in the file.

    Large files are read in byte ranges by several tasks. A task numbers the lines of each of its ranges, whose counts, a row
    for each range, add up to where the next ones begin. Lines are read twice and not sorted.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            start = b.column(2).to_numpy()
            file = b.column(1).dictionary_encode().indices.to_numpy()
            at = [0, *(1 + np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0))).tolist(), b.num_rows]
            places = []
            for a, z in zip(at, at[1:]):
                key = (b.column(1)[a].as_py(), int(start[a]))
                now, n = key, n if key == now else 0
                places.append(np.arange(n, n + z - a))
                n += z - a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(places), pa.int64())], [*b.schema.names, "k"])

    numbered = rows.mapInArrow(run, "value string, path string, start long, k long")
    ranges = numbered.groupBy("path", "start").agg(F.count("*").alias("__n"))
    before = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranges.select("path", "start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return numbered.join(first, ["path", "start"]).select((F.col("__first") + F.col("k")).alias("n"), "path", "value")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Strict JSON lines, compressed or not; blank lines are passed over."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def kv_records(spark: SparkSession, folder: str, num_keys: int, known: tuple[int, ...] = (75, 140, 300)) -> DataFrame:
    """Benchmark rows (key, value, ordered_kv_records) of a size; other sizes read the largest file, to be cropped."""
    n = num_keys if num_keys in known else max(known)
    return jsonl(spark, f"{folder}/kv-retrieval-{n}_keys.jsonl.gz", "key string, value string, ordered_kv_records array<array<string>>")


def csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """CSV with a header; a byte order mark before it is dropped. typed: num_keys and n as int, all other columns double."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.col(c).cast("int" if c in ("num_keys", "n") else "double").alias(c) for c in df.columns]) if typed else df


def manifest(spark: SparkSession, path: str, limit: int | None = None, check: bool = True) -> DataFrame:
    """A shard manifest -> (shard_idx, path, tokens, dtype), aliases resolved as Python's `or` does: null, empty and zero go on to
    the next. An entry may be a path alone. Relative paths are below the manifest; counts that are not given come from the
    files' sizes; a missing file fails (check). The manifest is one document, read by the driver.
    """
    import json

    store, at = store_of(path)
    with store.open_input_file(at) as f:
        whole = json.loads(f.read().decode())
    if not isinstance(whole.get("shards"), list):
        raise ValueError(f"{path}: no shards")
    base, rows = path.rsplit("/", 1)[0], []
    first = lambda entry, names, default=None: next((entry[x] for x in names if entry.get(x)), default)
    all_of = str(first(whole, DTYPE_ALIASES, "uint16"))
    for k, entry in enumerate(whole["shards"][:limit]):
        entry = {"path": entry} if isinstance(entry, str) else entry
        name = first(entry, PATH_ALIASES)
        if not name:
            raise ValueError(f"{path}: entry {k} has no path")
        name = name if "://" in name or name.startswith("/") else f"{base}/{name}"
        dtype, n = str(first(entry, DTYPE_ALIASES, all_of)), first(entry, COUNT_ALIASES)
        if check:
            own, there = store_of(name)
            if not own.get_file_info(there).is_file:
                raise FileNotFoundError(name)
            n = token_count(name, dtype) if n is None else n
        rows.append((k, name, None if n is None else int(n), dtype))
    if not rows:
        raise ValueError(f"{path}: no shards")
    return spark.createDataFrame(rows, "shard_idx int, path string, tokens long, dtype string")


def npy_header(f) -> tuple[str, tuple[int, ...], int]:
    """(dtype, shape, where the data begin) of an open .npy file."""
    import ast

    head = f.read(10)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = head[6] > 1
    size = int.from_bytes(head[8:10] + (f.read(2) if wide else b""), "little")
    fields = ast.literal_eval(f.read(size).decode("latin1"))
    return fields["descr"], tuple(fields["shape"]), 10 + 2 * wide + size


def token_count(path: str, dtype: str) -> int:
    """Tokens of a flat file by its bytes, which must be whole tokens, or of a .npy file, which must have one dimension."""
    import numpy as np

    store, at = store_of(path)
    if path.endswith(".npy"):
        with store.open_input_file(at) as f:
            shape = npy_header(f)[1]
        if len(shape) != 1:
            raise ValueError(f"{path}: one dimension is expected")
        return shape[0]
    size, width = store.get_file_info(at).size, np.dtype(dtype).itemsize
    if size % width:
        raise ValueError(f"{path}: {size} bytes are not whole tokens of {dtype}")
    return size // width


#: Tokens that a task reads of flat files, whatever the files' and blocks' sizes.
TASK_TOKENS = 1 << 20


class _Ranges(InputPartition):
    """(path, first token, the one after the last) of pieces that a task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(None)
        self.pieces = pieces


class _ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.files = json.loads(options["files"]) if "files" in options else [[options["path"], None]]
        self.dtype = options.get("dtype", "uint16")
        self.block = int(options.get("block", 1 << 20))

    def partitions(self) -> list[_Ranges]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(32) as pool:  # sizes that no manifest gives: a request each
            sizes = list(pool.map(lambda x: token_count(x[0], self.dtype) if x[1] is None else x[1], self.files))
        most = max(1, TASK_TOKENS // self.block) * self.block  # whole blocks
        out, pieces, n = [], [], 0
        for (path, _), size in zip(self.files, sizes):
            for a in range(0, size, most):
                b = min(size, a + most)
                if pieces and n + b - a > most:
                    out.append(_Ranges(pieces))
                    pieces, n = [], 0
                pieces.append((path, a, b))
                n += b - a
        return out + ([_Ranges(pieces)] if pieces else [])

    def read(self, part: _Ranges):
        import numpy as np

        rows, n = [], 0
        for path, first, stop in part.pieces:
            store, at = store_of(path)
            with store.open_input_file(at) as f:
                dtype, _, start = npy_header(f) if path.endswith(".npy") else (self.dtype, (), 0)
                width = np.dtype(dtype).itemsize
                for a in range(first, stop, self.block):
                    b = min(stop, a + self.block)
                    f.seek(start + a * width)
                    rows.append((path, a, np.frombuffer(f.read((b - a) * width), dtype).astype(np.int32)))
                    n += b - a
                    if n >= TASK_TOKENS >> 2:
                        yield _batch(rows)
                        rows, n = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]):
    """(path, token_start, ids) of blocks as an Arrow batch."""
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *[len(r[2]) for r in rows]]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[2] for r in rows])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), ids], ["path", "token_start", "ids"])


class TokenShards(DataSource):
    """Flat or .npy files of token ids: spark.read.format("token_shards").option("dtype", "uint16").load("a.bin"), or the option
    `files`, a JSON list of paths and token counts (null: by the file's size).

    A row for each block of a file; a task reads about TASK_TOKENS, of many small files or of a stretch of a large one, and holds
    a part of them at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "path string, token_start long, ids array<int>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShardReader(dict(self.options))


def token_shards(spark: SparkSession, paths: list[str], dtype: str = "uint16", block: int = 1 << 20, counts: list[int] | None = None) -> DataFrame:
    """counts: tokens of each file, as its manifest says; else the files are asked."""
    import json

    spark.dataSource.register(TokenShards)
    files = json.dumps([list(x) for x in zip(paths, counts or [None] * len(paths))])
    return spark.read.format("token_shards").option("dtype", dtype).option("block", block).option("files", files).load()


def synthetic(spark: SparkSession, n: int | DataFrame, length: int, vocabulary: int, seed: int) -> DataFrame:
    """Rows of `length` + 1 ids from hashes of row, place and seed: n of them, or one for each number `row` that a table gives."""
    at = F.sequence(F.lit(0), F.lit(length))
    one = lambda i: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string"), i.cast("string"))), 1, 7), 16, 10).cast("long") % vocabulary).cast("int")
    rows = n if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "row")
    return rows.withColumn("ids", F.transform(at, one))
