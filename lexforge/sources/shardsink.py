"""Token shards as a data source: tasks stream ids into staged files, and the commit names them and writes the manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexforge.sources.readers import store_of
from lexforge.sources.sinks import put_text

SCHEMA = "phase string, shard_idx long, shard_start long, source string, piece array<int>"


@dataclass
class _Shard:
    phase: str
    index: int
    path: str
    tokens: int = 0
    source_tokens: dict[str, int] = field(default_factory=dict)


@dataclass
class _Written(WriterCommitMessage):
    shards: list[_Shard]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.dtype = options.get("dtype", "uint16")
        self.vocabulary = int(options.get("vocabulary", 0)) or None
        self.fields = json.loads(options.get("fields", "{}"))
        self.overwrite = overwrite
        self.stage = f"{self.folder}/_stage-{uuid.uuid4().hex}"
        if not overwrite and self.standing():
            raise FileExistsError(f"{self.folder} holds shards or a manifest")

    def standing(self) -> list[str]:
        """Shards and manifests below the folder, and nothing else."""
        from pyarrow import fs

        store, base = store_of(self.folder)
        if store.get_file_info(base).type == fs.FileType.NotFound:
            return []
        found = [x for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and "/_stage-" not in x.path]
        return [x.path for x in found if x.base_name == "manifest.json" or x.base_name.startswith("shard_") and x.base_name.endswith(".bin")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One pass over rows in order of (phase, shard_idx, shard_start): a shard's ids go to its file as they come, as arrays."""
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        store, stage = store_of(self.stage)
        store.create_dir(stage, recursive=True)
        most = min(np.iinfo(self.dtype).max + 1, self.vocabulary or 1 << 62)
        attempt, out, now, file = TaskContext.get().taskAttemptId(), [], None, None
        try:
            for b in iterator:
                phase, index, start, source, piece = (b.column(k) for k in range(5))
                sizes = pc.list_value_length(piece).to_pylist()
                for k, n in enumerate(sizes):
                    key = (phase[k].as_py(), index[k].as_py())
                    if now is None or key != (now.phase, now.index):
                        if file is not None:
                            file.close()
                        now = _Shard(*key, f"{self.stage}/{attempt}-{len(out)}.bin")
                        out.append(now)
                        file = store.open_output_stream(f"{stage}/{attempt}-{len(out) - 1}.bin")
                    if start[k].as_py() != now.tokens:
                        raise ValueError(f"{key}: a piece at {start[k].as_py()} comes after {now.tokens} tokens")
                    ids = piece[k].values.to_numpy(zero_copy_only=False)
                    if len(ids) and (ids.min() < 0 or ids.max() >= most):
                        raise ValueError(f"{key}: an id is out of range")
                    file.write(ids.astype(self.dtype).tobytes())
                    now.tokens += n
                    name = source[k].as_py() or ""
                    now.source_tokens[name] = now.source_tokens.get(name, 0) + n
        finally:
            if file is not None:
                file.close()
        return _Written(out)

    def home(self, phase: str | None) -> str:
        return f"{self.folder}/{phase}" if phase else self.folder

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All tasks are done: old shards go where that is wanted, staged files get their names, then a manifest for each phase. A
        folder without a manifest is not whole."""
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s.phase or "", s.index))
        store, base = store_of(self.folder)
        for old in sorted(self.standing(), key=lambda x: not x.endswith("manifest.json")) if self.overwrite else ():
            store.delete_file(old)
        by: dict[str, list[_Shard]] = {}
        for s in shards:
            by.setdefault(s.phase or "", []).append(s)
        for phase, own in by.items():
            store.create_dir(store_of(self.home(phase))[1], recursive=True)
            for s in own:
                store.move(store_of(s.path)[1], store_of(f"{self.home(phase)}/shard_{s.index:06d}.bin")[1])
        for phase, own in by.items():
            entries = [{"path": f"shard_{s.index:06d}.bin", "tokens": s.tokens, "dtype": self.dtype, "source_tokens": dict(sorted(s.source_tokens.items()))} for s in own]
            whole = {"format": "raw_token_ids", "dtype": self.dtype, "total_tokens": sum(s.tokens for s in own)} | ({"vocab_size": self.vocabulary} if self.vocabulary else {}) | ({"phase": phase} if phase else {}) | self.fields
            put_text(json.dumps(whole | {"shards": entries}, ensure_ascii=False, indent=2) + "\n", f"{self.home(phase)}/manifest.json")
        self._unstage()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._unstage()

    def _unstage(self) -> None:
        from pyarrow import fs

        store, stage = store_of(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class TokenShardSink(DataSource):
    """df.write.format("token_shard_sink"): rows of SCHEMA, a shard's rows in order in one task."""

    @classmethod
    def name(cls) -> str:
        return "token_shard_sink"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def write_shards(pieces: DataFrame, folder: str, dtype: str = "uint16", vocabulary: int | None = None, overwrite: bool = False, **fields) -> None:
    """pieces (shard_idx, shard_start, piece, maybe phase and source) -> shard_<index>.bin and manifest.json in a folder that all executors
    reach, below a folder for each phase if there are phases.

    All or nothing: files lie in a stage folder until every task is done, those of lost and repeated attempts among them; if a task
    fails for good, nothing is left. Without `overwrite` a folder that holds shards or a manifest is an error, with it they
    are replaced at the commit. An id that is negative, or not below the vocabulary or the type's range, fails the write.
    A shard is streamed by one task, whatever its size: pieces move through one shuffle, and a task holds a batch of them.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(TokenShardSink)
    phase = F.col("phase") if "phase" in pieces.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in pieces.columns else F.lit(None).cast("string")
    rows = pieces.select(phase.alias("phase"), F.col("shard_idx").cast("long"), F.col("shard_start").cast("long"), source.alias("source"), F.col("piece").cast("array<int>").alias("piece"))
    out = rows.repartition("phase", "shard_idx").sortWithinPartitions("phase", "shard_idx", "shard_start").write.format("token_shard_sink").mode("overwrite" if overwrite else "append")
    out = out.option("dtype", dtype).option("fields", json.dumps(fields))
    (out.option("vocabulary", vocabulary) if vocabulary else out).save(folder)
