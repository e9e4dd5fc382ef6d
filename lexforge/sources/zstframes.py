"""Large .zst files read by several tasks: their frames are found by headers alone, decompressed apart, and lines that go over frames
joined."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.sources.readers import store_of

#: Magic numbers of the format: of a frame, and of the sixteen kinds of frames to skip; fixed values.
FRAME, SKIP = 0xFD2FB528, 0x184D2A50


def frames(f, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the frames with data in an open file of so many bytes. Blocks are passed over by their headers."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(min(18, size - at))
        magic = int.from_bytes(head[:4], "little")
        if magic & 0xFFFFFFF0 == SKIP:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        if magic != FRAME:
            raise ValueError(f"no zstd frame at {at}")
        flags = head[4]
        single, check = flags >> 5 & 1, flags >> 2 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        while True:
            f.seek(end)
            block = int.from_bytes(f.read(3), "little")
            kind, n = block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError(f"a reserved block at {end}")
            end += 3 + (1 if kind == 1 else n)  # a repeated byte is one byte
            if block & 1:
                break
        end += 4 * check
        if end > size:
            raise ValueError(f"the frame at {at} is cut short")
        yield at, end - at
        at = end


def zst_lines(spark: SparkSession, paths: list[str], step: int = 8 << 20) -> DataFrame:
    """.zst files -> (path, line): their lines, whatever frames they begin and end in; empty ones are left out.

    A task finds the frames of a file, reading headers only; frames are dealt to all tasks. Each is decompressed in steps of
    bounded size and gives its whole lines; what stands before its first and after its last line end are fragments, at most two
    for each frame, which are put together by their places.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = store_of(path)
                size = store.get_file_info(at).size
                with store.open_input_file(at) as f:
                    rows = list(frames(f, size))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([x for x, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["path", "frame", "at", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = ["path", "frame", "kind", "line"]
        for b in batches:
            for path, frame, start, size in zip(*(c.to_pylist() for c in b.columns)):
                store, at = store_of(path)
                rest, first = b"", True
                with store.open_input_file(at) as f:
                    f.seek(start)
                    unpack = zstandard.ZstdDecompressor().decompressobj()
                    left = size
                    while left:
                        raw = f.read(min(step, left))
                        left -= len(raw)
                        parts = (rest + unpack.decompress(raw)).split(b"\n")
                        rest, lines, kinds = parts.pop(), parts, ["line"] * len(parts)
                        if lines and first:
                            kinds[0], first = "head", False
                        if lines:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([frame] * len(lines), pa.int64()), pa.array(kinds), pa.array(lines, pa.binary())], names)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([frame], pa.int64()), pa.array(["middle" if first else "tail"]), pa.array([rest], pa.binary())], names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths) or 1)
    each = files.mapInArrow(found, "path string, frame long, at long, size long").repartition(F.xxhash64("path", "frame"))
    rows = each.mapInArrow(read, "path string, frame long, kind string, line binary")
    parts = rows.filter("kind <> 'line'")
    # a frame with a line end closes the line that is open and opens another; one without adds to it
    upto = Window.partitionBy("path").orderBy("frame", F.expr("kind = 'tail'"))  # two rows for each frame at most
    numbered = parts.withColumn("nth", F.sum(F.expr("CAST(kind = 'tail' AS LONG)")).over(upto))
    joined = numbered.groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("frame", F.expr("kind = 'tail'").alias("last"), "line"))).alias("p"))
    whole = joined.select("path", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["line"])).alias("line"))
    text = F.decode(F.col("line"), "UTF-8")
    return rows.filter("kind = 'line'").select("path", "line").unionByName(whole).filter(F.length("line") > 0).select("path", text.alias("line"))
