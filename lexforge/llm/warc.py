"""WARC records in ZIP-packaged archives: written with an index, read back by ranges without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import cut, mapped, partitions, pieces, shared_dir, utf8
from lexforge.operators.bitmap import bitmap, marked

#: Verdicts up to this many are broadcast.
BROADCAST_ROWS = 1_000_000
#: An archive is closed when its records have this many bytes.
ROLL = 128 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP -----------------------------------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members one after another; ZIP64 fields where sizes, offsets or counts need them, or always."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members, self.open = out, zip64, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow in a data descriptor, so members stream."""
        raw = name.encode()
        self.open = {"name": raw, "at": self.at, "crc": 0, "size": 0}
        self._put(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw)
        self._put(struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.open["crc"] = zlib.crc32(data, self.open["crc"])
        self.open["size"] += len(data)
        self._put(data)

    def end(self) -> None:
        m = self.open
        self._put(struct.pack("<4sI2Q", b"PK\x07\x08", m["crc"], m["size"], m["size"]))
        self.members.append(m)
        self.open = None

    def close(self) -> None:
        start = self.at
        for m in self.members:
            big = self.zip64 or max(m["size"], m["at"]) >= 0xFFFFFFFF
            extra = struct.pack("<2H3Q", 1, 24, m["size"], m["size"], m["at"]) if big else b""
            size, at = (0xFFFFFFFF, 0xFFFFFFFF) if big else (m["size"], m["at"])
            self._put(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        n, size = len(self.members), self.at - start
        if self.zip64 or n >= 0xFFFF or self.at >= 0xFFFFFFFF:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))


def members(f, length: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, data offset, size) of each member, from the central directory; f has seek and read.

    Reads the file's tail, the ZIP64 locator and record where the end record asks for them, the directory, and the fixed
    part of each local header.
    """

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, length - 65_557)
    tail = read(tail_at, length - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<H2I", tail[k + 10 : k + 20])
    if n == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = tail_at + k - 20
        mark, _, record, _ = struct.unpack("<4sIQI", read(where, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, n, size, start = struct.unpack("<4s28xQ2Q", read(record, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 record")
    directory, at, out = read(start, size), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<2I3H", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        e, stop = at + 46 + n_name, at + 46 + n_name + n_extra
        while e + 4 <= stop:
            kind, many = struct.unpack_from("<2H", directory, e)
            if kind == 1:  # those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{many // 8}Q", directory, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            e += 4 + many
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"bad local header of {name}")
        a, b = struct.unpack_from("<2H", local, 26)
        out[name] = (method, header + 30 + a + b, packed)
        at = stop + n_note
    return out


# --- WARC ----------------------------------------------------------------------------------------------------------


def name_of(page_id: int | None, sha: str, row: int) -> str:
    """The record's id. row tells apart what shares a page_id, or has none, and a payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}:{row}')}>"


def record(page_id: int | None, row: int, url: str, payload: bytes, sha: str, of: tuple[int | None, int] | None) -> bytes:
    """One gzipped record. of: page_id and row of the response that it revisits; a revisit has the response's HTTP header,
    Content-Length included, without the payload. A null page_id has no header of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if of is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if of is None else 'revisit'}",
        f"WARC-Record-ID: {name_of(page_id, sha, row)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub('[' + chr(0) + '-' + chr(32) + ']', '', url)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(of[0], sha, of[1])}"]
        head += [f"X-Refers-To-Page-ID: {of[0]}"] if of[0] is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> dict:
    """A gzipped record's named fields, HTTP fields under `http`, and its payload."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return out | {"payload": payload}


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, zip64: bool = False) -> DataFrame:
    """pages (page_id, row, url, html, payload_digest, response struct<page_id,row>) -> (archive string, records long): files
    in the shared folder. response: the record that this one revisits, null for a response.

    Each task writes archives of its own under a name of its attempt and moves them to their final name when they are
    whole, so a retried or doubled task leaves the same files and no halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        now, done = None, 0
        out: list[tuple[str, int]] = []

        def close() -> None:
            z, stream, temp, final, index = now
            z.end()
            z.begin(INDEX)
            z.write("".join(sorted(index)).encode())
            z.end()
            z.close()
            stream.close()
            store.move(temp, final)
            out.append((final.rsplit("/", 1)[-1], len(index)))

        for b in pieces(batches, "html"):
            own, of = zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(5).to_pylist()
            for (page, row), url, html, sha, first in zip(own, b.column(2).to_pylist(), utf8(b.column(3)), b.column(4).to_pylist(), of):
                if now is None:
                    final = f"{base}/part-{part:06d}-{done:04d}.wacz"
                    temp = f"{final}.{attempt}"
                    stream = store.open_output_stream(temp)
                    now = (StoredZip(stream, zip64), stream, temp, final, [])
                    now[0].begin(WARC)
                z, index = now[0], now[4]
                raw = record(page, row, url or "", html, sha, first and (first["page_id"], first["row"]))
                index.append(f"{'-' if page is None else f'{page:020d}'} {json.dumps({'url': url, 'digest': sha, 'offset': z.open['size'], 'length': len(raw)})}\n")
                z.write(raw)
                if z.open["size"] >= roll:
                    close()
                    now, done = None, done + 1
        if now is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["archive", "records"])

    return mapped(pages.select("page_id", "row", "url", "html", "payload_digest", "response"), run, "archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """archives (archive string) in the folder -> a row for each indexed record, by range reads of stored members."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            with store.open_input_file(f"{base}/{name}") as f:
                found = members(f, f.size())
                for index in [x for x in found if x.startswith("indexes/")]:
                    method, at, size = found[index]
                    warc_method, warc_at, _ = found[WARC]
                    if method or warc_method:
                        raise ValueError(f"{name}: members must be stored")
                    f.seek(at)
                    lines, rows = io.BytesIO(f.read(size)), []
                    for line in lines:
                        entry = json.loads(line.decode().split(" ", 1)[1])
                        f.seek(warc_at + entry["offset"])
                        r = parsed(f.read(entry["length"]))
                        response = r["warc-type"] == "response"
                        # a response's figures come from the payload itself, a revisit's from its headers
                        size_of = len(r["payload"]) if response else int(r["http"]["content-length"])
                        sha = digest(r["payload"]) if response else r["warc-payload-digest"].removeprefix("sha1:")
                        page, refers = (int(r[x]) if x in r else None for x in ("x-page-id", "x-refers-to-page-id"))
                        rows.append((page, size_of, sha, r["warc-type"], refers, r["warc-target-uri"], name, entry["offset"], entry["length"]))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select("archive").mapInArrow(run, schema)


def with_verdicts(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, row, url, html, payload_digest, response): of the rows of an equal payload of
    `least` bytes or more, the one with the smallest page_id has a null response, and is that of the others.

    Verdicts are found without the texts, one for each page_id and
    digest of payloads that occur twice or more, and joined back on these, by a broadcast while they are few; beyond, only rows that
    a bitmap of their digests lets through are shuffled, and spread by their page_id. Of rows that share both, which are
    written to the shared folder first, the one with the smallest place is the response. row is 0 for a response that others
    revisit, else 1 and the row's place in its part of the input; page_id, digest and row name a record.
    """
    schema = "page_id long, url string, html string, row long, payload_digest string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in pieces(batches, "html"):
            html = utf8(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(range(at, at + len(html)), pa.int64()), pa.array(map(digest, html), pa.string()), pa.array(map(len, html), pa.int64())],
                [*b.schema.names, "row", "payload_digest", "n"],
            )
            at += len(html)

    hashed = mapped(pages.select("page_id", "url", "html"), run, schema)
    slim = cut(hashed.groupBy("page_id", "payload_digest", "n").agg(F.count("*").alias("rows")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    first = slim.groupBy("payload_digest").agg(F.min(order).alias("f"), F.sum("rows").alias("copies")).filter("copies > 1")
    verdicts = cut(slim.filter(F.col("n") >= least).join(first, "payload_digest").select(
        F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "rows", F.struct(F.col("f.page_id").alias("page_id"), F.lit(0).cast("long").alias("row")).alias("response")
    ))
    copied = verdicts.count()
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest"))
    # only copies need a verdict: the others' texts go no way but to their archive
    if copied <= BROADCAST_ROWS:
        joined = hashed.join(F.broadcast(verdicts), same, "left")
    else:
        pages_, size = bitmap(verdicts, F.col("__digest"), copied)
        each = marked(hashed, F.col("payload_digest"), pages_, size)
        joined = each.filter("NOT __hit").drop("__hit").unionByName(each.filter("__hit").drop("__hit").join(verdicts, same, "left"), allowMissingColumns=True)
    joined = joined.drop("n")
    of_first = F.col("response").isNotNull() & F.col("page_id").eqNullSafe(F.col("response.page_id"))
    place, last = F.col("row") + 1, ["page_id", "row", "url", "html", "payload_digest", "response"]
    sure = joined.filter(~(of_first & (F.col("rows") > 1))).withColumns({"row": F.when(of_first, F.lit(0).cast("long")).otherwise(place), "response": F.when(~of_first, F.col("response"))}).select(*last)
    if verdicts.filter(F.col("__page").eqNullSafe(F.col("response.page_id")) & (F.col("rows") > 1)).isEmpty():
        return sure
    # rows that share the first's page_id and payload are written down before one of them is chosen
    equal = cut(joined.filter(of_first & (F.col("rows") > 1)).select(*last))
    chosen = equal.groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.min("row").alias("__row"))
    first = F.col("row") == F.col("__row")
    named = equal.join(chosen, same).withColumns({"response": F.when(~first, F.col("response")), "row": F.when(first, F.lit(0).cast("long")).otherwise(place)})
    return sure.unionByName(named.select(*last))


def warc_round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, roll: int = ROLL) -> DataFrame:
    """pages (page_id, url, html, ...) -> what the archives say: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and url, archive, offset, length. A record for each row.

    Archives go to a new folder below the shared one (or to `folder`, a URI that pyarrow opens). A null html is an empty
    payload and a null url an empty URI. A null page_id counts as larger than any other. Rows that repeat a page_id
    write a record each; if their payloads are equal too, one of them is the response and the others revisit its
    page_id. An empty table gives no rows.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    archives = cut(write_archives(with_verdicts(pages, least), folder, roll))
    return read_archives(archives.repartition(partitions(pages.sparkSession)), folder)
