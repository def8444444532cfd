"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each its own gzip member, by all tasks in parallel. Of pages
with equal payloads of 1,000 bytes or more one is a response and the others are revisits of it. The index
has a line per record, sorted by reversed-host URL key, in compressed blocks; a sparse directory has the first key of
every block. A lookup binary-searches the directory and the block, then reads one range of the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, slices, spread_join, written

REVISIT_BYTES, BLOCK_LINES, ARCHIVE_BYTES = 1000, 2000, 256_000_000
#: Captures and archive bytes that a part of the index stands for at most; repeated payloads whose digests are sent to all tasks at most.
PART_LINES, PART_BYTES, FEW = 500_000, 512_000_000, 250_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: When the pages were fetched is not known.
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort-friendly key: host reversed and comma-separated, then path and query; no scheme, user, port 80/443, www or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """A record's name follows from its page, so that revisits can name their response without looking for it. Repeated rows are one record written again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {one_line(url)}')}>"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None = None, refers_uri: str | None = None) -> bytes:
    """One gzip member: an HTTP response, or a revisit with its HTTP head alone, which names the record that has the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_uri, digest)}", f"WARC-Refers-To-Target-URI: {one_line(refers_uri)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a revisit has none."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Archive:
    """A file that rolls over at a size; each has a fresh name, so a task that runs again never overwrites."""

    def __init__(self, root: str):
        self.store, self.folder = _filesystem(root)
        self.store.create_dir(self.folder)
        self.out, self.at = None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        start, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write pages (page_id, url, html, digest, kind, refers_to, refers_uri) under root; a capture row each: surt, page_id, archive, start, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            archive = archive or _Archive(root)
            for part in slices(batch, "html"):
                keys, names, starts, lengths = [], [], [], []
                for x in part.to_pylist():
                    data = record(x["page_id"], x["url"], x["kind"], x["html"].encode(), x["digest"], x["refers_to"], x["refers_uri"])
                    name, start = archive.add(data)
                    keys.append(surt(x["url"]))
                    names.append(name)
                    starts.append(start)
                    lengths.append(len(data))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.column("page_id"), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["surt", "page_id", "archive", "start", "length"])
        if archive is not None:
            archive.close()

    return pages.mapInArrow(write, "surt string, page_id long, archive string, start long, length long")


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Sort captures by key and write them in parts: first, last, file, one row for each part.

    A part is a file of compressed blocks and, beside it, its sparse directory: a line with the first key, start and length of every block. There are as many parts
    as the archives' bytes and the captures ask for, and one for each shuffle partition at least, so that reading them back is the work of many tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(root)
        store.create_dir(folder)
        name, at, out, book, lines, ends = f"{uuid.uuid4().hex}.cdx", 0, None, None, [], []

        def block() -> None:
            nonlocal at, out, book, lines
            if lines:
                out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                book = book or store.open_output_stream(f"{folder}/{name}.dir", compression=None)
                data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode(), 6)
                out.write(data)
                book.write(json.dumps([lines[0][0], at, len(data)], separators=(",", ":")).encode() + b"\n")
                ends[1:] = [lines[-1][0]]
                at, lines = at + len(data), []

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "archive", "start", "length")), strict=True):
                ends = ends or [x[0]]
                lines.append(x)
                if len(lines) == BLOCK_LINES:
                    block()
        block()
        if out is not None:
            out.close()
            book.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (*ends, name)], ["first", "last", "file"])

    size = captures.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    parts = max(-(-size.n // PART_LINES), -(-(size.bytes or 0) // PART_BYTES), min(size.n, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    ordered = captures.repartitionByRange(parts, "surt", "page_id", "archive", "start").sortWithinPartitions("surt", "page_id", "archive", "start")
    return ordered.mapInArrow(write, "first string, last string, file string")


class Directory:
    """The sparse directory of one part of an index, opened where it is used: entries by key, read by range."""

    def __init__(self, file: str, index_root: str, archive_root: str):
        self.store, self.index = _filesystem(index_root)
        _, self.archives = _filesystem(archive_root)
        self.file, self.handles, self.held = file, {}, (None, [], [])
        with self.store.open_input_stream(f"{self.index}/{file}.dir", compression=None) as f:
            self.rows = [json.loads(x) for x in f.read().splitlines()]
        self.firsts = [r[0] for r in self.rows]

    def close(self) -> None:
        for h in self.handles.values():
            h.close()

    def _read(self, path: str, start: int, length: int) -> bytes:
        if path not in self.handles:
            if len(self.handles) >= 64:
                self.handles.pop(next(iter(self.handles))).close()
            self.handles[path] = self.store.open_input_file(path)
        return self.handles[path].read_at(length, start)

    def _block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            _, start, length = self.rows[i]
            lines = [json.loads(x) for x in zlib.decompress(self._read(f"{self.index}/{self.file}", start, length)).split(b"\n")]
            self.held = (i, [x[0] for x in lines], lines)
        return self.held[1:]

    def captures(self, key: str) -> Iterator[tuple]:
        """Every capture of a key: (surt, page_id, archive, start, length). Its run of blocks starts before the first block that begins at or after it."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.rows) and self.firsts[i] <= key:
            keys, lines = self._block(i)
            yield from lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            i += 1

    def fetch(self, capture: tuple) -> tuple[dict[str, str], bytes]:
        return parse(self._read(f"{self.archives}/{capture[2]}", capture[3], capture[4]))


def lookup(keys: DataFrame, directory: DataFrame, index_root: str, archive_root: str) -> DataFrame:
    """Read back all captures of the distinct keys (surt): surt, page_id, payload_bytes, payload_digest, record_type, refers_to, read_bytes, read_digest.

    A key goes to the parts of the index that can hold it. A task streams through its keys, part by part: it opens the
    part's directory, searches it and its blocks, and reads records by range; it holds one block and a few records.
    directory has a row for each part, of which there are few (half a gigabyte of archives each), and these are all that the driver sees.
    """
    kinds = [("surt", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("read_bytes", pa.int64()), ("read_digest", pa.string())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, out = None, []
        for batch in batches:
            for file, k in zip(batch.column("file").to_pylist(), batch.column("surt").to_pylist(), strict=True):
                if book is None or book.file != file:
                    if book is not None:
                        book.close()
                    book = Directory(file, index_root, archive_root)
                for capture in book.captures(k):
                    headers, body = book.fetch(capture)
                    whole = headers["WARC-Type"] == "response"
                    out.append((k, int(x) if (x := headers["X-Page-ID"]) else None, int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], int(headers["X-Refers-To-Page-ID"]) if not whole else None, len(body) if whole else None, hashlib.sha1(body).hexdigest() if whole else None))
                    if len(out) == 1000:
                        yield batch_of(out)
                        out = []
        if book is not None:
            book.close()
        yield batch_of(out)

    known = [tuple(r) for r in directory.select("first", "last", "file").orderBy("first", "last").collect()]
    kept = keys.sparkSession.sparkContext.broadcast(known)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = kept.value
        lasts = [p[1] for p in parts]  # parts follow each other in key order
        for batch in batches:
            files, keys_ = [], []
            for k in batch.column("surt").to_pylist():
                i = bisect.bisect_left(lasts, k)
                while i < len(parts) and parts[i][0] <= k:
                    files.append(parts[i][2])
                    keys_.append(k)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(keys_, pa.string())], ["file", "surt"])

    wanted = keys.select("surt").distinct().mapInArrow(route, "file string, surt string")
    wanted = wanted.repartitionByRange(max(1, len(known)), "file").sortWithinPartitions("file", "surt")
    return wanted.mapInArrow(find, "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, read_bytes long, read_digest string")


def marked(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest (SHA-1 of the UTF-8 payload), kind, refers_to and refers_uri.

    A null html is an empty payload. Rows tied at the largest page_id of equal payloads are all responses; a row without
    page_id is a response only if no equal payload has one. A null url has the empty key.

    Which payloads repeat is decided on digests alone. These are few as a rule, and the pages stay where they are; where they are more than
    250,000, pages meet them in a shuffle that deals out the copies of one payload. Payloads under 1,000 bytes take no part in it.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long_ = F.octet_length("html") >= REVISIT_BYTES
    first = pages.where(long_).groupBy(F.unhex("digest").alias("d")).agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1 and top.page_id is not null")
    first = written(first.select("d", F.col("top.page_id").alias("first"), F.col("top.url").alias("uri")), "repeated")
    rows = pages.withColumn("d", F.when(long_, F.unhex("digest")))
    if first.count() <= FEW:
        joined = rows.join(F.broadcast(first), "d", "left")
    else:
        some = rows.where("d is not null")
        joined = spread_join(some, first, ["d"], "left", ["page_id", "url"]).unionByName(rows.where("d is null").withColumn("first", F.lit(None).cast("long")).withColumn("uri", F.lit(None).cast("string")))
    later = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return joined.select("page_id", "url", "html", "digest", F.when(later, "revisit").otherwise("response").alias("kind"), F.when(later, F.col("first")).alias("refers_to"), F.when(later, F.col("uri")).alias("refers_uri"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write archives and index for pages in the shared folder, then look every URL key up and read its records back.

    What a response's payload is comes from the body that was read; a revisit has no body, so its header says.
    """
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    captures = written(write_archives(marked(pages), f"{root}/archive"), "captures")
    directory = written(write_index(captures, f"{root}/index"), "directory")
    found = lookup(captures, directory, f"{root}/index", f"{root}/archive")
    return found.withColumn("payload_bytes", F.coalesce("read_bytes", "payload_bytes")).withColumn("payload_digest", F.coalesce("read_digest", "payload_digest"))
