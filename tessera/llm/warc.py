"""WARC archives: one gzip member for each record, written by tasks and read back in sequence.

The writer keeps one archive open in each task and starts another when it is full.  The reader streams an archive through zlib in blocks, frames
records by Content-Length, and checks the digests of blocks and payloads as the bytes pass, so its memory is one record's payload at most.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_folder, store

BLOCK = 1 << 18
ARCHIVE = 64 << 20  # compressed bytes after which a task starts another archive
REVISIT_FROM = 100  # payload bytes from which a repeated payload is written once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedArchive(ValueError):
    pass


def record(kind: str, record_id: str, payload: bytes, digest: str, uri: str | None = None, refers_to: str | None = None) -> bytes:
    """One record as a gzip member.  ``digest`` is the hex SHA-256 of the full payload, which a revisit does not repeat."""
    body = payload if kind == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri and uri.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE if kind == "revisit" else None), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return pack.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + pack.flush()


class _Stream:
    """Decompressed bytes of a file of gzip members, a member at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.packed, self.plain, self.unzip = file, b"", bytearray(), None

    def next_member(self) -> bool:
        self.packed = self.packed or self.file.read(BLOCK)
        self.unzip = zlib.decompressobj(16 + zlib.MAX_WBITS)
        self.plain.clear()
        return bool(self.packed)

    def _more(self) -> bool:
        """Decompress a little more of this member; False at its end."""
        while not self.unzip.eof:
            self.packed = self.packed or self.file.read(BLOCK)
            if not self.packed:
                raise DamagedArchive("the archive ends inside a record")
            try:
                got = self.unzip.decompress(self.packed, BLOCK)
            except zlib.error as e:
                raise DamagedArchive(str(e)) from e
            self.packed = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            self.plain += got
            if got:
                return True
        return False

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                raise DamagedArchive("a header line has no end")
        got = bytes(self.plain[:end])
        del self.plain[:end + 2]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise DamagedArchive("a record is shorter than its Content-Length")
            got = bytes(self.plain[:n])
            del self.plain[:len(got)]
            n -= len(got)
            yield got

    def finish(self) -> bytes:
        while self._more():
            pass
        return bytes(self.plain)


def _check(name: str, value: str | None, digest) -> None:
    if not value:
        return
    kind, _, want = value.partition(":")
    if kind.lower() == "sha256" and want.lower() not in (digest.hexdigest(), base64.b32encode(digest.digest()).decode().lower()):
        raise DamagedArchive(f"{name} does not match")


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, payload) of each record.  A damaged record raises."""
    stream = _Stream(file)
    while stream.next_member():
        if not stream.line().startswith(b"WARC/"):
            raise DamagedArchive("a member does not begin with a WARC version")
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isdigit():
            raise DamagedArchive("a record has no Content-Length")
        http = head.get("content-type", "").startswith("application/http")
        block, payload, body, early = hashlib.sha256(), hashlib.sha256(), bytearray(), b""
        for part in stream.take(int(head["content-length"])):
            block.update(part)
            if http:  # the payload begins behind the HTTP header
                early += part
                end = early.find(b"\r\n\r\n")
                if end < 0:
                    continue
                part, early, http = early[end + 4:], b"", False
            payload.update(part)
            body += part
        _check("WARC-Block-Digest", head.get("warc-block-digest"), block)
        if head.get("warc-type") != "revisit":
            _check("WARC-Payload-Digest", head.get("warc-payload-digest"), payload)
        if stream.finish() != b"\r\n\r\n":
            raise DamagedArchive("a record is longer than its Content-Length")
        yield head, bytes(body)


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """(page, url, payload, digest, first): of equal payloads of at least ``least`` bytes, ``first`` is the smallest key; else null."""
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return rows.join(firsts, "digest", "left")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the records of ``plan_records`` below ``folder``; returns the stored list of archives (path, records).

    A file is named by its task attempt, and only files of attempts that ended well are listed: what a lost or repeated attempt left is never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        made, out, size, count = [], None, 0, 0
        for batch in batches:
            for page, url, payload, digest, first in zip(*(batch.column(c) for c in ("page", "url", "payload", "digest", "first"))):
                page, first = page.as_py(), first.as_py()
                again = first is not None and page is not None and page != first
                name = lambda x: f"<urn:page:{'' if x is None else x}>"
                data = record("revisit" if again else "response", name(page), payload.as_py(), digest.as_py(), url.as_py(), name(first) if again else None)
                if out is None:
                    path = f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(made):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, size, count = system.open_output_stream(path, compression=None), 0, 0
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["path", "records"])

    return store(records.select("page", "url", "payload", "digest", "first").mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest, uri, payload) of each record, one archive after another in each task.

    For a revisit the payload is empty and its length null; the digest is that of its header, the full payload's.
    """
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("uri", pa.string()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as file:
                    for head, payload in read_records(file):
                        kind = head.get("warc-type")
                        whole = kind != "revisit"
                        digest = hashlib.sha256(payload).hexdigest() if whole else head.get("warc-payload-digest", "").partition(":")[2]
                        rows.append((head.get("warc-record-id"), kind, head.get("warc-refers-to"), len(payload) if whole else None, digest, head.get("warc-target-uri"), payload))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    spread = archives.select("path").repartition(F.col("path"))
    return spread.mapInArrow(read, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, uri string, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Write a record for each page, read the archives back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload.  Of pages with equal payloads of at least ``least`` bytes the one with the smallest key is the response and the others
    revisit it; smaller payloads are all responses, and so are pages without a key.  Rows that repeat the smallest key are responses too.  Line breaks
    in a url are escaped; further columns are ignored.
    """
    kind = pages.schema[key].dataType
    folder = new_folder(pages.sparkSession, "warc")
    archives = write_archives(plan_records(pages, key, url, html, least), folder)
    back = read_archives(archives, folder).drop("payload", "uri")
    page = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("")).cast(kind)
    back = store(back.select(page("record_id").alias("page"), "record_type", page("refers_to").alias("refers_to"), "payload_bytes", "payload_digest"), "records")
    # A revisit's length is that of the response it names.
    named = back.filter("record_type = 'response'").groupBy(F.col("page").alias("to"), F.col("payload_digest").alias("its_digest")).agg(F.max("payload_bytes").alias("its_bytes"))
    rows = back.join(named, (back["refers_to"] == named["to"]) & (back["payload_digest"] == named["its_digest"]), "left")
    return rows.select(F.col("page").alias(key), F.coalesce("payload_bytes", "its_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
