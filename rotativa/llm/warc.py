"""Web archives: written one gzip member per record, read back as a stream.

Writing: each task writes its rows to archives of its own in a folder all executors share and reports their paths; the
report is stored before anything is read, so a task that runs again leaves an archive nobody lists and no record twice.
Equal payloads of at least ``least`` bytes are one response, that of the smallest page id, and revisits of it. Which,
is settled by digest and id alone: counts per digest are added up before they are shuffled, and only digests that
repeat are joined back to the pages, by a join whose hot keys Spark can split.

Reading: one task per archive. Compressed bytes are inflated chunk by chunk; a record is framed by its header block and
Content-Length, must end with its gzip member, and both digests are computed while its block passes. Memory is one
record and one chunk. A broken frame, a short file or a wrong digest raises ``ValueError``.

Null html is the empty payload, null url gives no target, a null id stays null. Rows that repeat an id repeat its
record; where they share the smallest id of a payload all of them are responses. An empty table gives an empty archive
list. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_folder
from .common import stored, with_workers

LEAST = 100
CHUNK = 1 << 16
ROLL_BYTES = 1 << 30  # an archive ends after the record with which it reaches this size
HEADER_BYTES = 1 << 20  # longer header blocks are taken for damage
DATE = "2000-01-01T00:00:00Z"  # of capture; given by the caller where it is known
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "path string, records long"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    digits = (record or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def target(url: str) -> str:
    """The url on one header line: white space and control characters percent-encoded, anything else as it is."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed; with ``refers_to`` a revisit, which keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Inflated:
    """The bytes of a gzip file, member by member; never holds more than one chunk beyond what is asked for."""

    def __init__(self, source: BinaryIO):
        self.source, self.packed, self.plain, self.unzip = source, b"", bytearray(), None

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if self.plain:
            raise ValueError("bytes after a record")
        self.packed = self.packed or self.source.read(CHUNK)
        self.unzip = zlib.decompressobj(31) if self.packed else None
        return self.unzip is not None

    def more(self) -> bool:
        """Inflate a little more of this member; False at its end."""
        if self.unzip.eof:
            return False
        if not self.packed and not self.unzip.unconsumed_tail:
            self.packed = self.source.read(CHUNK)
            if not self.packed:
                raise ValueError("the archive ends inside a record")
        try:
            self.plain += self.unzip.decompress(self.unzip.unconsumed_tail or self.packed, CHUNK)
        except zlib.error as damage:
            raise ValueError(f"damaged gzip member: {damage}") from damage
        self.packed = self.unzip.unused_data
        return True

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.plain and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece = bytes(self.plain[:n])
            del self.plain[:n]
            n -= len(piece)
            if piece:
                yield piece

    def head(self) -> bytes:
        """Up to and with the next empty line."""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if len(self.plain) > HEADER_BYTES or not self.more():
                raise ValueError("a header block without end")
        head = bytes(self.plain[:end + 4])
        del self.plain[:end + 4]
        return head


def fields(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"a record starts with {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record header, HTTP header, payload) of each record, checked; the payload of a revisit is empty."""
    stream = Inflated(source)
    while stream.next_member():
        header = fields(stream.head(), "WARC/")
        block, whole = hashlib.sha256(), []
        for piece in stream.take(int(header["content-length"])):
            block.update(piece)
            whole.append(piece)
        ended = b"".join(stream.take(4)) == b"\r\n\r\n"
        while ended and not stream.plain and stream.more():
            pass
        if not ended or stream.plain:
            raise ValueError("a record doesn't end with its member")
        http, _, payload = b"".join(whole).partition(b"\r\n\r\n")
        http_header = fields(http, "HTTP/")
        if header["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise ValueError(f"wrong block digest in {header['warc-record-id']}")
        if header["warc-type"] == "response" and (
            header["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}"
            or int(http_header["content-length"]) != len(payload)
        ):
            raise ValueError(f"wrong payload in {header['warc-record-id']}")
        yield header, http_header, payload


def opened(folder_or_path: str):
    from pyarrow import fs

    if "://" not in folder_or_path and not folder_or_path.startswith("file:"):
        return fs.LocalFileSystem(), folder_or_path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder_or_path))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): pages with their payload's digest, and the response where they revisit one."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"))
    first = (
        keyed.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where(F.col("first") < F.col("last"))
        .drop("last")
    )
    joined = keyed.join(stored(first, "repeated"), "digest", "left")
    return joined.select(
        "page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"),
        F.when((F.col("page_id") != F.col("first")) | F.col("page_id").isNull(), F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; the (path, records) of those that count, stored."""
    with_workers(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        task, out, path, records, n = TaskContext.get(), None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(column for column in batch.columns), strict=True):
                if out is None:
                    path = f"{place}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
                    out, records, n = system.open_output_stream(path, compression=None), 0, n + 1
                out.write(member(record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py(), date)))
                records += 1
                if out.tell() >= roll:
                    out.close()
                    out = done.append((path, records))
        if out is not None:
            out.close()
            done.append((path, records))
        scheme = re.match(r"[a-z0-9]+://[^/]*", folder)
        prefix = scheme[0] if scheme and scheme[0] != "file://" else ""
        yield pa.RecordBatch.from_arrays(
            [pa.array([prefix + p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"]
        )

    return stored(revisits(pages, least).mapInArrow(write, WRITTEN), "archives")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the archives at ``path``; with ``payload`` also the bytes, null for revisits."""
    with_workers(archives.sparkSession)
    shape = f"{READ}, payload binary" if payload else READ

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
        for path in (p.as_py() for batch in batches for p in batch.column(0)):
            system, place = opened(path)
            rows, size = [], 0
            with system.open_input_stream(place, compression=None) as source:
                for header, http, body in read_records(source):
                    kind = header["warc-type"]
                    rows.append((
                        page_of(header["warc-record-id"]), header.get("warc-target-uri"), kind, int(http["content-length"]),
                        header["warc-payload-digest"].removeprefix("sha256:"), page_of(header.get("warc-refers-to")),
                        *([body if kind == "response" else None] if payload else []),
                    ))
                    size += 200 + len(body) * payload
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    # A task each, since ranges are as even as paths are different: archives are read in sequence, many at a time.
    spread = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    return spread.mapInArrow(read, shape)


def archive_folder(spark: SparkSession) -> str:
    shared_folder(spark)
    return scratch_path(spark, "warc")
