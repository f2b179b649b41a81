"""WARC archives as a chunked record table.

A payload is never one value: it is rows of (record, chunk number, at most ``CHUNK`` bytes), and its
digest is carried from chunk to chunk. A record's HTTP block is written with the chunked transfer
coding, so each chunk row becomes one run of lines and the archive is produced by Spark's own text
writer (line separator CRLF, gzip, one archive per partition, committed by the task commit protocol).
Reading streams the lines of each archive back into chunk rows and checks sizes and digests.

Records with equal payloads (digest and size) of at least ``min_bytes``: the least page_id is the
response, the others are revisits that name it. Only (page, size, digest) rows are grouped, with a
partial minimum first, so a payload shared by a third of all pages costs one row per task.

Memory: a page as it is read, then one chunk at a time; a record's chunks are sorted, and spilled, as rows.

Defined results: a null payload is empty; a null url is left out; control characters in a url are
percent-encoded; a null page_id takes part as larger than any other; rows that repeat a page and its
payload are records of one type; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, payload_bytes long, payload_digest string, last boolean, data binary"


def chunked(records: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """All columns but the payload, once per chunk: chunk_no, data, last; an empty payload has one empty chunk."""
    size = F.octet_length(payload)
    count = F.greatest(F.lit(1), F.ceil(size / chunk)).cast("int")
    rows = records.withColumn("_chunks", count).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    data = F.substring(F.col(payload), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return rows.withColumn("data", data).withColumn("last", F.col("chunk_no") == F.col("_chunks") - 1).drop("_chunks", payload)


def digests(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, text_key, payload_bytes, payload_digest: SHA-1 in base 32, carried over the chunk rows."""
    rows = chunked(pages.select(F.col("page_id").cast("long").alias("page_id"), C.row_key("html").alias("text_key"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")), "payload", chunk)

    def run(batches):
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            out = []
            for page, key, _, data, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha.update(data)
                size += len(data)
                if last:
                    out.append((page, key, size, base64.b32encode(sha.digest()).decode()))
                    sha, size = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["page_id", "text_key", "payload_bytes", "payload_digest"])

    return rows.select("page_id", "text_key", "chunk_no", "data", "last").mapInArrow(run, "page_id long, text_key long, payload_bytes long, payload_digest string")


def record_types(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to (null: a response) and revisit to the rows of ``digests``."""
    first = found.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = found.join(first, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "text_key", "payload_bytes", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _record_id(page) -> F.Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), F.col("payload_digest")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _safe(url) -> F.Column:
    for code in (9, 10, 13):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK, date: str = DATE) -> None:
    """Write one record per page to gzipped archives in the folder ``path``.

    Payloads are cut into chunk rows before anything is shuffled or sorted; a record's rows meet in one task,
    in order, and become its lines one by one.
    """
    types = C.written(record_types(digests(pages, chunk), min_bytes), "warc-types")
    once = types.dropDuplicates(["page_id", "text_key"])
    own = pages.select(
        F.col("page_id").cast("long").alias("id"), C.row_key("html").alias("key"), F.monotonically_increasing_id().alias("row"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = chunked(own, "payload", chunk)
    rows = rows.join(once, rows.id.eqNullSafe(once.page_id) & (rows.key == once.text_key)).where("NOT revisit OR chunk_no = 0")
    size = F.col("payload_bytes")
    full = F.floor(size / chunk)
    rest = size - full * chunk
    digits = lambda n: F.length(F.hex(n))
    body = F.when(size > 0, full * (F.lit(chunk + 4) + digits(F.lit(chunk).cast("long"))) + F.when(rest > 0, rest + 4 + digits(rest)).otherwise(0)).otherwise(0) + 5
    http = F.when(F.col("revisit"), F.concat(F.lit(HTTP + "Content-Length: "), size.cast("string"), F.lit("\r\n"))).otherwise(F.lit(HTTP + "Transfer-Encoding: chunked\r\n"))
    length = F.octet_length("http") + 2 + F.when(F.col("revisit"), 0).otherwise(body)
    field = lambda name, value: F.concat(F.lit(name + ": "), value)
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), field("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit("WARC-Date: " + date),
        field("WARC-Target-URI", _safe(F.col("url"))), field("X-Page-ID", F.col("page_id").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit("Content-Type: application/http; msgtype=response"), field("Content-Length", length.cast("string")), F.lit(""), F.col("http"))
    # Each row gives runs of lines that end with CRLF: the record's heads, its chunk, its end.
    piece = F.concat(F.lower(F.hex(F.octet_length("data"))), F.lit("\r\n"), F.col("data").cast("string"))
    end = F.when(F.col("revisit"), "\r\n").when(F.col("last"), "0\r\n\r\n\r\n")
    lines = F.array(F.when(F.col("chunk_no") == 0, head), F.when(~F.col("revisit") & (size > 0), piece), end)
    ordered = rows.withColumn("http", http).sortWithinPartitions("id", "key", "row", "chunk_no")
    ordered.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    C.forget(types)


class Reader:
    """Turns the lines of archives into chunk rows; holds one chunk at a time."""

    def __init__(self, with_data: bool):
        self.with_data, self.out = with_data, []
        self.feed = self.start
        self.file = None

    def fail(self, what: str, line: bytes):
        raise ValueError(f"{self.file}: {what}: {line[:80]!r}")

    def line(self, file: str, line: bytes) -> None:
        if file != self.file:
            if self.feed != self.start:
                self.fail("the archive ends within a record", b"")
            self.file = file
        self.feed(line)

    def start(self, line: bytes) -> None:
        if line == b"WARC/1.1":
            self.fields, self.feed = {}, self.head
        elif line:
            self.fail("no record begins here", line)

    def head(self, line: bytes) -> None:
        if line:
            name, _, value = line.partition(b": ")
            self.fields[name.decode().lower()] = value.decode()
            return
        self.left = int(self.fields["content-length"])
        self.http, self.chunk_no, self.size, self.sha, self.held, self.feed = {}, 0, 0, hashlib.sha1(), None, self.http_head

    def http_head(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if line:
            name, _, value = line.partition(b": ")
            self.http[name.decode().lower()] = value.decode()
        elif self.fields["warc-type"] == "revisit":
            self.size = int(self.http["content-length"])
            self.emit(b"", self.fields["warc-payload-digest"].removeprefix("sha1:"))
            self.done(line)
        else:
            self.feed = self.chunk_size

    def chunk_size(self, line: bytes) -> None:
        self.left -= len(line) + 2
        self.want, self.parts = int(line, 16), []
        self.feed = self.chunk if self.want else self.trailer

    def chunk(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if len(line) < self.want:  # the line break belongs to the payload
            self.parts += line, b"\r\n"
            self.want -= len(line) + 2
            if self.want < 0:
                self.fail("a chunk is shorter than its size", line)
            return
        if len(line) > self.want:
            self.fail("a chunk is longer than its size", line)
        if self.held is not None:
            self.emit(self.held, None)
            self.chunk_no += 1
        self.held = b"".join([*self.parts, line])
        self.sha.update(self.held)
        self.size += len(self.held)
        self.feed = self.chunk_size

    def trailer(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if line:
            self.fail("no end of the payload", line)
        digest = base64.b32encode(self.sha.digest()).decode()
        if "sha1:" + digest != self.fields["warc-payload-digest"]:
            self.fail("the payload does not match its digest", digest.encode())
        self.emit(self.held or b"", digest)
        self.done(line)

    def done(self, line: bytes) -> None:
        if self.left:
            self.fail("the block does not match Content-Length", line)
        self.feed = self.start

    def emit(self, data: bytes, digest: str | None) -> None:
        f = self.fields
        number = lambda name: int(f[name]) if f.get(name) else None
        if self.with_data or digest:
            self.out.append((f["warc-record-id"], number("x-page-id"), f.get("warc-target-uri"), f["warc-type"], number("x-refers-to-page-id"), self.chunk_no, self.size, digest, digest is not None, data if self.with_data else None))


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives in a folder; the last row of a record has its size and digest."""
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    names = re.findall(r"(\w+) \w+", CHUNKS)

    def run(batches):
        reader = Reader(with_data)
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader.line(file, value)
            out, reader.out = reader.out, []
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)
        if reader.feed != reader.start:
            reader.fail("the archive ends within a record", b"")

    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary").alias("value")).mapInArrow(run, CHUNKS)
