"""WARC archives: records written in segments, read back and put together.

A page is an HTTP response with chunked framing. A record whose block is longer
than a segment is continued in further records, which name the first by its
identifier; the last gives the total length. So every record, and with a bound
on the records of a file every file, is of bounded size, whatever the page.

Archives are written by Spark's text writer (one record, less its final line
feed, is one line), so they can lie in any store Spark writes to.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, salted, ship_package

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
RECORDS_PER_FILE = 1000
SALTS = 32
LAST = 2**63 - 1  # stands for a null id: behind every other
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for start in range(0, len(payload), size):
        part = payload[start:start + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


class Dechunker:
    """Undo chunked framing of a block that arrives in parts."""

    def __init__(self):
        self._rest = b""
        self._left = 0  # bytes of the present chunk still to come
        self._after = False  # the line end behind a chunk comes next
        self.done = False

    def feed(self, data: bytes) -> bytes:
        data, out, at = self._rest + data, [], 0
        while not self.done:
            if self._left:
                part = data[at:at + self._left]
                out.append(part)
                at += len(part)
                self._left -= len(part)
                if self._left:
                    break
                self._after = True
            if self._after:
                if len(data) - at < 2:
                    break
                at, self._after = at + 2, False
            end = data.find(b"\r\n", at)
            if end < 0:
                break
            self._left = int(data[at:end].split(b";")[0], 16)
            at, self.done = end + 2, self._left == 0
        self._rest = data[at:]
        return b"".join(out)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in an archive."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def page_records(number: int, page_id: int, url: str, payload: bytes, digest: str, origin: int | None,
                 segment_bytes: int) -> list[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit of page ``origin``."""
    name = f"<urn:page:{page_id}:{number}>"
    uri = "".join(c if c.isprintable() and c != " " else "%20" for c in url)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http_type = ("Content-Type", "application/http; msgtype=response")
    if origin is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Profile", profile),
                        ("WARC-Refers-To", f"<urn:page:{origin}>"), http_type],
                       HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, http_type], block)]
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    found = [record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, ("WARC-Segment-Number", "1"),
                     http_type], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        found.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{number}:{i}>"),
                             *about, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), *total], part))
    return found


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
                   page_id: str = "page_id", url: str = "url", page: str = "html") -> None:
    """Write one record for each row of ``pages`` (more if segmented), gzipped, to the new folder ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those of the
    smallest id are responses, others revisit it. A null page is an empty
    payload, a null url an empty one, a null id comes behind every other. Repeated rows are written each.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col(page_id).cast("long"), F.lit(LAST)).alias("page"),
                        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(page), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    shared = (rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min("page").alias("origin"), F.max("page").alias("last")).where("origin < last"))
    rows = rows.join(salted(shared.select("digest", "origin"), SALTS), ["digest", "salt"], "left")
    rows = rows.select(F.monotonically_increasing_id().alias("number"), "page", "url", "html",
                       F.hex("digest").alias("digest"), F.when(F.col("origin") < F.col("page"), F.col("origin")).alias("origin"))

    def convert(batch):
        for start in range(0, batch.num_rows, 256):
            found = []
            for number, page_number, address, html, digest, origin in zip(
                    *(c.to_pylist() for c in batch.slice(start, 256).columns)):
                found += page_records(number, page_number, address, html.encode(), base32(digest), origin, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in found], pa.binary())], ["record"])

    records = by_batch(rows, convert, "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip")
     .option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_records(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        yield headers, data[start:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record is not closed at byte {at}")
        at += 4


def members(data: bytes):
    """The content of each gzip member of a file, one after the other; anything else in it is an error."""
    while data:
        unzip = zlib.decompressobj(31)
        content = unzip.decompress(data)
        if not unzip.eof:
            raise ValueError("archive ends inside a gzip member")
        data = unzip.unused_data
        yield content


class _Page:
    """The payload of a response, from segments in order."""

    def __init__(self, keep: bool):
        self._head, self._body = b"", None
        self._in_body = False  # the head is read
        self._sha1, self.size, self.seen = hashlib.sha1(), 0, 0
        self._kept = [] if keep else None

    def feed(self, block: bytes) -> None:
        self.seen += len(block)
        if not self._in_body:
            self._head += block
            head, mark, block = self._head.partition(b"\r\n\r\n")
            if not mark:
                return
            self._in_body = True
            if b"transfer-encoding: chunked" in head.lower():
                self._body = Dechunker()
        data = self._body.feed(block) if self._body else block
        self._sha1.update(data)
        self.size += len(data)
        if self._kept is not None:
            self._kept.append(data)

    def result(self, headers: dict, total: int, keep: bool) -> tuple:
        digest = base64.b32encode(self._sha1.digest()).decode()
        if self.seen != total or self._body and not self._body.done:
            raise ValueError(f"{headers['warc-record-id']}: {self.seen} of {total} bytes")
        if headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"{headers['warc-record-id']}: payload does not have its digest")
        return (_number(headers["warc-record-id"]), headers["warc-target-uri"], self.size, digest, "response", None,
                b"".join(self._kept) if keep else None)


def _number(name: str) -> int | None:
    number = int(name.strip("<>").split(":")[2])
    return None if number == LAST else number


RESULT = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload", pa.binary())])
_PARSED = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("head", pa.string()),
                     ("block", pa.binary()), *_ARROW])


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each page of the archives: id, url, length and digest of the full payload, whether it
    is a response or a revisit and of what page; with ``payloads`` a response's payload too.

    A file may be one gzip member or one for each record. Whole records are decoded where they are read. Segments are dealt out by
    their origin's identifier, sorted by number and decoded one after the other, so that
    no page is held whole unless its payload is asked for. A missing segment, a
    wrong total length or digest is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batch):
        for content in batch.column(0):
            rows = []
            for headers, block in (found for member in members(content.as_py()) for found in parse_records(member)):
                kind, segment = headers["warc-type"], int(headers.get("warc-segment-number", 0))
                if segment:
                    total = int(headers.get("warc-segment-total-length", 0))
                    head = "\n".join(f"{k}: {v}" for k, v in headers.items()) if segment == 1 else None
                    rows.append((headers.get("warc-segment-origin-id", headers["warc-record-id"]), segment, total, head,
                                 block, *[None] * 7))
                elif kind == "response":
                    page = _Page(payloads)
                    page.feed(block)
                    rows.append((headers["warc-record-id"], 0, 0, None, None, *page.result(headers, len(block), payloads)))
                elif kind == "revisit":
                    size = int(block.lower().partition(b"content-length:")[2].split()[0])
                    rows.append((headers["warc-record-id"], 0, 0, None, None, _number(headers["warc-record-id"]),
                                 headers["warc-target-uri"], size, headers["warc-payload-digest"].partition(":")[2],
                                 "revisit", _number(headers["warc-refers-to"]), None))
                if len(rows) >= 200:
                    yield _table(rows, _PARSED)
                    rows = []
            if rows:
                yield _table(rows, _PARSED)

    def assemble(batches):
        origin = page = headers = None
        total = expected = 0
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    rows.append(row[5:])
                    continue
                if row[0] != origin:
                    if page:
                        rows.append(page.result(headers, total, payloads))
                    origin, page, total, expected = row[0], _Page(payloads), 0, 1
                    headers = dict(line.split(": ", 1) for line in (row[3] or "").split("\n") if ": " in line)
                if row[1] != expected or expected == 1 and not headers:
                    raise ValueError(f"{origin}: segment {expected} is missing")
                page.feed(row[4])
                total, expected = max(total, row[2]), expected + 1
            if rows:
                yield _table(rows, _ARROW)
        if page:
            yield _table([page.result(headers, total, payloads)], _ARROW)

    parsed = by_batch(files, parse, "origin string, segment int, total long, head string, block binary, " + RESULT)
    return (parsed.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(assemble, RESULT))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
