"""WARC records as a chunked table: (record, chunk_no, data, ...) rows, written and read as streams of chunks.

A record's chunks, joined in order, are its bytes in WARC/1.1: header, HTTP header, payload, CRLF CRLF. Each
chunk row carries the SHA-1 of the payload so far and the payload's place, so that a payload is hashed, written
and read a chunk at a time and no task holds a whole record beside the input row. Of equal payloads the one
with the largest id is written as a response, others as revisits (header only, RFC-style profile) that refer to it.
Null payloads are empty; null urls are left out. Every record has a number of its own (`record`, also in its
WARC-Record-ID), so null ids, repeated rows and equal ids with different payloads stay distinct records. Rows equal
in id and payload are all responses if theirs is the largest id: none of them is an earlier visit. A null id is less
than any other. Responses are written first, as a revisit names the record that it refers to. An empty table gives an
empty archive. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, text_of

CHUNK = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "page_id long, chunk_no int, last boolean, record long, payload_sha1 string, payload_from int, sha1_so_far string, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(page_id, record: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{record}>"


def _header(page_id, record: int, url: str | None, digest: str, size: int, refers_to: tuple | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id, record)}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(*refers_to)}"]
    block = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode() + http


def chunks_of(page_id, url, payload: memoryview, refers_to: tuple | None, chunk: int = CHUNK, record: int = 0) -> Iterator[tuple]:
    """Rows of TABLE for one record; refers_to: page_id and record. The digest in the header needs a pass before; both go chunk by chunk."""
    sha = hashlib.sha1()
    for at in range(0, len(payload), chunk):
        sha.update(payload[at : at + chunk])
    whole = sha.hexdigest()
    head = _header(page_id, record, url, base32(sha.digest()), len(payload), refers_to)
    body = payload if refers_to is None else payload[:0]
    sha, n, at = hashlib.sha1(), 0, 0
    while True:
        part = body[at : at + chunk]
        at += len(part)
        sha.update(part)
        last = at >= len(body)
        data = (head if n == 0 else b"") + bytes(part) + (b"\r\n\r\n" if last else b"")
        yield page_id, n, last, record, whole, len(head) if n == 0 else 0, base32(sha.digest()), data
        n += 1
        if last:
            return


def revisit(page_id, url, whole: str, size: int, refers_to: tuple, record: int) -> tuple:
    """The row of a revisit, from its payload's hex digest and size alone."""
    head = _header(page_id, record, url, base32(bytes.fromhex(whole)), size, refers_to)
    return page_id, 0, True, record, whole, len(head), base32(hashlib.sha1().digest()), head + b"\r\n\r\n"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_TABLE = pa.schema([("page_id", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("record", pa.int64()), ("payload_sha1", pa.string()), ("payload_from", pa.int32()), ("sha1_so_far", pa.string()), ("data", pa.binary())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _numbers(kind: int) -> Iterator[int]:
    """Record numbers of this task: even ones for responses (kind 0), odd ones for revisits (1)."""
    from pyspark import TaskContext

    return itertools.count((TaskContext.get().partitionId() << 40) + kind, 2)


def _gathered(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= 8 << 20:
            yield _batch(held, _TABLE)
            held, size = [], 0
    if held:
        yield _batch(held, _TABLE)


def _responses(batches):
    def rows():
        numbers = _numbers(0)
        for b in batches:
            ids, urls = (b.column(c).to_pylist() for c in ("page_id", "url"))
            html = b.column("html").cast(pa.binary())
            for i, page_id in enumerate(ids):
                data = html[i].as_buffer()
                yield from chunks_of(page_id, urls[i], memoryview(data if data is not None else b""), None, record=next(numbers))

    return _gathered(rows())


def _revisits(batches):
    def rows():
        numbers = _numbers(1)
        for b in batches:
            for page_id, url, sha, size, best, target in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha", "size", "best", "target")), strict=True):
                yield revisit(page_id, url, sha, size, (best, target), next(numbers))

    return _gathered(rows())


def archive(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The chunk table of pages(page_id, url, html), written to scratch.

    Digests are grouped without payloads; a payload moves once, to meet its group's largest id. Revisits are
    written from digests and sizes. Of repeated responses, revisits refer to the one with the least number.
    """
    html = text_of("html")
    own = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"))
    best = pages.select("page_id", F.sha1(html).alias("_sha")).groupBy("_sha").agg(F.max("page_id").alias("best"))
    # on digest and id, so that a payload with many copies doesn't bring them all to one task
    met = own.join(best.hint("shuffle_hash"), (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("best")))
    responses = scratch.save(met.select("page_id", "url", "html").mapInArrow(lean(_responses), TABLE), "responses", "zstd")
    # of a digest all responses with an id have the largest one
    named = responses.where("chunk_no = 0 and page_id is not null").groupBy(F.col("payload_sha1").alias("_sha")).agg(F.max("page_id").alias("best"), F.min("record").alias("target"))
    sized = pages.select("page_id", "url", F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    again = sized.join(named.hint("shuffle_hash"), F.col("sha") == F.col("_sha")).where(~F.col("page_id").eqNullSafe(F.col("best")))
    revisits = scratch.save(again.select("page_id", "url", "sha", "size", "best", "target").mapInArrow(lean(_revisits), TABLE), "revisits", "zstd")
    return responses.unionByName(revisits)


class Reader:
    """Parses one record from its chunks in order; holds a header and a running digest, never a payload."""

    def __init__(self):
        self.head = None

    def feed(self, data: bytes, last: bool):
        if self.head is None:
            end = data.index(b"\r\n\r\n") + 4
            lines = data[:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1", lines[0]
            self.head = dict(x.split(": ", 1) for x in lines[1:] if x)
            self.left = int(self.head["Content-Length"])
            stop = data.index(b"\r\n\r\n", end) + 4
            http = data[end:stop]
            self.left -= len(http)
            self.declared = int(http.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
            self.sha, self.size = hashlib.sha1(), 0
            data = data[stop:]
        part = memoryview(data)[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)
        if not last:
            return None
        assert self.left == 0 and data[len(part) :] == b"\r\n\r\n", "a record is cut"
        head, kind = self.head, self.head["WARC-Type"]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        assert kind == "revisit" or (digest == base32(self.sha.digest()) and self.size == self.declared), "a payload is damaged"
        number = lambda uri: None if ":null:" in uri else int(uri.split(":")[2])
        refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
        self.head = None
        return number(head["WARC-Record-ID"]), self.declared, digest, kind, refers, head.get("WARC-Target-URI")


def _read(batches):
    reader = Reader()
    for b in batches:
        data, last = b.column("data"), b.column("last").to_pylist()
        rows = [r for i, end in enumerate(last) if (r := reader.feed(data[i].as_py(), end)) is not None]
        if rows:
            yield _batch(rows, _RECORDS)


def read_archive(table: DataFrame) -> DataFrame:
    """One row a record, every payload checked against its digest.

    Records of one chunk are parsed where they lie; only the chunks of longer ones are brought together.
    """
    single = table.where("last and chunk_no = 0").select("data", "last").mapInArrow(lean(_read), RECORDS)
    more = table.where("not last or chunk_no > 0").repartition("record").sortWithinPartitions("record", "chunk_no")
    return single.unionByName(more.select("data", "last").mapInArrow(lean(_read), RECORDS))
