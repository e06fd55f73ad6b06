"""WARC archives of web pages: one gzip member per record, revisits for equal payloads, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES = 8 << 20
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    """Base32 of the SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def read_records(archive: bytes) -> Iterator[Record]:
    """Records in order. Members are inflated piece by piece, and the content length frames the block.

    A member that is cut off, a length that does not fit and a block that differs from its digest are errors.
    """
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + READ_BYTES]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        data = b"".join(parts)
        head, mark, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not mark or not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("a record does not have the length that it states")
        block = rest[:size]
        stated = headers.get("warc-block-digest")
        if stated and stated.removeprefix("sha1:") != digest(block):
            raise ValueError("a block differs from its digest")
        yield Record(headers, block)


def page_record(page_id: int | None, url: str | None, payload: bytes, name: str, date: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", PROFILE)]
    headers += [
        ("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(headers, block)


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives (archive, content) with a record per row of ``pages`` (page_id, url, html).

    Of rows with equal payloads that with the largest page_id is a response and the others revisit it; a null html is an
    empty payload. Repeats of the row with the largest id, and rows of a payload that has no id at all, are responses.
    An archive holds about 8 MB; a longer record is one archive.
    """
    data = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", data.alias("data")).withColumn("sha1", F.sha1("data")).withColumn("size", F.octet_length("data"))
    last = pages.select("page_id", data.alias("data")).select(
        "page_id", F.sha1("data").alias("sha1"), F.octet_length("data").alias("size")
    ).groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    named = rows.join(last.drop("copies"), ["sha1", "size"], "left").select(
        "page_id", "url", "data", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f"pages-{part:05d}-{made:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "data", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns):
                body = payload.as_py()
                held.append(page_record(page_id.as_py(), url.as_py(), body, digest(body), date, refers_to.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    made, held, size = made + 1, [], 0
        if held:
            yield archive()

    return named.mapInArrow(run, "archive string, content binary")


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(RECORD)
    return int(text) if text else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of archives in ``content``.

    A response's payload is checked against its digest; a revisit has no payload, and its length and digest are those
    that its headers state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in read_records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
                    length = int(fields["Content-Length"])
                    if kind == "response" and (digest(payload) != stated or len(payload) != length):
                        raise ValueError("a payload differs from its digest")
                    rows.append((
                        _page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, _page(headers.get("warc-refers-to")),
                        length, stated, payload if kind == "response" else None,
                    ))
                    size += len(payload)
                    if size >= ARCHIVE_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
