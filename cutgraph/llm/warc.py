"""WARC archives: one gzip member per record, written from pages and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = 1 << 16
#: An archive is closed when it has so many bytes; one record may go beyond.
ARCHIVE_BYTES = 4 << 20
LEAST_REVISIT = 100
#: Every record has to have a date; a fixed one gives the same archives each time.
DATE = "1970-01-01T00:00:00Z"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has no payload, but its length and digest.

    A url with line breaks or none can't stand in a header; it is written in base64, or left out.
    """
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("X-Target-Base64", base64.b64encode(url.encode()).decode()) if "\r" in url or "\n" in url or url != url.strip() else ("WARC-Target-URI", url))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = b"" if revisit else payload
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest() if revisit else digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    raw = "WARC/1.1\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of plain pieces that must be used up."""
    source, rest = iter(chunks), b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        unpacker = zlib.decompressobj(31)
        while True:
            piece = unpacker.decompress(rest, CHUNK)
            rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if piece:
                yield piece
            if unpacker.eof:
                return
            if not rest:
                rest = next(source, b"")
                if not rest:
                    raise ValueError("the archive ends within a gzip member")

    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        yield one()


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; framing by Content-Length.

    A member with a wrong frame, or a block that hasn't the digest or the length named, raises ValueError.
    """
    for pieces in members(chunks):
        buffer = b""
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record ends within its headers")
            buffer += piece
        first, *lines = buffer[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length, digest, block = int(head["content-length"]), hashlib.sha256(), []
        need, piece = length, buffer[end + 4 :]
        tail = b""
        while piece is not None:
            part, more = piece[:need], piece[need:]
            need -= len(part)
            digest.update(part)
            block.append(part)
            tail += more
            piece = next(pieces, None)
        if need or tail != b"\r\n\r\n":
            raise ValueError("the record isn't as long as its Content-Length")
        response = head["warc-type"] == "response"
        told = [head.get("warc-block-digest"), head.get("warc-payload-digest") if response else None]
        if any(t and t.startswith("sha256:") and t != f"sha256:{digest.hexdigest()}" for t in told):
            raise ValueError(f"digest of {head.get('warc-record-id')} differs")
        if response and int(head.get("x-payload-length", length)) != length:
            raise ValueError(f"length of {head.get('warc-record-id')} differs")
        yield head, b"".join(block)


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], ["content"])

    records, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            page, url, html, digest, refers = (x.as_py() for x in row)
            records.append(warc_record(page, url, html, digest, refers))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield closed(records)
                records, size = [], 0
    if records:
        yield closed(records)


def write_warc(pages: DataFrame) -> DataFrame:
    """Archives (content binary), each a sequence of gzip members with one record per page.

    Of pages with equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is the
    response and the others refer to it; rows that repeat this page_id are responses too, and so are
    rows without page_id where no row of the payload has one. A null html is an empty payload.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    ids = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("digest", "page_id")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").select("digest", "refers_to")
    # ids alone meet on the digest; pages then on both, so that neither a payload nor an id of many rows is one key
    later = ids.join(first, "digest").filter("page_id is null or page_id <> refers_to").distinct().select(F.col("digest").alias("_d"), F.col("page_id").alias("_p"), "refers_to")
    no_id = F.lit(-(2**63))
    known = rows.join(later, (F.col("digest") == F.col("_d")) & (F.coalesce("page_id", no_id) == F.coalesce("_p", no_id)), "left")
    return known.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_archives, "content binary")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file ``.warc.gz`` in a folder that all executors reach; (path, bytes) of the files.

    ``folder`` is a URI or an absolute path. A file is named by its content and appears under its name when it is whole, so
    that a task that runs again changes nothing. Nothing is written before an action on the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for cell in batch.column(0):
                content = cell.as_buffer()
                path, part = f"{root}/{hashlib.sha256(content).hexdigest()}.warc.gz", f"{root}/_{uuid.uuid4().hex}"
                with files.open_output_stream(part, compression=None) as out:
                    out.write(content)
                files.move(part, path)
                paths.append(path)
                sizes.append(content.size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return archives.select("content").mapInArrow(run, "path string, bytes long")


_FIELDS = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    for batch in batches:
        for cell in batch.column(0):
            content, rows = cell.as_buffer(), []
            for head, block in read_records(memoryview(content)[i : i + CHUNK] for i in range(0, content.size, CHUNK)):
                page, refers = (head.get(k, "")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
                url = base64.b64decode(head["x-target-base64"]).decode() if "x-target-base64" in head else head.get("warc-target-uri")
                rows.append((int(page) if page else None, url, head["warc-type"], int(head.get("x-payload-length", len(block))), head.get("warc-payload-digest", "").removeprefix("sha256:"), int(refers) if refers else None, block))
                if len(rows) == 256:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of archives with a ``content`` column, such as write_warc or the binaryFile source give."""
    return archives.select("content").mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read these back; a row per page."""
    archives = Scratch(spark, "warc").save(write_warc(pages))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
