"""Web archives: writing, revisit resolution, reading back.

``write_archives`` stores each page as a response record (one gzip member per
record) and returns a table of headers. ``resolve_revisits`` shuffles only
those headers by payload digest, picks the original of each digest, joins it
to the other records, and writes deduplicated archives record by record from
the first ones: originals with fresh headers, the others as revisit records.
Payloads never go through a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, open_read, open_write, table, work_path

ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed name space for URLs
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

_HEADERS = "path string, offset long, length long, page_id long, url string, digest string, payload_bytes long, captured string"
_MANIFEST = "path string, n_records long, n_bytes long"
_RECORDS = "page_id long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(path: str, offset: int) -> str:
    """The record made from what stands at a place of a first archive; unique also among repeated rows."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{offset}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _uri(url: str | None) -> str | None:
    return None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record is cut short")
    return fields, block


def records(f) -> Iterator[bytes]:
    """The gzip members of an archive, one by one, in bounded memory."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            data = rest or f.read(1 << 20)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("archive is cut short")
                return
            parts.append(member.decompress(data))
        rest = member.unused_data
        yield b"".join(parts)


class _Archives:
    """Archives of one task: a new file after ``ARCHIVE_BYTES``; ``done`` lists the finished ones."""

    def __init__(self, folder: str):
        self.folder, self.part, self.seq = folder, TaskContext.get().partitionId(), 0
        self.path = self.out = self.f = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.f is not None and self.at >= ARCHIVE_BYTES:
            self.close()
        if self.f is None:
            self.path = f"{self.folder}/part-{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}.warc.gz"
            self.out = open_write(self.path)
            self.f, self.at, self.n = self.out.__enter__(), 0, 0
            self.seq += 1
        where = (self.path, self.at, len(data))
        self.f.write(data)
        self.at += len(data)
        self.n += 1
        return where

    def close(self, error: BaseException | None = None) -> None:
        if self.f is not None:
            self.out.__exit__(type(error) if error else None, error, None)
            self.f = None
            self.done.append((self.path, self.n, self.at))


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), cols, strict=True)], names=[n for n, _ in cols])


def write_archives(pages: DataFrame, *, captured: str = "2024-01-01T00:00:00Z", level: int = 1, path: str | None = None) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a response record; return the table of headers.

    A null html is an empty payload; a null page_id or url leaves its field
    out; white space and control characters of a url are percent-encoded.
    Repeated rows are records of their own. Extra columns are not read. No
    shuffle.
    """
    folder = path or work_path(pages.sparkSession, "warc-in")

    def run(batches):
        archives = _Archives(folder)
        try:
            for batch in batches:
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, url = (html or "").encode(), _uri(url)
                    digest = payload_digest(payload)
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", captured), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page), ("Content-Type", "application/http; msgtype=response")]
                    where = archives.add(_member(_record(fields, _http_head(len(payload)) + payload), level))
                    rows.append((*where, page, url, digest, len(payload), captured))
                if rows:
                    yield _batch(rows, _HEADERS)
            archives.close()
        except BaseException as e:
            archives.close(e)
            raise

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialize(rows.mapInArrow(run, _HEADERS), "warc-headers")


def resolve_revisits(headers: DataFrame, *, min_bytes: int = 0, captured: str = "2024-01-01T00:00:00Z", level: int = 6, path: str | None = None) -> DataFrame:
    """Write deduplicated archives from those that ``headers`` describes; return their manifest.

    Of the records with equal payloads of at least ``min_bytes``, the one with
    the smallest page_id (nulls last; among equal ones the first in the
    archives) stays a response, the others become revisits of it. Smaller ones
    all stay. The first archives are left as they are.
    """
    spark = headers.sparkSession
    folder = path or work_path(spark, "warc-out")
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "path", "offset", "url", "captured")
    # counted and reduced before the shuffle: a digest shared by many records sends one row a task
    firsts = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "warc-originals")
    resolved = lookup_join(headers, firsts, ["digest", "payload_bytes"])
    other = F.col("o").isNotNull() & ~((F.col("o.path") == F.col("path")) & (F.col("o.offset") == F.col("offset")))
    plan = resolved.select("path", "offset", "length", *[F.when(other, F.col(f"o.{c}")).alias(f"o_{c}") for c in ("path", "offset", "page_id", "url", "captured")])
    files = headers.select("path").distinct().count()
    plan = plan.repartition(max(1, min(files, 20_000)), "path").sortWithinPartitions("path", "offset")

    def run(batches):
        archives, source, at = _Archives(folder), None, None
        try:
            for batch in batches:
                for path, offset, length, o_path, o_offset, o_page, o_url, o_captured in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != at:
                        if source is not None:
                            source.close()
                        source, at = open_read(path), path
                    source.seek(offset)
                    fields, block = parse_record(zlib.decompress(source.read(length), 31))
                    fresh = [("WARC-Record-ID", record_id(path, offset)), ("WARC-Date", fields["warc-date"]), ("WARC-Target-URI", fields.get("warc-target-uri")), ("WARC-Payload-Digest", fields["warc-payload-digest"]), ("Page-Id", fields.get("page-id")), ("Content-Type", fields["content-type"])]
                    if o_path is None:
                        fresh.insert(0, ("WARC-Type", "response"))
                    else:
                        fresh.insert(0, ("WARC-Type", "revisit"))
                        fresh += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(o_path, o_offset)), ("WARC-Refers-To-Target-URI", o_url), ("WARC-Refers-To-Date", o_captured), ("Refers-To-Page-Id", o_page)]
                        block = block[: block.index(b"\r\n\r\n") + 4]
                    if archives.f is None:
                        archives.add(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", captured), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
                    archives.add(_member(_record(fresh, block), level))
            archives.close()
        except BaseException as e:
            archives.close(e)
            raise
        finally:
            if source is not None:
                source.close()
        if archives.done:
            yield _batch(archives.done, _MANIFEST)

    return materialize(plan.mapInArrow(run, _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """One row per response or revisit record of the archives in ``manifest``.

    The digest of each response is computed again from its payload and must
    match its header. A revisit gives the digest and length that its headers
    carry. ``payload`` is null for revisits and unless ``payloads`` is set.
    """
    spread = max(1, min(manifest.count(), 20_000))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_read(path) as f:
                    for data in records(f):
                        fields, block = parse_record(data)
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        cut = block.index(b"\r\n\r\n") + 4
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        payload = block[cut:] if kind == "response" else None
                        if payload is not None and payload_digest(payload) != digest:
                            raise ValueError(f"payload does not match its digest in {path}")
                        size = len(payload) if payload is not None else int(re.search(rb"\r\nContent-Length: (\d+)", block)[1])
                        page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
                        rows.append((page and int(page), kind, fields["warc-record-id"], fields.get("warc-target-uri"), size, digest, refers and int(refers), fields.get("warc-refers-to"), payload if payloads else None))
                        held += size if payloads else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield _batch(rows, _RECORDS)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, _RECORDS)

    return manifest.select("path").repartition(spread, "path").mapInArrow(run, _RECORDS)


def op4_warc_revisits(spark, sf_dir):
    """Contract: per page its payload's size and digest, record type and the page it refers to, from the written archives."""
    headers = write_archives(table(spark, sf_dir, "pages"))
    back = read_archives(resolve_revisits(headers))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
