"""Web archives as tables of chunks.

A payload travels as rows of record and chunk number, at most CHUNK bytes each, and its SHA-1 is carried
from chunk to chunk, when an archive is written and when it is read: a Python worker never holds a whole
record. Archives are written by Spark's text sink, so that commits, retries and any file system are its
own: a row is one gzip member, and what the sink puts between rows is an empty gzip member.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import staged

CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Extension fields: the page, the page of the payload referred to, and the length of the full payload.
PAGE, REFERS_PAGE, LENGTH = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32(sha1: bytes) -> str:
    return b32encode(sha1).decode()


def record_name(page_id: int | None, url: str | None, digest: str, number: int) -> str:
    """The identifier of a record: of the row, and of its number among rows that are the same."""
    name = hashlib.md5(repr((page_id, url, digest, number)).encode("utf-8", "surrogatepass"), usedforsecurity=False)
    return f"<urn:uuid:{uuid.UUID(bytes=name.digest(), version=3)}>"


def payload_of(html: str | Column) -> Column:
    return F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")).cast("binary")


def record_table(pages: DataFrame, least: int = 0) -> DataFrame:
    """A row for each row of `pages` (page_id, url, html): these, digest (hex), size, number among rows
    that are the same, and first_page, first_url of the record that stands for its payload (null for
    that record itself).

    Of equal payloads of at least `least` bytes the smallest page_id stands for all, then the smallest
    url (nulls last), then the first of rows that are the same; smaller payloads stand for themselves."""
    known = lambda c: F.concat(F.col(c).isNotNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumns(
        {"digest": F.sha1(payload_of("html")), "size": F.octet_length(payload_of("html")).cast("long")}
    )
    rows = rows.withColumn("row", F.sha1(F.concat_ws(" ", "digest", known("page_id"), known("url")).cast("binary")))
    # Decisions are made on a few bytes a row; payloads are dealt once, by a key that no third of them shares.
    heads = staged(rows.groupBy("row", "digest", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "heads")
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "row")
    first = (
        heads.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.sum("n").alias("copies"), F.min(order).alias("first"))
        .where("copies > 1")
        .select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.row").alias("first_row"))
    )
    decided = heads.join(first, "digest").select("row", "first_page", "first_url", "first_row")
    joined = rows.join(decided, "row", "left").withColumn("number", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    revisit = F.col("first_row").isNotNull() & ((F.col("row") != F.col("first_row")) | (F.col("number") > 1))
    return joined.select(
        "page_id", "url", "html", "digest", "size", "number", revisit.alias("revisit"),
        F.when(revisit, F.col("first_page")).alias("first_page"), F.when(revisit, F.col("first_url")).alias("first_url"),
    )


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of `records` by chunk: chunk_no, chunks and data instead of html, in order. A revisit and
    an empty payload have one chunk of no bytes."""
    payload = F.when(F.col("revisit"), F.lit(b"")).otherwise(payload_of("html"))
    chunks = F.greatest(F.ceil(F.octet_length(payload) / chunk), F.lit(1)).cast("int")
    keep = [c for c in records.columns if c != "html"]
    return (
        records.select(*keep, payload.alias("payload"), chunks.alias("chunks"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
        .select(*keep, "chunk_no", "chunks", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))
    )


def _head(row: dict, date: str) -> bytes:
    digest = base32(bytes.fromhex(row["digest"]))
    url = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in row["url"] or "about:blank")
    fields = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"),
        ("WARC-Record-ID", record_name(row["page_id"], row["url"], row["digest"], row["number"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        (PAGE, row["page_id"]),
        (LENGTH, row["size"]),
    ]
    if row["revisit"]:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_name(row["first_page"], row["first_url"], row["digest"], 1)),
            (REFERS_PAGE, row["first_page"]),
        ]
    fields.append(("Content-Length", len(HTTP) + (0 if row["revisit"] else row["size"])))
    lines = [f"{k}: {v}\r\n" for k, v in fields if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode("utf-8", "replace") + b"\r\n" + HTTP


def write_archives(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of `pages` into archives in a new folder, one a task. Fails if a
    payload's digest over its chunks is not that of its record."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = hashlib.sha1(usedforsecurity=False)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["data"]
                if row["chunk_no"] == 0:
                    carried = hashlib.sha1(usedforsecurity=False)
                    data = _head(row, date) + data
                carried.update(row["data"])
                if row["chunk_no"] == row["chunks"] - 1:
                    data += b"\r\n\r\n"
                    if not row["revisit"] and carried.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of page {row['page_id']} does not have the digest {row['digest']}")
                out.append(gzip_member(data))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = chunk_table(record_table(pages, least), chunk).mapInArrow(members, "value binary")
    between = gzip_member(b"").decode("latin-1")
    rows.select(F.col("value").cast("string")).write.option("lineSep", between).option("encoding", "ISO-8859-1").text(folder)


class _Stream:
    """The bytes of concatenated gzip members, read in bounded steps."""

    def __init__(self, packed: bytes, step: int):
        self.packed, self.at, self.step = memoryview(packed), 0, step
        self.unpacker, self.rest, self.ready = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.rest = self.unpacker.unused_data
                self.unpacker = zlib.decompressobj(31)
            if not self.rest:
                self.rest = bytes(self.packed[self.at : self.at + 65536])
                self.at += len(self.rest)
                if not self.rest:
                    return False
            found = self.unpacker.decompress(self.rest, self.step)
            self.rest = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if found:
                self.ready += found
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.ready:
            if not self.more():
                return None
        found, _, self.ready = self.ready.partition(mark)
        return found

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise EOFError("an archive ends inside a record")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part


def records_in(packed: bytes, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: the record's fields, chunk_no, last, data, and sha1 and bytes of its
    payload up to and with this chunk."""
    stream = _Stream(packed, chunk)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not an archive record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        sha1, size, number, left = hashlib.sha1(usedforsecurity=False), 0, 0, int(fields["Content-Length"])
        if fields["Content-Type"].startswith("application/http"):
            http = stream.until(b"\r\n\r\n")
            left -= len(http) + 4
        pending = b""
        for part in stream.exactly(left):
            pending += part
            while len(pending) > chunk:
                data, pending = pending[:chunk], pending[chunk:]
                sha1.update(data)
                size += len(data)
                yield {"fields": fields, "chunk_no": number, "last": False, "data": data, "sha1": sha1.digest(), "bytes": size}
                number += 1
        sha1.update(pending)
        size += len(pending)
        yield {"fields": fields, "chunk_no": number, "last": True, "data": pending, "sha1": sha1.digest(), "bytes": size}
        if b"".join(stream.exactly(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")


def read_archives(spark: SparkSession, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all archives in a folder: record_id, chunk_no, last, record_type, page_id, refers_to
    (a page), payload_bytes and payload_digest (of the full payload as the record states it), carried
    (digest of what has been read), and data (null without with_data). Fails at the last chunk of a
    response whose payload is not as stated. One archive is one value, so a writer's task bounds it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                some, held = [], 0
                for r in records_in(packed.as_buffer().to_pybytes(), chunk):
                    f = r["fields"]
                    stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    carried = base32(r["sha1"])
                    if r["last"] and f["WARC-Type"] == "response" and (carried, r["bytes"]) != (stated, int(f[LENGTH])):
                        raise ValueError(f"record {f['WARC-Record-ID']} does not hold its payload")
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    some.append(
                        (f["WARC-Record-ID"], r["chunk_no"], r["last"], f["WARC-Type"], number(PAGE), number(REFERS_PAGE), number(LENGTH), stated, carried)
                        + ((r["data"] if with_data else None),)
                    )
                    held += len(r["data"])
                    if len(some) >= 1000 or with_data and held >= chunk:
                        yield batch_of(some)
                        some, held = [], 0
                if some:
                    yield batch_of(some)

    names = ["record_id", "chunk_no", "last", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "carried", "data"]
    types = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    schema = (
        "record_id string, chunk_no int, last boolean, record_type string, page_id long, refers_to long, payload_bytes long,"
        " payload_digest string, carried string, data binary"
    )
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(rows, schema)
