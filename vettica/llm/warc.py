"""WARC archives of pages: written with segmented and chunked payloads, read back
by reassembling segments and decoding the transfer framing.

Writing.  Of pages with equal payloads of at least ``LEAST_SHARED`` bytes the one
with the smallest id is a response and the others are revisits of it.  A response's
block is an HTTP message whose body is in chunked transfer coding.  A block longer
than ``SEGMENT`` bytes is cut into a first record and continuation records that
name its id, their number, and, the last one, the total length.  Spark's own text
writer makes the archives, so they land wherever Spark can write.

Reading.  Archives are read as whole files (a file has at most ``RECORDS`` records of
at most one segment), cut by Content-Length, grouped by origin, ordered by segment
number, checked against the total length, and their chunks joined.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettica.llm.common import batches, bound_batches

LEAST_SHARED = 100
SEGMENT = 65_536
CHUNK = 16_384
RECORDS = 256
URN = "urn:vettica:page"


class ArchiveError(ValueError):
    """A record, its segments or its framing are incomplete or contradict each other."""


# --- writing ---------------------------------------------------------------


def with_originals(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, original): the smallest id among
    equal large payloads, or null where a page stands for itself."""
    digest = F.sha2("payload", 256)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", digest)
    shared = (
        rows.where(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return rows.join(shared, "digest", "left").withColumn("original", F.when(other, F.col("first"))).drop("first")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer coding."""
    cut = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    # the archive's line separator follows each record
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records(key: str, page: str, url: str, payload: bytes, digest: str, original: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page.  ``key`` tells repeated pages apart."""
    ident = f"<{URN}:{page}:{key}>"
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    shared = [("WARC-Record-ID", ident), ("WARC-Target-URI", target), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if original is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *shared, profile, ("WARC-Refers-To", f"<{URN}:{original}>")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *shared], block)
        return
    yield _record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", "1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{ident[:-1]}:{number}>"), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(number))]
        if at + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write a record (or its segments) per row of ``pages`` as gzip archives."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])

        def out() -> Iterator[tuple]:
            for batch in source:
                for key, page, url, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for record in records(str(key), "" if page is None else page, url or "", payload, digest, original, segment):
                        yield (record,)

        yield from batches(out(), schema, 128)

    rows = with_originals(pages).select(
        F.monotonically_increasing_id(),
        F.col("page_id").cast("string").alias("page"),
        "url",
        "payload",
        "digest",
        F.col("original").cast("string").alias("original"),
    )
    (
        rows.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS)
        .text(path)
    )


# --- reading ---------------------------------------------------------------


def cut_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, gzip or plain."""
    data = _plain(archive)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ArchiveError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ArchiveError(f"the record at byte {at} is cut off")
        yield fields, block
        at = end + 8 + length


def _plain(archive: bytes) -> bytes:
    if archive[:2] != b"\x1f\x8b":
        return archive
    out = []
    while archive:
        member = zlib.decompressobj(31)
        out.append(member.decompress(archive))
        archive = member.unused_data
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ArchiveError("a chunk has no length")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ArchiveError("a chunk is cut off")
        out.append(body[end + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError("the message has no end of headers")
    coded = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return unchunked(body) if coded else body


def stated_length(block: bytes) -> int:
    """What an HTTP message's own Content-Length says."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value)
    raise ArchiveError("a revisit must state the length of its payload")


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, bytes) rows in order of number."""
    numbers = [n for n, _, _ in segments]
    block = b"".join(b for _, _, b in segments)
    total = segments[-1][1]
    if numbers != list(range(1, len(numbers) + 1)) or (len(numbers) > 1 and total is None):
        raise ArchiveError(f"segments {numbers} are not whole")
    if total is not None and total != len(block):
        raise ArchiveError(f"{len(block)} bytes of {total}")
    return block


_PARTS = pa.schema(
    [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("segmented", pa.bool_()), ("block", pa.binary())]
)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: whose segment it is, its number and bytes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in source:
                for archive in batch.column("content"):
                    for f, block in cut_records(archive.as_py()):
                        total, number = f.get("warc-segment-total-length"), f.get("warc-segment-number")
                        digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                        yield f.get("warc-segment-origin-id", f.get("warc-record-id")), int(number or 1), total and int(total), f["warc-type"], digest or None, f.get("warc-refers-to"), number is not None, block

        yield from batches(out(), _PARTS, 64)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return archives.mapInArrow(run, "origin string, number int, total long, type string, digest string, refers string, segmented boolean, block binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, payload, payload_bytes, payload_digest, refers_to).

    Segments of one origin meet by its id and are put together in order; a gap, a
    wrong total or broken framing stops the job.  A revisit has no payload: its
    length and digest are the recorded ones.  A response's digest is computed from
    its payload and must equal the recorded one."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in source:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def out() -> Iterator[tuple]:
            for origin, group in groupby(rows(), key=lambda r: r[0]):
                held = list(group)
                block = reassembled([(r[1], r[2], r[7]) for r in held])
                kind, digest, refers, segmented = held[0][3], held[0][4], held[0][5], held[0][6]
                if segmented and len(held) == 1:
                    raise ArchiveError(f"{origin} has one segment only")
                if kind == "revisit":
                    yield origin, kind, None, stated_length(block), digest, refers
                    continue
                payload = payload_of(block)
                found = hashlib.sha256(payload).hexdigest()
                if digest and digest != found:
                    raise ArchiveError(f"{origin} does not have its digest")
                yield origin, kind, payload, len(payload), found, None

        yield from batches(out(), schema, 64)

    return (
        read_segments(spark, path)
        .repartition("origin")
        .sortWithinPartitions("origin", "number")
        .mapInArrow(run, "record_id string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    )


def page_of(urn: str) -> Column:
    """The page id inside a record's URN, null where the page had none."""
    return F.nullif(F.regexp_extract(urn, f"<{URN}:([^:>]*)", 1), F.lit(""))


def archive_pages(pages: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``path`` and read them back as
    (page_id, record_type, payload, payload_bytes, payload_digest, refers_to).

    Null html is an empty payload; payloads under ``LEAST_SHARED`` bytes are never
    revisited.  Rows that share the smallest id of a group are all responses; pages
    without an id revisit it, and are responses where no page of the group has one.
    Repeated rows are records of their own.  Other columns are not read."""
    bound_batches(pages)
    kind = pages.schema["page_id"].dataType
    write_archives(pages, path, segment)
    read = read_archives(pages.sparkSession, path)
    return read.select(
        page_of("record_id").cast(kind).alias("page_id"), "record_type", "payload", "payload_bytes", "payload_digest", page_of("refers_to").cast(kind).alias("refers_to")
    )
