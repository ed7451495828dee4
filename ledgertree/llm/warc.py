"""WARC archives: writing pages as records, reading them back, reassembling segments.

``write_archives`` makes one record per page. The payload is the page in UTF-8, sent in
chunked transfer framing under HTTP headers. Of the pages with one payload of at least
``MIN_REVISIT`` bytes, the one with the largest id is a response and the others are
revisits of it, without a payload. A block longer than ``SEGMENT`` bytes is cut into a
first record and continuation records. Files hold at most ``FILE_RECORDS`` records, so
their size is bounded by that times ``SEGMENT`` and headers.

``read_records`` parses archives as streams, groups continuation records by origin,
orders them by segment number, checks that none is missing and that the total length is
right, and decodes the framing. ``problem`` says what was wrong with a record; its payload
is then null. Null pages have an empty payload, null urls no target, and a null id stays
null. Repeated rows give as many records. No rows give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgertree.session import materialize

MIN_REVISIT = 1_000
SEGMENT = 32_768
CHUNK = 4_096
FILE_RECORDS = 4_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def cuts(data: bytes, size: int) -> list[bytes]:
    """``data`` in parts of at most ``size`` bytes, none of which splits a character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and (data[end] & 0xC0) == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes) -> bytes:
    framed = [b"%x\r\n%b\r\n" % (len(part), part) for part in cuts(payload, CHUNK)]
    return b"".join([*framed, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has the wrong size")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def records(page_id: int | None, tag: int, url: str | None, payload: bytes, keeper: int | None) -> Iterator[str]:
    """The records of one page, without the empty lines after each."""
    own = f"<urn:page:{'none' if page_id is None else page_id}:{tag}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
    common = [
        ("WARC-Record-ID", own), ("WARC-Date", DATE), *target, ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if keeper is not None:
        refers = [("WARC-Refers-To", f"<urn:page:{keeper}>"), ("WARC-Profile", PROFILE)]
        yield _record([("WARC-Type", "revisit"), *common, *refers], HTTP)
        return
    parts = cuts(HTTP + chunked(payload), SEGMENT)
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), *common, *first], parts[0])
    for number, part in enumerate(parts[1:], start=2):
        last = [("WARC-Segment-Total-Length", sum(map(len, parts)))] if number == len(parts) else []
        yield _record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number), *last,
            ],
            part,
        )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped archives under ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    groups = (
        rows.filter(F.col("size") >= MIN_REVISIT)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    rows = rows.join(groups, ["digest", "size"], "left").withColumn("tag", F.monotonically_increasing_id())
    refers = F.when(F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [
                    text
                    for page, tag, url, html, keeper in zip(*(c.to_pylist() for c in part.columns), strict=True)
                    for text in records(page, tag, url, html.encode(), keeper)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = rows.select("page_id", "tag", "url", "html", refers.alias("refers")).mapInArrow(work, "value string")
    # The end of a record serves as the line separator: the files are plain archives.
    lines.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive."""
    while line := archive.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


_PARSED = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("digest", pa.string()),
        ("refers", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
    ]
)
_PARSED_SQL = (
    "record_id string, record_type string, target string, digest string, refers string,"
    " segment int, total long, block binary"
)
_DECODED_SQL = (
    "record_id string, record_type string, target string, digest string, refers string, payload binary, problem string"
)


def _parsed(files: DataFrame, segmented: bool) -> DataFrame:
    """Parsed records that are parts of segmented ones, or the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                for fields, block in parse(gzip.GzipFile(fileobj=raw) if packed else raw):
                    number = fields.get("warc-segment-number")
                    if (number is not None) != segmented:
                        continue
                    rows.append(
                        (
                            fields.get("warc-segment-origin-id", fields["warc-record-id"]), fields["warc-type"],
                            fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
                            fields.get("warc-refers-to"), number and int(number),
                            int(fields.get("warc-segment-total-length", -1)), block,
                        )
                    )
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)],
                            schema=_PARSED,
                        )
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED
            )

    return files.select("content").mapInArrow(work, _PARSED_SQL)


def decoded(kind: str, digest: str | None, block: bytes) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole record's block; revisits have no payload."""
    if kind == "revisit":
        return None, None
    try:
        payload = payload_of(block)
    except ValueError as error:
        return None, str(error)
    own = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (payload, None) if digest in (None, own) else (None, "the payload has another digest")


def _decode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.to_pydict()
        both = [decoded(*x) for x in zip(row["record_type"], row["digest"], row["block"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(5)), pa.array([p for p, _ in both], pa.binary()),
                pa.array([p for _, p in both], pa.string()),
            ],
            [*batch.schema.names[:5], "payload", "problem"],
        )


def joined(parts: list[tuple]) -> tuple:
    """One record from its segments, which come in order of their numbers."""
    first = parts[0]
    block = b"".join(p[7] for p in parts)
    if [p[5] for p in parts] != list(range(1, len(parts) + 1)):
        payload, problem = None, "a segment is missing or comes twice"
    elif parts[-1][6] != len(block):
        payload, problem = None, f"{len(block)} bytes, not {parts[-1][6]}"
    else:
        payload, problem = decoded(first[1], first[3], block)
    return (*first[:5], payload, problem)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come sorted by origin and number; one record's are held at a time."""
    names = [*_PARSED.names[:5], "payload", "problem"]
    kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts: list[tuple] = []
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if parts and parts[0][0] != row[0]:
                done.append(joined(parts))
                parts = []
            parts.append(row)
        if done:
            yield out(done)
    if parts:
        yield out([joined(parts)])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, target, refers_to, payload, problem), one row per response or revisit."""
    files = spark.read.format("binaryFile").load(path)
    whole = _parsed(files, segmented=False).mapInArrow(_decode_whole, _DECODED_SQL)
    parts = _parsed(files, segmented=True).repartition("record_id").sortWithinPartitions("record_id", "segment")
    rows = whole.unionByName(parts.mapInArrow(_reassemble, _DECODED_SQL))
    page = r"^<urn:page:(-?\d+)[:>]"
    return rows.select(
        F.expr(f"try_cast(regexp_extract(record_id, '{page}', 1) as long)".replace("\\", "\\\\")).alias("page_id"),
        "record_type",
        "target",
        F.expr(f"try_cast(regexp_extract(refers, '{page}', 1) as long)".replace("\\", "\\\\")).alias("refers_to"),
        "payload",
        "problem",
    )


def resolved(found: DataFrame) -> DataFrame:
    """Length and digest of each record's full payload; a revisit's are those of its response."""
    rows = found.select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("size"),
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("sha"), "problem",
    )
    # Written without payloads, so that the archives are read once.
    rows = materialize(rows, "records")
    referred = (
        rows.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("_id"))
        .agg(F.max("size").alias("_size"), F.max("sha").alias("_sha"))
    )
    # Only records that refer to another one meet it; those that do not would all be one key.
    again = rows.filter("refers_to is not null").join(referred, F.col("refers_to") == F.col("_id"), "left")
    own = rows.filter("refers_to is null").withColumns({"_size": F.lit(None).cast("long"), "_sha": F.lit(None).cast("string")})
    return again.drop("_id").unionByName(own).select(
        "page_id",
        F.coalesce("size", "_size").alias("payload_bytes"),
        F.coalesce("sha", "_sha").alias("payload_digest"),
        "record_type",
        "refers_to",
        "problem",
    )
