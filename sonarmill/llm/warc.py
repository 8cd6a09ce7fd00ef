"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer builds records with SQL functions, compresses each to a gzip member of
its own, so that damage costs one record, and hands the members to Spark's text
writer as lines; the line separator is an empty gzip member. The files
are therefore committed and placed like any other Spark output, and any
gzip reader reads them. An archive holds at most ``records_per_archive`` records,
so that one archive fits in one reading task.

The reader walks an archive record by record. A record is taken only if its
version line, header block, length, closing blank lines and payload digest
hold. After a failed check it searches for the next version line (or, in
compressed data, the next gzip member that opens) where a record holds, goes on
from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.session import fresh_path

#: The base32 alphabet, a digest's 5-hex-digit groups, and names from the WARC 1.1 standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1."
#: The first bytes of a gzip member, and a whole member without content.
MAGIC = b"\x1f\x8b\x08"
EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\x03" + b"\x03\0" + b"\0" * 8

RECORDS_PER_ARCHIVE = 2000


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    http: bytes
    payload: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_at(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record that starts at ``at`` and the offset after it, or why there is none."""
    if data[at : at + len(VERSION)] != VERSION:
        return "no version line"
    end = data.find(b"\r\n\r\n", at, at + (1 << 20))
    if end < 0:
        return "header block has no end"
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without a colon"
        headers.setdefault(name.decode("utf-8", "replace").lower(), value.decode("utf-8", "replace").strip())
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return "no content length"
    start, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data):
        return "record is cut short"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    block = data[start:stop]
    http, payload = b"", block
    if headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            return "HTTP header has no end"
    named = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and named.startswith("sha1:") and named[5:] != digest_of(payload):
        return "payload digest differs"
    return Record(at, headers, http, payload), stop + 4


def salvage_plain(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of uncompressed archive bytes, in order."""
    at = 0
    while at < len(data):
        found = _record_at(data, at)
        if not isinstance(found, str):
            record, after = found
            record.offset += base
            yield record
            at = after
            continue
        bad, reason = at, found
        while True:
            at = data.find(VERSION, at + 1)
            if at < 0:
                at = len(data)
                break
            if not isinstance(_record_at(data, at), str):
                break
        yield Gap(base + bad, base + at, reason)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """As ``salvage_plain``, also for gzip members; offsets inside a member count from the member's start."""
    if data[:3] != MAGIC:
        # Compressed data with a damaged start, if some later member is whole and opens a record.
        at = -1 if data[: len(VERSION)] == VERSION else data.find(MAGIC)
        while at >= 0 and ((member := _member(data, at)) is None or member[0][: len(VERSION)] != VERSION):
            at = data.find(MAGIC, at + 1)
        if at < 0:
            yield from salvage_plain(data)
            return
    at = 0
    while at < len(data):
        member = _member(data, at)
        if member is not None:
            yield from salvage_plain(member[0], at)
            at = member[1]
            continue
        bad, partial = at, _partial(data, at)
        while True:
            at = data.find(MAGIC, at + 1)
            if at < 0:
                at = len(data)
                break
            if _member(data, at) is not None:
                break
        good = 0
        for item in salvage_plain(partial, bad):
            if isinstance(item, Record):
                good += 1
                yield item
        yield Gap(bad, at, f"damaged gzip member; {good} records before the damage were kept")


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A whole gzip member and the offset after it; what follows is not copied."""
    if data[at : at + 3] != MAGIC:
        return None
    unzip, out, view, size = zlib.decompressobj(31), [], memoryview(data), 1024
    while at < len(data):
        part = view[at : at + size]
        try:
            out.append(unzip.decompress(part))
        except zlib.error:
            return None
        at += len(part)
        if unzip.eof:
            return b"".join(out), at - len(unzip.unused_data)
        size = min(2 * size, 1 << 20)
    return None


def _partial(data: bytes, at: int) -> bytes:
    """What can be decompressed before the damage, to the byte."""
    unzip, out = zlib.decompressobj(31), []
    for k in range(at, len(data), 4096):
        block, kept = data[k : k + 4096], unzip.copy()
        try:
            out.append(unzip.decompress(block))
        except zlib.error:
            try:
                for j in range(len(block)):
                    out.append(kept.decompress(block[j : j + 1]))
            except zlib.error:
                pass
            break
        if unzip.eof:
            break
    return b"".join(out)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without name or time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200).column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r, 6, mtime=0) for r in part], pa.binary())], names=["value"])


def base32_of_hex(digest: Column) -> Column:
    """The bare upper-case base32 of a SHA-1 in hex, with SQL functions only."""
    parts = []
    for k in range(8):
        v = F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those
    with the largest page_id are response records and the others revisit them.
    A null html is an empty payload, a null url is left out, a null page_id is
    below all others (and a response if it has no equal with an id). Rows
    repeated with the largest page_id are responses all. Extra columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), "[\\x00-\\x20\\x7f]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    newest = rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(newest, "sha1", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")) & (F.col("bytes") >= min_revisit_bytes)

    def urn(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.col("http"), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("newest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    record = F.concat(header, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary")
    out = rows.withColumn("revisit", revisit).withColumn("http", http).withColumn("block", block).select(record.alias("value"))
    members = out.mapInArrow(_compressed, "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", records_per_archive).text(path)


READ_SCHEMA = "path string, kind string, start long, stop long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _read(with_payload: bool):
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def row_of(path: str, item: Record | Gap) -> tuple:
        if isinstance(item, Gap):
            return (path, "gap", item.start, item.end, item.reason, *[None] * 7)
        h = item.headers
        kind = h.get("warc-type")
        named = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", item.http)
        full = len(item.payload) if kind != "revisit" or not named else int(named[1])
        digest = digest_of(item.payload) if kind != "revisit" else h.get("warc-payload-digest", "").removeprefix("sha1:")
        return (path, "record", item.offset, None, None, _page_of(h.get("warc-record-id")), h.get("warc-target-uri"), kind, _page_of(h.get("warc-refers-to")), full, digest, item.payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column(0)[k].as_py(), []
                for item in salvage(batch.column(1)[k].as_py()):
                    rows.append(row_of(path, item))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``.

    kind is ``record`` or ``gap``; a gap has start, stop and reason. An archive
    is read by one task; empty files give nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), READ_SCHEMA)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP5_SQL = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as newest from p group by h)
select p.page_id, strlen(p.body)::BIGINT as payload_bytes, {_CHARS.replace("(h,", "(p.h,")} as payload_digest,
  case when p.page_id = g.newest then 'response' else 'revisit' end as record_type,
  case when p.page_id = g.newest then null else g.newest end as refers_to
from p join g on p.h = g.h
"""
