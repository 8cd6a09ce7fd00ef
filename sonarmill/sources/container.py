"""Ogg containers: page scan with resynchronisation, packet reassembly, headers, timing, writer.

Files come in through Spark's ``binaryFile`` source, so any store that Spark
reads will do; a file is scanned by one task. From pages on, rows are keyed by
(path, serial) and streams are worked on in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarmill.functions.packet import packet_samples
from sonarmill.streaming.fold import Fold, by_stream, fold_batch

#: Fixed values of the container format (RFC 3533, RFC 7845).
CAPTURE = b"OggS"
HEAD_MAGIC, TAGS_MAGIC = b"OpusHead", b"OpusTags"
HEADER_BYTES = 27
NO_GRANULE = 0xFFFFFFFFFFFFFFFF
MAX_SEGMENTS = 255
MAX_PACKET = 16 << 20

_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def checksum(data: bytes) -> int:
    """The container's CRC-32: bits high first, zero start, no final inversion.

    It is zlib's CRC seen in a mirror: same polynomial, other bit order.
    """
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


class PageError(ValueError):
    """No page here; ``args[0]`` is truncated, no_capture, bad_version or bad_checksum."""


@dataclass
class Page:
    continued: bool
    bos: bool
    eos: bool
    granule: int | None
    serial: int
    sequence: int
    lacing: bytes
    body: bytes

    def to_bytes(self) -> bytes:
        flags = self.continued | self.bos << 1 | self.eos << 2
        granule = NO_GRANULE if self.granule is None else self.granule
        start = CAPTURE + struct.pack("<BBQII", 0, flags, granule, self.serial, self.sequence)
        rest = bytes([len(self.lacing)]) + self.lacing + self.body
        return start + struct.pack("<I", checksum(start + bytes(4) + rest)) + rest


def page_at(data: bytes, at: int) -> tuple[Page, int]:
    """The page at ``at`` and the offset behind it."""
    head = data[at : at + HEADER_BYTES]
    if len(head) < HEADER_BYTES:
        raise PageError("truncated" if head[:4] == CAPTURE[: len(head[:4])] else "no_capture")
    if head[:4] != CAPTURE:
        raise PageError("no_capture")
    version, flags, granule, serial, sequence, crc, segments = struct.unpack("<BBQIIIB", head[4:])
    if version:
        raise PageError("bad_version")
    lacing = data[at + HEADER_BYTES : at + HEADER_BYTES + segments]
    start = at + HEADER_BYTES + segments
    end = start + sum(lacing)
    if len(lacing) < segments or end > len(data):
        raise PageError("truncated")
    if checksum(head[:22] + bytes(4) + data[at + 26 : end]) != crc:
        raise PageError("bad_checksum")
    return Page(bool(flags & 1), bool(flags & 2), bool(flags & 4), None if granule == NO_GRANULE else granule, serial, sequence, lacing, data[start:end]), end


def scan(data: bytes, past_truncation: bool = False) -> Iterator[tuple[int, Page]]:
    """(offset, page) of every valid page, searching on after damage.

    A page cut short ends the scan, unless ``past_truncation``: then the search
    goes on, for a damaged segment table can make a whole page look cut.
    """
    at = 0
    while 0 <= at < len(data):
        try:
            page, end = page_at(data, at)
        except PageError as error:
            if error.args[0] == "truncated" and not past_truncation:
                return
            at = data.find(CAPTURE, at + 1)
            continue
        yield at, page
        at = end


@dataclass
class Assembly(Fold):
    """Packets of one stream from its pages in order; a gap or a false continuation drops what is unfinished."""

    part: bytearray = field(default_factory=bytearray)
    open: bool = False
    lost: bool = False
    last: int | None = None
    made: int = 0

    def step(self, row: dict) -> list[dict]:
        gap = self.last is not None and row["sequence"] != (self.last + 1) % (1 << 32)
        self.last = row["sequence"]
        if gap or row["continued"] != self.open:
            self.part, self.open, self.lost = bytearray(), False, False
        out, at, lacing = [], 0, row["lacing"]
        for k, size in enumerate(lacing):
            if len(self.part) + size > MAX_PACKET:
                self.lost, self.part = True, bytearray()
            if not self.lost:
                self.part += row["body"][at : at + size]
            at, self.open = at + size, True
            if size < 255:
                if not self.lost:
                    out.append({"packet_no": self.made, "data": bytes(self.part), "granule": None, "eos": row["eos"], "ends_page": k == len(lacing) - 1})
                    self.made += 1
                self.part, self.open, self.lost = bytearray(), False, False
        if out:
            out[-1]["granule"] = row["granule"]
        return out


PAGE_SCHEMA = "path string, page_no long, offset long, continued boolean, bos boolean, eos boolean, granule long, serial long, sequence long, lacing binary, body binary"
PACKET_SCHEMA = "path string, serial long, packet_no long, data binary, granule long, eos boolean, ends_page boolean"


def pages_of(files: DataFrame, past_truncation: bool = False) -> DataFrame:
    """Pages of every row (path, content); nulls have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [
                    (path, k, at, p.continued, p.bos, p.eos, p.granule if p.granule is None or p.granule < 1 << 63 else None, p.serial, p.sequence, p.lacing, p.body)
                    for k, (at, p) in enumerate(scan(bytes(content) if content is not None else b"", past_truncation))
                ]
                out = pd.DataFrame(rows, columns=names)
                out["granule"] = out["granule"].astype("Int64")
                yield out

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    return pages_of(spark.read.format("binaryFile").load(path), **options)


def packets_of(pages: DataFrame) -> DataFrame:
    """Reassembled packets of every (path, serial), in page order."""
    columns = pages.select("path", "serial", "page_no", "sequence", "continued", "eos", "granule", "lacing", "body")
    return fold_batch(columns, ["path", "serial"], ["page_no"], Assembly, PACKET_SCHEMA)


def first_audio_serial(pages: DataFrame) -> DataFrame:
    """(path, serial) of each file's first opening page whose body starts with the id header's magic."""
    opening = pages.where(F.col("bos") & (F.substring("body", 1, 8) == F.lit(HEAD_MAGIC)))
    return opening.groupBy("path").agg(F.min_by("serial", "page_no").alias("serial"))


def parse_head(data: bytes) -> dict:
    """Identification header; ValueError names what is wrong."""
    if len(data) < 19 or data[:8] != HEAD_MAGIC:
        raise ValueError("invalid_id_header")
    version, channels, pre_skip, rate, gain, family = struct.unpack("<BBHIhB", data[8:19])
    if version > 15:
        raise ValueError("unsupported_version")
    out = {"version": version, "channel_count": channels, "pre_skip": pre_skip, "input_sample_rate": rate, "output_gain_q8": gain, "family": family, "stream_count": None, "coupled_count": None, "mapping": None}
    if channels == 0 or (family == 0 and channels > 2):
        raise ValueError("invalid_id_header")
    if family:
        table = data[19 : 21 + channels]
        if len(table) < 2 + channels:
            raise ValueError("invalid_id_header")
        streams, coupled, mapping = table[0], table[1], list(table[2:])
        if not streams or coupled > streams or streams + coupled > 255 or any(m != 255 and m >= streams + coupled for m in mapping):
            raise ValueError("invalid_id_header")
        out |= {"stream_count": streams, "coupled_count": coupled, "mapping": mapping}
    return out


def make_head(channel_count: int, pre_skip: int = 312, input_sample_rate: int = 48000, output_gain_q8: int = 0, family: int = 0, stream_count: int = 1, coupled_count: int = 0, mapping: list[int] | None = None, version: int = 1) -> bytes:
    if family == 0 and channel_count not in (1, 2):
        raise ValueError("family 0 has one or two channels")
    out = HEAD_MAGIC + struct.pack("<BBHIhB", version, channel_count, pre_skip, input_sample_rate, output_gain_q8, family)
    return out + bytes([stream_count, coupled_count, *(mapping or [])]) if family else out


def parse_tags(data: bytes) -> dict:
    """Vendor and comments as bytes; lengths are checked before anything is cut."""
    if data[:8] != TAGS_MAGIC:
        raise ValueError("invalid_comment_header")
    at = 8

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError("invalid_comment_header")
        at += 4
        return int.from_bytes(data[at - 4 : at], "little")

    def piece() -> bytes:
        nonlocal at
        n = number()
        if n > len(data) - at:
            raise ValueError("invalid_comment_header")
        at += n
        return data[at - n : at]

    vendor, count = piece(), number()
    if count > (len(data) - at) // 4:
        raise ValueError("invalid_comment_header")
    return {"vendor": vendor, "comments": [piece() for _ in range(count)]}


def make_tags(vendor: bytes, comments: list[bytes]) -> bytes:
    return TAGS_MAGIC + b"".join(struct.pack("<I", len(x)) + x for x in [vendor]) + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)


HEAD_FIELDS = "version int, channel_count int, pre_skip int, input_sample_rate long, output_gain_q8 int, family int, stream_count int, coupled_count int, mapping array<int>, error string"
TAG_FIELDS = "vendor binary, comments array<binary>, error string"


def _parsed(parse, fields: str):
    names = [f.split()[0] for f in fields.split(", ")]

    def one(data: bytes | None) -> dict:
        row = dict.fromkeys(names)
        if data is not None:
            try:
                row |= parse(bytes(data))
            except ValueError as error:
                row["error"] = error.args[0]
        return row

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            frame = pd.DataFrame([one(d) for d in series], columns=names)
            yield frame.astype({n: "Int64" for n in names if f"{n} int" in fields.split(", ") or f"{n} long" in fields.split(", ")})

    return run


def head(data: Column) -> Column:
    """The identification header as a struct; what is wrong with it is in ``error``."""
    return _parsed(parse_head, HEAD_FIELDS)(data)


def tags(data: Column) -> Column:
    return _parsed(parse_tags, TAG_FIELDS)(data)


def tag_value(comments: Column, name: str) -> Column:
    """The value of the first comment ``name=...``, whatever its case."""
    texts = F.transform(comments, lambda c: c.cast("string"))
    match = F.filter(texts, lambda t: t.contains("=") & (F.upper(F.substring_index(t, "=", 1)) == name.upper()))
    first = F.get(match, 0)
    return F.substring(first, F.lit(len(name) + 2), F.length(first))


def with_positions(packets: DataFrame, keys: list[str], order: str, data: str = "data", granule: str = "granule") -> DataFrame:
    """Adds ``end_pos_48k``: backward from the next known granule by the durations between, never below 0;
    behind the last one forward. Durations come from packet headers."""
    base = packets.withColumn("_dur", F.coalesce(packet_samples(F.col(data)), F.lit(0)))
    return positions_from(base, keys, order, granule, "_dur").drop("_dur")


def positions_from(rows: DataFrame, keys: list[str], order: str, granule: str, duration: str) -> DataFrame:
    """As ``with_positions`` with a column of durations."""
    by = Window.partitionBy(*keys).orderBy(order)
    onward = by.rowsBetween(0, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_anchor", F.first(granule, ignorenulls=True).over(onward)).withColumn("_known", F.last(granule, ignorenulls=True).over(before)).withColumn("_upto", F.sum(duration).over(before))
    # Total length up to the next anchor, and up to the last one.
    marked = marked.withColumn("_upto_anchor", F.first(F.when(F.col(granule).isNotNull(), F.col("_upto")), ignorenulls=True).over(onward))
    marked = marked.withColumn("_upto_known", F.last(F.when(F.col(granule).isNotNull(), F.col("_upto")), ignorenulls=True).over(before))
    back = F.greatest(F.col("_anchor") - (F.col("_upto_anchor") - F.col("_upto")), F.lit(0))
    forward = F.coalesce(F.col("_known"), F.lit(0)) + F.col("_upto") - F.coalesce(F.col("_upto_known"), F.lit(0))
    return marked.withColumn("end_pos_48k", F.when(F.col("_anchor").isNotNull(), back).otherwise(forward)).drop("_anchor", "_known", "_upto", "_upto_anchor", "_upto_known")


class Writer:
    """Pages from packets of one stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.out, self.lacing, self.body = bytearray(), bytearray(), bytearray()
        self.granule: int | None = None
        self.continued = False

    def push(self, packet: bytes, granule: int, eos: bool = False) -> None:
        sizes = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        at = 0
        for k, size in enumerate(sizes):
            done = k == len(sizes) - 1
            self.lacing.append(size)
            self.body += packet[at : at + size]
            at += size
            if done:
                self.granule = granule
            if len(self.lacing) == MAX_SEGMENTS:
                self.flush(eos and done)
                self.continued = not done
        if eos and self.lacing:
            self.flush(True)

    def flush(self, eos: bool = False, empty: bool = False) -> None:
        if self.lacing or empty:
            self.out += Page(self.continued, self.sequence == 0, eos, self.granule, self.serial, self.sequence, bytes(self.lacing), bytes(self.body)).to_bytes()
            self.sequence = (self.sequence + 1) % (1 << 32)
            self.lacing, self.body, self.granule, self.continued = bytearray(), bytearray(), None, False


def container(packets: list[bytes], durations: list[int], head_packet: bytes, tags_packet: bytes, serial: int = 1) -> bytes:
    """A whole stream: two header pages, then packets whose granules start at the pre-skip."""
    writer = Writer(serial)
    for header in (head_packet, tags_packet):
        writer.push(header, 0)
        writer.flush()
    position = parse_head(head_packet)["pre_skip"]
    for k, (packet, duration) in enumerate(zip(packets, durations, strict=True)):
        position += duration
        writer.push(packet, position, k == len(packets) - 1)
    if not packets:
        writer.granule = position
        writer.flush(True, empty=True)
    return bytes(writer.out)


def write_containers(packets: DataFrame, key: str, order: str, head_packet: bytes, tags_packet: bytes) -> DataFrame:
    """(key, content): one container a stream from packets (key, order, data, samples)."""

    def made(name, packets: list[bytes], samples: list[int]) -> pd.DataFrame:
        serial = zlib.crc32(str(name).encode())
        return pd.DataFrame({key: [name], "content": [container(packets, samples, head_packet, tags_packet, serial)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packets, samples = None, [], []
        for frame in frames:
            for name, data, n in zip(frame[key].tolist(), frame["data"].tolist(), frame["samples"].tolist(), strict=True):
                if packets and name != now:
                    yield made(now, packets, samples)
                    packets, samples = [], []
                now = name
                packets.append(bytes(data))
                samples.append(int(n))
        if packets:
            yield made(now, packets, samples)

    kind = packets.schema[key].dataType.simpleString()
    rows = packets.select(key, order, "data", F.coalesce(packet_samples(F.col("data")), F.lit(0)).alias("samples"))
    return by_stream(rows, [key], [order]).mapInPandas(run, f"{key} {kind}, content binary")


def bit_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(length, final range, payload) of test-vector framing: two big-endian numbers, then the payload; ends where bytes run out."""
    at = 0
    while at + 8 <= len(data):
        n, final = struct.unpack(">II", data[at : at + 8])
        if at + 8 + n > len(data):
            return
        yield n, final, data[at + 8 : at + 8 + n]
        at += 8 + n


def bit_record(data: Column, final_range: Column) -> Column:
    """The record of test-vector framing as a Column: length and final range, big-endian, then the packet."""
    number = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    return F.unhex(F.concat(number(F.length(data)), number(final_range), F.hex(data)))


def read_bit_records(files: DataFrame) -> DataFrame:
    """Records of every row (path, content) of test-vector framing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(path, k, n, final, data) for k, (n, final, data) in enumerate(bit_records(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "seq", "len", "final_range", "data"])

    return files.select("path", "content").mapInPandas(run, "path string, seq int, len long, final_range long, data binary")
