"""Packet headers as Columns: nothing here leaves whole-stage code generation.

The first byte of a packet holds a configuration number (five bits), a stereo
flag and a frame-count code. The 32 configurations follow from a rule over the
three layers; ``header_table`` makes the dimension from that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FRAME_BYTES = 1275
MAX_TENTHS = 1200  # a packet holds at most 120 ms

#: Fixed values of the packet format (RFC 6716, section 3.1).
LAYERS = (
    ("speech", ("narrow", "medium", "wide"), (100, 200, 400, 600)),
    ("hybrid", ("superwide", "full"), (100, 200)),
    ("transform", ("narrow", "wide", "superwide", "full"), (25, 50, 100, 200)),
)
SAMPLE_RATE = {"narrow": 8000, "medium": 12000, "wide": 16000, "superwide": 24000, "full": 48000}
AUDIO_HZ = {"narrow": 4000, "medium": 6000, "wide": 8000, "superwide": 12000, "full": 20000}
BANDWIDTHS = tuple(SAMPLE_RATE)

ERRORS = {
    "empty": "the packet has no bytes",
    "frame_too_large": "a frame has more than 1275 bytes",
    "code1_uneven": "two equal frames need an even payload",
    "bad_frame_length": "a frame length is cut short or reaches past the end",
    "bad_frame_count": "no frames, or more than 120 ms of them",
    "bad_padding": "padding reaches past the end",
    "cbr_uneven": "equal frames don't divide the payload",
}


def configurations() -> list[tuple[int, str, str, int]]:
    """(config, mode, bandwidth, tenths of a ms a frame) of all 32 configurations."""
    rows = [(mode, band, size) for mode, bands, sizes in LAYERS for band in bands for size in sizes]
    return [(k, *row) for k, row in enumerate(rows)]


def header_table(spark: SparkSession) -> DataFrame:
    """The 32-row dimension; small by construction, so joins may broadcast it."""
    rows = [(k, mode, band, size, SAMPLE_RATE[band], AUDIO_HZ[band], size // 5 * 24) for k, mode, band, size in configurations()]
    return spark.createDataFrame(rows, "config int, mode string, bandwidth string, tenth_ms int, sample_rate_hz int, audio_hz int, frame_samples_48k int")


def byte_at(data: Column, place: int | Column) -> Column:
    """The unsigned byte at a 1-based place; null past the end."""
    one = F.substring(data, place, 1) if isinstance(place, int) else F.substring(data, place, F.lit(1))
    return F.conv(F.hex(F.when(F.length(one) > 0, one)), 16, 10).cast("int")


def header_byte(data: Column) -> Column:
    return byte_at(data, 1)


def config(header: Column) -> Column:
    return F.shiftright(header, 3)


def is_stereo(header: Column) -> Column:
    return header.bitwiseAND(4) != 0


def channels(header: Column) -> Column:
    return F.shiftright(header, 2).bitwiseAND(1) + 1


def frame_code(header: Column) -> Column:
    return header.bitwiseAND(3)


def make_header(config: Column, stereo: Column, code: Column) -> Column:
    """The header byte of its parts; parts out of range are an error."""
    ok = config.between(0, 31) & code.between(0, 3)
    byte = F.shiftleft(config.cast("int"), 3).bitwiseOR(F.shiftleft(stereo.cast("int"), 2)).bitwiseOR(code.cast("int"))
    return F.when(ok, byte).otherwise(F.raise_error(F.lit("header part out of range")).cast("int"))


def mode(header: Column) -> Column:
    c = config(header)
    return F.when(c < 12, "speech").when(c < 16, "hybrid").when(c < 32, "transform")


def bandwidth(header: Column) -> Column:
    c = config(header)
    out = F.when(c < 4, "narrow").when(c < 8, "medium").when(c < 12, "wide").when(c < 14, "superwide").when(c < 16, "full")
    return out.when(c < 20, "narrow").when(c < 24, "wide").when(c < 28, "superwide").when(c < 32, "full")


def bandwidth_rank(name: Column) -> Column:
    """Bandwidths in order, from 0."""
    return F.array_position(F.array(*map(F.lit, BANDWIDTHS)), name).cast("int") - 1


def tenth_ms(header: Column) -> Column:
    """Length of a frame in tenths of a millisecond."""
    c = config(header)
    speech = F.element_at(F.array(*map(F.lit, (100, 200, 400, 600))), c.bitwiseAND(3) + 1)
    hybrid = F.element_at(F.array(F.lit(100), F.lit(200)), c.bitwiseAND(1) + 1)
    transform = F.element_at(F.array(*map(F.lit, (25, 50, 100, 200))), c.bitwiseAND(3) + 1)
    return F.when(c < 12, speech).when(c < 16, hybrid).when(c < 32, transform)


def frame_samples(header: Column) -> Column:
    """Samples a channel and frame at 48 kHz."""
    return (tenth_ms(header) / 5 * 24).cast("int")


def count_byte(data: Column) -> Column:
    return byte_at(data, 2)


def frame_count(data: Column) -> Column:
    """Frames as the header says; code 3 needs a second byte, else null. Not checked."""
    code = frame_code(header_byte(data))
    return F.when(code == 0, 1).when(code < 3, 2).otherwise(count_byte(data).bitwiseAND(63))


def packet_samples(data: Column) -> Column:
    """48 kHz samples of the packet from its first two bytes; null if these are missing."""
    return (frame_samples(header_byte(data)) * frame_count(data)).cast("long")


def packet_duration(data: Column) -> Column:
    """Microseconds."""
    return (tenth_ms(header_byte(data)) * frame_count(data)).cast("long") * 100


def cheap_error(data: Column) -> Column:
    """The error of a packet as far as Columns can tell without walking length chains: codes 0, 1
    and code 3 with equal frames and no padding are judged completely, others by their counts only."""
    h = header_byte(data)
    code, rest, n, second = frame_code(h), F.length(data) - 1, F.length(data), count_byte(data)
    count = second.bitwiseAND(63)
    equal = (second.bitwiseAND(192) == 0) & (code == 3)
    return (
        F.when(n == 0, "empty")
        .when((code == 0) & (rest > MAX_FRAME_BYTES), "frame_too_large")
        .when((code == 1) & (rest % 2 != 0), "code1_uneven")
        .when((code == 1) & (rest / 2 > MAX_FRAME_BYTES), "frame_too_large")
        .when((code >= 2) & second.isNull(), "bad_frame_length")
        .when((code == 3) & ((count == 0) | (count * tenth_ms(h) > MAX_TENTHS)), "bad_frame_count")
        .when(equal & ((n - 2) % F.greatest(count, F.lit(1)) != 0), "cbr_uneven")
        .when(equal & ((n - 2) / F.greatest(count, F.lit(1)) > MAX_FRAME_BYTES), "frame_too_large")
    )


def equal_frames(data: Column) -> Column:
    """The frames of codes 0, 1 and code 3 with equal frames and no padding, as an array; else null."""
    h, n = header_byte(data), F.length(data)
    code, second = frame_code(h), count_byte(data)
    skip = F.when(code == 3, 2).otherwise(1)
    count = frame_count(data)
    plain = cheap_error(data).isNull() & ((code < 2) | ((code == 3) & (second.bitwiseAND(192) == 0)))
    size = ((n - skip) / F.greatest(count, F.lit(1))).cast("int")
    return F.when(plain, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.substring(data, (skip + 1 + k * size).cast("int"), size)))
