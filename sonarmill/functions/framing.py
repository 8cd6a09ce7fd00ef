"""Splitting packets into frames, length chains and padding included.

``split`` is plain Python over bytes; ``parsed`` is the Column, run over Arrow
batches. Errors are values of the ``error`` field (names in
``packet.ERRORS``); ``strict=True`` raises instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarmill.functions.packet import MAX_FRAME_BYTES, MAX_TENTHS, configurations

PARSED = "header int, frames array<binary>, padding int, used int, error string"
_TENTHS = [size for _, _, _, size in configurations()]


class FramingError(ValueError):
    """A packet breaks the framing rules; ``args[0]`` is the error's name."""


@dataclass
class Frames:
    header: int
    frames: list[bytes]
    padding: int
    used: int


class _Bytes:
    """A cursor over a packet's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data)

    @property
    def left(self) -> int:
        return self.end - self.at

    def byte(self, error: str) -> int:
        if self.at >= self.end:
            raise FramingError(error)
        self.at += 1
        return self.data[self.at - 1]

    def length(self) -> int:
        first = self.byte("bad_frame_length")
        return first if first < 252 else first + 4 * self.byte("bad_frame_length")

    def chunk(self, n: int) -> bytes:
        if n > self.left:
            raise FramingError("bad_frame_length")
        self.at += n
        return self.data[self.at - n : self.at]


def split(data: bytes, delimited: bool = False) -> Frames:
    """The frames of a packet. ``delimited``: all lengths are explicit and bytes may follow
    the packet (``used`` tells where it ends)."""
    cur = _Bytes(data)
    header = cur.byte("empty")
    code, count, padding, lengths = header & 3, 1 + (header & 3 > 0), 0, None
    varying = code == 2
    if code == 3:
        flags = cur.byte("bad_frame_length")
        count, varying = flags & 63, flags >= 128
        if not 0 < count * _TENTHS[header >> 3] <= MAX_TENTHS:
            raise FramingError("bad_frame_count")
        if flags & 64:
            more = 255
            while more == 255:
                more = cur.byte("bad_padding")
                padding += more - (more == 255)
            if not delimited:
                if padding > cur.left:
                    raise FramingError("bad_padding")
                cur.end -= padding
    if delimited:
        lengths = [cur.length() for _ in range(count)] if varying else [cur.length()] * count
    elif varying:
        lengths = [cur.length() for _ in range(count - 1)]
        rest = cur.left - sum(lengths)
        if rest < 0:
            raise FramingError("bad_frame_length")
        if rest > MAX_FRAME_BYTES:
            raise FramingError("frame_too_large")
        lengths.append(rest)
    else:
        if cur.left % count:
            raise FramingError("code1_uneven" if code == 1 else "cbr_uneven")
        if cur.left // count > MAX_FRAME_BYTES:
            raise FramingError("frame_too_large")
        lengths = [cur.left // count] * count
    frames = [cur.chunk(n) for n in lengths]
    if delimited and padding > cur.left:
        raise FramingError("bad_padding")
    used = cur.at + padding
    return Frames(header, frames, padding, used)


def split_streams(data: bytes, streams: int) -> list[Frames]:
    """A multistream payload: all but the last packet are self-delimited."""
    out, at = [], 0
    for k in range(streams):
        got = split(data[at:], delimited=k < streams - 1)
        out.append(got)
        at += got.used
    return out


def _row(data: bytes | None, delimited: bool, strict: bool) -> dict:
    if data is None:
        return dict.fromkeys(("header", "frames", "padding", "used", "error"))
    try:
        got = split(bytes(data), delimited)
    except FramingError as error:
        if strict:
            raise
        return {"header": data[0] if len(data) else None, "frames": None, "padding": None, "used": None, "error": error.args[0]}
    return {"header": got.header, "frames": got.frames, "padding": got.padding, "used": got.used, "error": None}


def parsed(data: Column, delimited: bool = False, strict: bool = False) -> Column:
    """struct<header, frames, padding, used, error> of a binary column; null stays null."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield pd.DataFrame([_row(d, delimited, strict) for d in series], columns=["header", "frames", "padding", "used", "error"])

    return run(data)
