"""Words and word shingles of UTF-8 text as 64-bit numbers, without Python strings.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; all of
those are ASCII, so working on bytes gives the same words as working on code
points. Texts are taken from Arrow buffers in slabs of bounded size (one text
longer than a slab is a slab of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 19
SHINGLE = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SLOTS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLAB_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slabs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows, about SLAB_BYTES each."""
    raw, off = buffers_of(column)
    first, rows = 0, len(off) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(off, off[first] + SLAB_BYTES, "right")) - 1)
        last = min(last, rows)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (plus the total)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SEPARATOR[data]
    border = np.zeros(n + 1, bool)
    border[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text, in order.

    A text with fewer words gives the whole sequence as one; none gives none.
    """
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h += words[k : n - width + 1 + k] * _SLOTS[k]
    return mix64(h)


def texts_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of the column."""
    for first, data, off in slabs(column):
        starts, ends, at = word_spans(data, off)
        h = word_hashes(data, starts, ends, lower)
        for k in range(len(off) - 1):
            yield first + k, h[at[k] : at[k + 1]]


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of the column."""
    for row, words in texts_words(column):
        yield row, np.unique(shingle_hashes(words, size))
