"""Kernels of the transform layer: lapped transform, bands, pulse quantiser, filters.

These are numpy functions of one frame, and Columns that run them over Arrow
batches. They follow the public format's definitions (RFC 6716, section 4.3); the
full bit allocation and the packet decoder are not here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band edges in bins of a 2.5 ms frame, and the coefficient of the emphasis filter.
BAND_EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)
EMPHASIS = 0.85000610
OVERLAP = 120


@lru_cache(maxsize=16)
def window(overlap: int) -> np.ndarray:
    """The rising half: squares of it and of its mirror add up to one."""
    inner = np.sin(np.pi / 2 * (np.arange(overlap) + 0.5) / overlap)
    return np.sin(np.pi / 2 * inner * inner)


@lru_cache(maxsize=16)
def _basis(n: int) -> np.ndarray:
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


def _long_window(n: int, overlap: int) -> np.ndarray:
    flat = (n - overlap) // 2
    rise = np.concatenate([np.zeros(flat), window(overlap), np.ones(flat)])
    return np.concatenate([rise, rise[::-1]])


def mdct(block: np.ndarray, overlap: int = OVERLAP) -> np.ndarray:
    """n coefficients of 2n samples; neighbouring blocks share n samples, of which ``overlap`` are faded."""
    n = len(block) // 2
    return _basis(n) @ (block * _long_window(n, overlap)) * (2 / n) ** 0.5


def imdct(coefficients: np.ndarray, overlap: int = OVERLAP) -> np.ndarray:
    """2n windowed samples; added to the neighbours' overlapping halves they restore the signal."""
    n = len(coefficients)
    return (coefficients @ _basis(n)) * _long_window(n, overlap) * (2 / n) ** 0.5


def analysis_frames(x: np.ndarray, n: int, overlap: int = OVERLAP) -> np.ndarray:
    """Coefficients of consecutive frames; the signal is padded by one silent frame at each end."""
    frames = -(-len(x) // n) + 1
    padded = np.zeros((frames + 1) * n)
    padded[n : n + len(x)] = x
    return np.array([mdct(padded[k * n : (k + 2) * n], overlap) for k in range(frames)])


def synthesis_frames(coefficients: np.ndarray, length: int, overlap: int = OVERLAP) -> np.ndarray:
    """The signal again, by overlapping and adding."""
    frames, n = coefficients.shape
    out = np.zeros((frames + 1) * n)
    for k, c in enumerate(coefficients):
        out[k * n : (k + 2) * n] += imdct(c, overlap)
    return out[n : n + length]


def pre_emphasis(x: np.ndarray, before: float = 0.0) -> np.ndarray:
    return np.asarray(x, float) - EMPHASIS * np.concatenate([[before], x[:-1]])


def de_emphasis(x: np.ndarray, state: float = 0.0) -> np.ndarray:
    out = np.empty(len(x))
    for k, v in enumerate(x):
        state = v + EMPHASIS * state
        out[k] = state
    return out


def bands(size: int) -> list[tuple[int, int]]:
    """Bin ranges of the 21 bands in a frame of ``size`` bins (120, 240, 480 or 960)."""
    scale = size // 120
    return [(a * scale, b * scale) for a, b in zip(BAND_EDGES[:-1], BAND_EDGES[1:], strict=True)]


def band_amplitudes(coefficients: np.ndarray) -> np.ndarray:
    """Root of each band's energy, never quite 0."""
    return np.array([np.sqrt(1e-27 + coefficients[a:b] @ coefficients[a:b]) for a, b in bands(len(coefficients))])


def unit_bands(coefficients: np.ndarray) -> np.ndarray:
    """Every band scaled to unit length; bins above the last band are 0."""
    out = np.zeros(len(coefficients))
    for (a, b), size in zip(bands(len(coefficients)), band_amplitudes(coefficients), strict=True):
        out[a:b] = coefficients[a:b] / size
    return out


def pulses(x: np.ndarray, k: int) -> np.ndarray:
    """Integers with absolute sum ``k`` in the direction of ``x``: a projection, then pulse by
    pulse where the correlation per length grows most (ties: the first place)."""
    size, sign = np.abs(np.asarray(x, float)), np.where(np.asarray(x) < 0, -1, 1)
    if not len(size) or k <= 0:
        return np.zeros(len(size), int)
    if size.sum() <= 1e-15:
        size = np.zeros(len(size))
        size[0] = 1.0
    y = np.floor(k * size / size.sum()).astype(int) if k > len(size) // 2 else np.zeros(len(size), int)
    while y.sum() > k:
        y[np.argmax(y)] -= 1
    xy, yy = float(size @ y), float(y @ y)
    for _ in range(k - int(y.sum())):
        gain = (xy + size) ** 2 / (yy + 2 * y + 1)
        j = int(np.argmax(gain))
        xy, yy = xy + size[j], yy + 2 * y[j] + 1
        y[j] += 1
    return y * sign


def rotate(x: np.ndarray, k: int, spread: int, inverse: bool = False) -> np.ndarray:
    """Spreading rotation of a band before (or, inverse, after) it is given ``k`` pulses.

    ``spread`` 0 leaves it alone; 1 to 3 turn by more. Nothing is turned when pulses are plenty.
    """
    n, out = len(x), np.array(x, float)
    if spread == 0 or 2 * k >= n or n < 2:
        return out
    factor = {1: 15, 2: 10, 3: 5}[spread]
    share = n / (n + factor * k)
    angle = np.pi / 4 * share * share
    c, s = np.cos(angle), np.sin(angle) * (-1 if inverse else 1)

    def turn(places) -> None:
        for i in places:
            a, b = out[i], out[i + 1]
            out[i], out[i + 1] = c * a - s * b, c * b + s * a

    up, down = range(n - 1), range(n - 3, -1, -1)
    for places in ((list(down)[::-1], list(up)[::-1]) if inverse else (up, down)):
        turn(places)
    return out


def haar(x: np.ndarray, step: int = 1) -> np.ndarray:
    """Sums and differences of places ``step`` apart; its own inverse."""
    pairs = np.asarray(x, float).reshape(-1, 2, step) * 2**-0.5
    return np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).ravel()


def hadamard_order(blocks: int) -> list[int]:
    """Order of short blocks by sequency: bits reversed, then Gray-coded."""
    bits = blocks.bit_length() - 1
    flipped = [int(f"{k:0{bits}b}"[::-1], 2) if bits else 0 for k in range(blocks)]
    return [flipped.index(k ^ (k >> 1)) for k in range(blocks)]


def comb(x: np.ndarray, period: int, gain: float, taps: tuple[float, float, float] = (0.3066406250, 0.2170410156, 0.1296386719)) -> np.ndarray:
    """Adds the signal one period before, smoothed by five symmetric taps; before the start is silence."""
    x = np.asarray(x, float)
    padded = np.concatenate([np.zeros(period + 2), x])
    past = lambda d: padded[2 - d : 2 - d + len(x)]  # noqa: E731  the sample period + d back
    out = x + gain * (taps[0] * past(0) + taps[1] * (past(1) + past(-1)) + taps[2] * (past(2) + past(-2)))
    return out


def mid_side(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mid, side and the angle between them in [0, 1] (0: all mid)."""
    mid, side = (np.asarray(left) + right) / 2, (np.asarray(left) - right) / 2
    return mid, side, float(np.arctan2(np.linalg.norm(side), np.linalg.norm(mid)) * 2 / np.pi)


def resample(x: np.ndarray, up: int, down: int, taps: int = 24) -> np.ndarray:
    """Rate times up / down by a windowed-sinc filter evaluated at the wanted places."""
    x = np.asarray(x, float)
    n, cut = len(x) * up // down, min(1.0, up / down)
    at = np.arange(n) * down / up
    k = np.floor(at).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)[None, :]
    d = at[:, None] - k
    weight = cut * np.sinc(cut * d) * np.cos(np.pi * d / (2 * taps)) ** 2 * (np.abs(d) < taps)
    inside = (k >= 0) & (k < len(x))
    return (weight * np.where(inside, x[np.clip(k, 0, max(len(x) - 1, 0))], 0)).sum(axis=1) if len(x) else x


def kernel(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A Column function of an array column from a function of one frame; nulls and empty arrays give null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([None if x is None or not len(x) else np.asarray(f(np.asarray(x, float)), float).tolist() for x in series], dtype=object)

    return run.asNondeterministic()
