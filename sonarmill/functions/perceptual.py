"""A masked spectral distortion score between two signals, in percent.

Frames of 480 samples every 120 are turned into power spectra; energy masks its
neighbours in frequency, what follows it in time, and (stereo) the other channel;
two successive frames are averaged; the ratio of spectra r is pooled as r - ln r - 1
over bins, bands and frames. 100 is no difference; the score may be negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME, HOP = 480, 120
#: Power of the noise floor, edges of the 21 bands in bins, masking slopes, and the scale of the score.
FLOOR = 100_000.0
EDGES = (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 68, 80, 96, 120, 156, 200)
UPWARD, DOWNWARD, LATER, ACROSS, SPREAD = 0.1, 0.03, 0.5, 0.01, 0.1
SCALE = 1.13
CROSSOVER = (79, 80, 81)  # bins where layers meet count a tenth


def power(x: np.ndarray) -> np.ndarray:
    """(frames, channels, bins) of int16-scaled samples (n, channels)."""
    n = (len(x) - FRAME + HOP) // HOP
    hann = 0.5 - 0.5 * np.cos(2 * np.pi / (FRAME - 1) * np.arange(FRAME))
    at = np.arange(n)[:, None] * HOP + np.arange(FRAME)[None, :]
    blocks = x[at] * hann[None, :, None]
    spectrum = np.fft.rfft(blocks, axis=1)[:, : EDGES[-1]]
    return np.moveaxis(np.abs(spectrum) ** 2 + FLOOR, 1, 2)


def band_means(p: np.ndarray) -> np.ndarray:
    return np.stack([p[..., a:b].mean(axis=-1) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)], axis=-1)


def masked(p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Spectra plus a share of the mask of their band."""
    out = p.copy()
    for k, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True)):
        out[..., a:b] += SPREAD * mask[..., k : k + 1]
    return out


def masks(p: np.ndarray) -> np.ndarray:
    m = band_means(p)
    for k in range(1, m.shape[-1]):
        m[..., k] += UPWARD * m[..., k - 1]
    for k in range(m.shape[-1] - 2, -1, -1):
        m[..., k] += DOWNWARD * m[..., k + 1]
    for t in range(1, len(m)):
        m[t] += LATER * m[t - 1]
    if m.shape[1] == 2:
        m = m + ACROSS * m[:, ::-1]
    return m


def score(reference: np.ndarray, decoded: np.ndarray) -> float | None:
    """Quality of ``decoded`` against ``reference``, both (n,) or (n, channels) in [-1, 1]; None if too short."""
    x, y = (np.asarray(s, float).reshape(len(s), -1) * 32768 for s in (reference, decoded))
    n = min(len(x), len(y))
    if n < FRAME + HOP:
        return None
    px, py = power(x[:n]), power(y[:n])
    mask = masks(px)
    px, py = masked(px, mask), masked(py, mask)
    px, py = (p[1:] + p[:-1] for p in (px, py))
    ratio = py / px
    pooled = ratio - np.log(ratio) - 1
    pooled[..., list(CROSSOVER)] *= 0.1
    per_band = np.stack([pooled[..., a:b].mean(axis=(1, 2)) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)], axis=-1)
    frames = (per_band**2).mean(axis=1)
    error = float(np.mean(frames**4)) ** (1 / 16)
    return 100 * (1 - 0.5 * np.log1p(error) / np.log(SCALE))


def quality(reference: Column, decoded: Column, channels: int = 1) -> Column:
    """The score of two interleaved array columns; null for nulls and signals under 600 samples a channel."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                whole = a is not None and b is not None
                cut = lambda s: np.asarray(s)[: len(s) // channels * channels].reshape(-1, channels)
                out.append(score(cut(a), cut(b)) if whole else None)
            yield pd.Series(out, dtype=float)

    return run.asNondeterministic()(reference, decoded)


def dominant(x: np.ndarray, hz: list[float], rate: float = 48000.0) -> float | None:
    """Which of the given frequencies the signal has most power at; None for an empty signal."""
    x = np.asarray(x, float)
    if not len(x):
        return None
    t = np.arange(len(x)) / rate
    strength = [abs(x @ np.exp(-2j * np.pi * f * t)) for f in hz]
    return hz[int(np.argmax(strength))]


def best_lag_snr(reference: np.ndarray, decoded: np.ndarray, max_lag: int = 2000, warm_up: int = 960) -> tuple[int, float]:
    """(lag, SNR in dB) of the delay at which the decoded signal fits best; the first samples are left out."""
    best = (0, -np.inf)
    for lag in range(max_lag + 1):
        n = min(len(reference), len(decoded) - lag)
        if n <= warm_up:
            break
        a, b = reference[warm_up:n], decoded[lag + warm_up : lag + n]
        noise = float((a - b) @ (a - b))
        snr = np.inf if noise == 0 else 10 * np.log10(max(float(a @ a), 1e-300) / noise)
        if snr > best[1]:
            best = (lag, snr)
    return best
