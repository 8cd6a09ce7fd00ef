"""Kernels of the speech layer: line spectra, gains, stereo, voice activity, concealment.

Integer functions follow the public format's arithmetic (RFC 6716, section 4.2); the
parameter codebooks and the packet decoder are not here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: the pseudo-random sequence and the gain scale.
RANDOM_FACTOR, RANDOM_STEP = 196314165, 907633515
GAIN_STEP, GAIN_OFFSET, GAIN_LEVELS = 0x1D1C71, 2090, 64


def next_random(seed: int) -> int:
    return (seed * RANDOM_FACTOR + RANDOM_STEP) & 0xFFFFFFFF


def log2_of(x: int) -> int:
    """128 times the logarithm of a positive integer, approximately: a parabola between powers of two."""
    lead = x.bit_length() - 1
    fraction = (x << 7 >> lead) & 127 if lead <= 7 else (x >> (lead - 7)) & 127
    return (lead << 7) + fraction + (fraction * (128 - fraction) * 179 >> 16)


def power2_of(x: int) -> int:
    """The inverse of ``log2_of``; negative numbers give 0, large ones the largest."""
    if x < 0:
        return 0
    if x >= 3967:
        return 0x7FFFFFFF
    whole, fraction = 1 << (x >> 7), x & 127
    return whole + ((fraction + (-174 * fraction * (128 - fraction) >> 16)) * whole >> 7)


def gain_of(index: int) -> int:
    """Subframe gain (times 65536) of a level from 0 to 63."""
    if not 0 <= index < GAIN_LEVELS:
        raise ValueError("gain level out of range")
    return power2_of((GAIN_STEP * index >> 16) + GAIN_OFFSET)


def gain_indices(codes: list[int], previous: int | None) -> list[int]:
    """Levels of a frame's subframes from coded numbers: the first absolute (after a reset: as is), others
    relative with a double step at the upper end."""
    out: list[int] = []
    for k, code in enumerate(codes):
        if k == 0 and previous is None:
            level = code
        elif k == 0:
            level = max(code, previous - 16)
        else:
            level = min(max(max(2 * code - 16, out[-1] + code - 4), 0), GAIN_LEVELS - 1)
        out.append(level)
    return out


def line_spectra(a: np.ndarray) -> np.ndarray:
    """Line spectral frequencies in (0, pi) of a predictor."""
    poly = np.concatenate([[1.0], -np.asarray(a, float)])
    both = np.concatenate([poly, [0.0]]), np.concatenate([[0.0], poly[::-1]])
    angles = []
    for p in (both[0] + both[1], both[0] - both[1]):
        w = np.angle(np.roots(p))
        angles += [x for x in w if 1e-6 < x < np.pi - 1e-6]
    return np.sort(angles)


def from_line_spectra(w: np.ndarray) -> np.ndarray:
    """The predictor of line spectral frequencies."""
    order = len(w)
    parts = []
    for offset in (0, 1):
        p = np.array([1.0])
        for x in w[offset::2]:
            p = np.convolve(p, [1.0, -2 * np.cos(x), 1.0])
        parts.append(p)
    even, odd = parts
    if order % 2:
        odd = np.convolve(odd, [1.0, 0.0, -1.0])
    else:
        even, odd = np.convolve(even, [1.0, 1.0]), np.convolve(odd, [1.0, -1.0])
    return -(even + odd)[1 : order + 1] / 2


def spaced(w: np.ndarray, least: float, rounds: int = 20) -> np.ndarray:
    """Line spectra pushed apart to a least distance from each other and from 0 and pi."""
    w = np.sort(np.asarray(w, float))
    for _ in range(rounds):
        edges = np.diff(np.concatenate([[0.0], w, [np.pi]]))
        k = int(np.argmin(edges))
        if edges[k] >= least - 1e-12:
            return w
        if k == 0:
            w[0] = least
        elif k == len(w):
            w[-1] = np.pi - least
        else:
            centre = np.clip((w[k - 1] + w[k]) / 2, least * (k + 0.5), np.pi - least * (len(w) - k + 0.5))
            w[k - 1], w[k] = centre - least / 2, centre + least / 2
    for k in range(len(w)):
        w[k] = max(w[k], (w[k - 1] if k else 0.0) + least)
    for k in range(len(w) - 1, -1, -1):
        w[k] = min(w[k], (w[k + 1] if k + 1 < len(w) else np.pi) - least)
    return w


def prediction_gain(a: np.ndarray) -> float | None:
    """Inverse of the prediction gain by stepping down the recursion; None if the filter is unstable."""
    a, out = np.asarray(a, float), 1.0
    while len(a):
        k = a[-1]
        if abs(k) >= 1:
            return None
        out *= 1 - k * k
        a = (a[:-1] + k * a[-2::-1] if len(a) > 1 else a[:-1]) / (1 - k * k)
    return out


def stable(a: np.ndarray, least: float = 1e-4, rounds: int = 16) -> np.ndarray:
    """The predictor, its bandwidth widened until its inverse gain is at least ``least``."""
    a = np.asarray(a, float)
    for k in range(rounds):
        gain = prediction_gain(a)
        if gain is not None and gain >= least:
            return a
        a = a * (1 - 2.0 ** (k + 1 - rounds)) ** np.arange(1, len(a) + 1)
    return np.zeros(len(a))


def unmix_stereo(mid: np.ndarray, side: np.ndarray, old: tuple[float, float], new: tuple[float, float], fade: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right from mid and side with two predictors (of smoothed mid, and of mid), which move from
    ``old`` to ``new`` over ``fade`` samples. ``mid`` has one sample before and one behind ``side``."""
    n = len(side)
    step = np.minimum(np.arange(1, n + 1) / max(fade, 1), 1.0)
    w = [o + (v - o) * step for o, v in zip(old, new, strict=True)]
    smooth = (mid[:-2] + 2 * mid[1:-1] + mid[2:]) / 4
    now = mid[1:-1]
    side = side + w[0] * smooth + w[1] * now
    return np.clip(now + side, -1, 1), np.clip(now - side, -1, 1)


@dataclass
class Halves:
    """Splits a signal into a lower and an upper half band by two all-pass chains; state goes along."""

    state: list[float] = field(default_factory=lambda: [0.0, 0.0])
    #: All-pass coefficients.
    upper: float = 20623 / 65536
    lower: float = -24290 / 65536 + 1

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        even, odd = np.asarray(x[0::2], float), np.asarray(x[1::2], float)
        n = min(len(even), len(odd))
        a, b = np.empty(n), np.empty(n)
        s0, s1 = self.state
        for k in range(n):
            y = even[k] - s0
            v = y * self.lower
            a[k], s0 = s0 + v, even[k] + v
            y = odd[k] - s1
            v = y * self.upper
            b[k], s1 = s1 + v, odd[k] + v
        self.state = [s0, s1]
        return (a + b) / 2, (b - a) / 2


@dataclass
class VoiceActivity:
    """Speech level over noise in four bands (0-1-2-4-8 kHz of a 16 kHz signal), noise tracked per band."""

    halves: list[Halves] = field(default_factory=lambda: [Halves() for _ in range(3)])
    noise: np.ndarray = field(default_factory=lambda: np.full(4, 1e-4))
    frames: int = 0

    def frame(self, x: np.ndarray) -> dict:
        """Activity in [0, 1], spectral tilt in [-1, 1] and each band's SNR in dB of one frame."""
        parts, low = [], np.asarray(x, float)
        for h in self.halves:
            low, high = h.split(low)
            parts.append(high)
        energy = np.array([np.mean(p * p) if len(p) else 0.0 for p in [low, *parts[::-1]]]) + 1e-12
        rate = max(0.02, 1 / (self.frames + 2))
        pull = np.where(energy > 8 * self.noise, rate / 16, np.where(energy < self.noise, rate, rate / 4))
        self.noise = 1 / (1 / self.noise * (1 - pull) + pull / energy)
        self.frames += 1
        snr = 10 * np.log10(np.maximum(energy / self.noise, 1e-6))
        over = np.maximum(snr - 3, 0)
        tilt = float(np.array([3, 1, -1, -3]) @ over / (3 * over.sum())) if over.sum() > 0 else 0.0
        mean = float(np.sqrt(np.mean(over**2)))
        return {"activity": 1 / (1 + np.exp(-(mean - 6) / 2)), "tilt": tilt, "snr_db": snr.tolist()}


def concealed(past: np.ndarray, n: int, lost: int, lo: int = 32, hi: int = 288, seed: int = 1) -> np.ndarray:
    """``n`` samples in place of a lost frame: the last pitch period goes on, fading with each lost frame,
    and noise takes over as periodicity is weak. Silence after silence."""
    past = np.asarray(past, float)
    hi = min(hi, len(past) // 2)
    if hi <= lo or not past.any():
        return np.zeros(n)
    tail = past[-2 * hi :]
    lags = np.arange(lo, hi + 1)
    scores = [tail[hi:] @ tail[hi - k : 2 * hi - k] / np.sqrt(max(tail[hi:] @ tail[hi:], 1e-20) * max(tail[hi - k : 2 * hi - k] @ tail[hi - k : 2 * hi - k], 1e-20)) for k in lags]
    best = int(np.argmax(scores))
    voiced = float(np.clip(scores[best], 0, 1))
    period = past[-lags[best] :]
    harmonic = np.resize(period, n) * 0.9**lost
    noise = np.random.Generator(np.random.PCG64(seed + lost)).normal(0, 1, n) * np.sqrt(np.mean(period**2)) * 0.7**lost
    return voiced * harmonic + np.sqrt(1 - voiced**2) * noise
