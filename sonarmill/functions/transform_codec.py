"""Frames of the transform layer: state, decoder, encoder (RFC 6716, sections 4.3 and 5.3).

``FrameCodec`` holds what one direction of one stream carries from frame to
frame. Decoder and encoder go through ``_frame`` together: a reading wire
ignores the values it is handed, a writing wire sends them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from math import sqrt

import numpy as np

from sonarmill.functions import allocation as alloc
from sonarmill.functions import band_codec as bc
from sonarmill.functions.allocation import N_BANDS
from sonarmill.functions.entropy import Decoder, Encoder
from sonarmill.functions.transform import BAND_EDGES, EMPHASIS, OVERLAP, window

RATE = 48_000
#: Taps of the pitch filter by tapset, their code, bands by bandwidth.
TAPS = ((0.3066406250, 0.2170410156, 0.1296386719), (0.4638671875, 0.2680664062, 0.0), (0.7998046875, 0.1000976562, 0.0))
TAPSET = [2, 1, 0]
END_BAND = {"narrow": 13, "medium": 17, "wide": 17, "superwide": 19, "full": 21}
SHORT = 120
HISTORY = 2048
QUIET = -28.0
FULL_SCALE = 32768.0


def spectrum(x: np.ndarray, blocks: int) -> np.ndarray:
    """Coefficients of ``n + OVERLAP`` samples; of several short blocks, interleaved."""
    n = (len(x) - OVERLAP) // blocks
    return np.array([_forward(x[k * n : (k + 1) * n + OVERLAP]) for k in range(blocks)]).T.ravel()


@lru_cache(maxsize=16)
def _twiddles(n: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(2 * n)
    return np.exp(-0.5j * np.pi * t / n), np.exp(-1j * np.pi * (0.5 + n / 2) * (np.arange(n) + 0.5) / n)


def _forward(x: np.ndarray) -> np.ndarray:
    """The lapped transform by a Fourier transform of the faded block."""
    n = len(x) - OVERLAP
    flat = (n - OVERLAP) // 2
    block = np.zeros(2 * n)
    block[flat : flat + n + OVERLAP] = x
    block[flat : flat + OVERLAP] *= window(OVERLAP)
    block[flat + n : flat + n + OVERLAP] *= window(OVERLAP)[::-1]
    turn, shift = _twiddles(n)
    return (np.fft.fft(block * turn)[:n] * shift).real * (2 / n)


def samples(freq: np.ndarray, blocks: int) -> np.ndarray:
    """The inverse: n + OVERLAP samples, faded at both ends, to be added to their neighbours."""
    n = len(freq) // blocks
    flat = (n - OVERLAP) // 2
    turn, shift = _twiddles(n)
    out = np.zeros(len(freq) + OVERLAP)
    for k in range(blocks):
        wide = np.zeros(2 * n, complex)
        wide[:n] = freq[k::blocks] * np.conj(shift)
        y = (np.fft.ifft(wide) * 2 * n * np.conj(turn)).real[flat : flat + n + OVERLAP]
        y[:OVERLAP] *= window(OVERLAP)
        y[n:] *= window(OVERLAP)[::-1]
        out[k * n : k * n + n + OVERLAP] += y
    return out


@dataclass
class Pitch:
    period: int = 15
    gain: float = 0.0
    taps: int = 0


def pitch_filtered(past: np.ndarray, x: np.ndarray, old: Pitch, new: Pitch, sign: float = 1.0) -> np.ndarray:
    """Adds the signal a period before, cross-faded from ``old`` to ``new`` over OVERLAP samples.

    With sign 1 what is added is the output's own past (the decoder), with -1 the
    input's (the encoder), so one undoes the other.
    """
    if not old.gain and not new.gain:
        return x.copy()
    n, lead = len(x), len(past)
    source = np.concatenate([past, x])
    out = source.copy()
    feed = out if sign > 0 else source
    fade = np.ones(n)
    if old != new:
        fade[: min(n, OVERLAP)] = window(OVERLAP)[: min(n, OVERLAP)] ** 2

    def echo(p: Pitch, a: int, b: int) -> np.ndarray:
        t = max(p.period, 15)
        g = [p.gain * w for w in TAPS[p.taps]]
        at = lambda d: feed[lead + a - t + d : lead + b - t + d]
        return g[0] * at(0) + g[1] * (at(1) + at(-1)) + g[2] * (at(2) + at(-2))

    step = min(max(old.period, 15), max(new.period, 15)) - 2
    for a in range(0, n, step):  # no sample needs another one of its step
        b = min(n, a + step)
        out[lead + a : lead + b] += sign * ((1 - fade[a:b]) * echo(old, a, b) + fade[a:b] * echo(new, a, b))
    return out[lead:]


@dataclass
class Plan:
    """What the encoder wants of a frame."""

    transient: bool = False
    alone: bool = False
    pitch: Pitch = field(default_factory=Pitch)
    spread: int = 2
    changes: list[int] = field(default_factory=lambda: [0] * N_BANDS)
    select: int = 0
    boosts: list[int] = field(default_factory=lambda: [0] * N_BANDS)
    trim: int = 5
    intensity: int = N_BANDS
    dual: bool = False
    before: int = N_BANDS  # bands coded in the last frame

    def keep(self, band: int, bits: int, width: int) -> bool:
        """Whether a band at the top is worth its bits: at a depth that is lower for bands kept before."""
        depth = (7 if band < self.before else 9) if band > 16 else 0
        return band <= 1 or bits > (depth * width << self.lm << 3) >> 4

    lm: int = 0


@dataclass
class FrameCodec:
    """One direction of a stream of ``channels``."""

    channels: int = 1
    model: bc.CoarseModel = bc.plain_model
    log: np.ndarray = field(init=False)
    older: np.ndarray = field(init=False)
    oldest: np.ndarray = field(init=False)
    seed: int = 0
    final_range: int = 0
    pitch: Pitch = field(default_factory=Pitch)
    pitch_before: Pitch = field(default_factory=Pitch)
    coded_before: int = N_BANDS
    lost: int = 0
    every: int = 1  # of the output's samples one is kept: what it can't hold is left out

    def __post_init__(self) -> None:
        self.log = np.zeros((2, N_BANDS))
        self.older, self.oldest = (np.full((2, N_BANDS), QUIET) for _ in range(2))
        self.tail = np.zeros((self.channels, OVERLAP))
        self.past = np.zeros((self.channels, HISTORY))
        self.emphasis = np.zeros(self.channels)

    # What both directions share

    def _frame(self, wire: bc.Wire, coded_channels: int, lm: int, start: int, end: int, plan: Plan | None, target: np.ndarray | None, spectra: np.ndarray | None, amplitudes: np.ndarray | None, silent: bool) -> tuple[np.ndarray, bool, Pitch, bool]:
        """Codes a frame's symbols in order. Returns unit shapes, whether blocks are short, the pitch filter, silence."""
        c = coded_channels
        log = self.log[:c]
        if c == 1:
            log[0] = np.maximum(self.log[0], self.log[1])
        if wire.tell() == 1:
            silent = bool(wire.bit(silent, 15))
        else:
            silent = wire.tell() >= wire.bits
        if silent:
            wire.exhaust()
        pitch = self._pitch(wire, plan, start)
        transient = bool(wire.bit(plan and plan.transient, 3)) if lm and wire.room(3) else False
        blocks = 1 << lm if transient else 1
        alone = bool(wire.bit(plan and plan.alone, 3)) if wire.room(3) else False
        bc.coarse_energy(wire, log, target, start, end, alone, lm, self.model)
        changes = self._changes(wire, plan, start, end, transient, lm)
        spread = wire.table(plan.spread if plan else 0, bc.SPREADING, 5) if wire.room(4) else 2
        cap = alloc.caps(lm, c)
        boosts, total = self._boosts(wire, plan, cap, start, end, c, lm)
        trim = wire.table(plan.trim if plan else 0, bc.TILT, 7) if wire.eighths() + 48 <= total else 5
        bits = (wire.bits << 3) - wire.eighths() - 1
        reserve = 8 if transient and lm >= 2 and bits >= (lm + 2) << 3 else 0
        share = alloc.allocate(wire, start, end, boosts, cap, trim, bits - reserve, c, lm, plan)
        bc.fine_energy(wire, log, target, start, end, share.fine)
        coder = bc.Shapes(wire, spread, share.intensity, self.seed, amplitudes)
        shapes = coder.all_bands(spectra, start, end, share.shape, blocks, changes, (wire.bits << 3) - reserve, share.balance, lm, share.coded, share.dual, c)
        self.seed = coder.seed
        revived = bool(wire.raw(int(plan is not None), 1)) if reserve else False
        bc.last_energy(wire, log, target, start, end, share.fine, share.first)
        if revived:
            self.seed = bc.revive(shapes, coder.masks, lm, start, end, self.log if c == 1 else log, self.older, self.oldest, share.shape, self.seed)
        if silent:
            log[:] = QUIET
        self.coded_before = share.coded
        self.final_range = wire.coder.range
        return shapes, transient, pitch, silent

    @staticmethod
    def _pitch(wire: bc.Wire, plan: Plan | None, start: int) -> Pitch:
        if start or not wire.room(16) or not wire.bit(plan and plan.pitch.gain > 0, 1):
            return Pitch()
        octave = level = rest = taps = 0
        if plan:
            octave = (plan.pitch.period + 1).bit_length() - 5
            rest = plan.pitch.period + 1 - (16 << octave)
            level = round(plan.pitch.gain / 0.09375) - 1
            taps = plan.pitch.taps
        octave = wire.uniform(octave, 6)
        period = (16 << octave) + wire.raw(rest, 4 + octave) - 1
        gain = 0.09375 * (wire.raw(level, 3) + 1)
        return Pitch(period, gain, wire.table(taps, TAPSET, 2) if wire.room(2) else 0)

    @staticmethod
    def _changes(wire: bc.Wire, plan: Plan | None, start: int, end: int, transient: bool, lm: int) -> list[int]:
        """Time-frequency changes: flags that tell whether they differ from the band below, and which pair is meant."""
        odds = 2 if transient else 4
        reserve = int(lm > 0 and wire.room(odds + 1))
        budget, flag, flags = wire.bits - reserve, 0, [0] * N_BANDS
        for i in range(start, end):
            if wire.tell() + odds <= budget:
                flag ^= wire.bit(flag ^ plan.changes[i] if plan else 0, odds)
            flags[i] = flag
            odds = 4 if transient else 5
        row = bc.TIME_FREQUENCY[lm]
        at, any_set = 4 * transient, int(any(flags[start:end]))
        select = wire.bit(plan.select if plan else 0, 1) if reserve and row[at + any_set] != row[at + 2 + any_set] else 0
        return [row[at + 2 * select + f] for f in flags]

    @staticmethod
    def _boosts(wire: bc.Wire, plan: Plan | None, cap: list[int], start: int, end: int, channels: int, lm: int) -> tuple[list[int], int]:
        """Bands that get more than their share, in quanta; and the eighths of bits that are left."""
        total, first_odds, out = wire.bits << 3, 6, [0] * N_BANDS
        for i in range(start, end):
            width = channels * alloc.WIDTH[i] << lm
            quantum, odds, got = min(width << 3, max(48, width)), first_odds, 0
            while wire.eighths() + (odds << 3) < total and out[i] < cap[i]:
                if not wire.bit(plan and got < plan.boosts[i], odds):
                    break
                out[i] += quantum
                total -= quantum
                got += 1
                odds = 1
            if out[i]:
                first_odds = max(2, first_odds - 1)
        return out, total

    def _remember(self, coded_channels: int, start: int, end: int, transient: bool) -> None:
        if coded_channels == 1:
            self.log[1] = self.log[0]
        if transient:
            self.older = np.minimum(self.older, self.log)
        else:
            self.oldest, self.older = self.older, self.log.copy()
        for outside in (slice(0, start), slice(end, N_BANDS)):
            self.log[:, outside] = 0
            self.older[:, outside] = self.oldest[:, outside] = QUIET

    # Decoder

    def decode(self, data: bytes, lm: int, coded_channels: int | None = None, start: int = 0, end: int = N_BANDS, wire: bc.Reader | None = None) -> np.ndarray:
        """Samples (channels, 120 << lm) of a frame, 1 is full scale. Bytes past the end read as 0: no input is an error.

        ``wire`` goes on reading a frame whose first symbols belong to another layer.
        """
        c = coded_channels or self.channels
        wire = wire or bc.Reader(Decoder(data), len(data))
        shapes, transient, pitch, silent = self._frame(wire, c, lm, start, end, None, None, None, None, False)
        blocks = 1 << lm if transient else 1
        freq = np.zeros((c, 120 << lm))
        if not silent:
            for i in range(start, end):
                a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
                freq[:, a:z] = shapes[:, a:z] * np.exp2(np.minimum(32.0, self.log[:c, i] + bc.MEAN_ENERGY[i]))[:, None]
        if c < self.channels:
            freq = np.repeat(freq, self.channels, axis=0)
        elif c > self.channels:
            freq = freq.mean(axis=0, keepdims=True)
        out = self._synthesised(freq, blocks, pitch, lm)
        self._remember(c, start, end, transient)
        self.seed, self.lost = self.final_range, 0
        return out

    def _synthesised(self, freq: np.ndarray, blocks: int, pitch: Pitch, lm: int) -> np.ndarray:
        n, out = freq.shape[1], []
        if self.every > 1:
            freq[:, n // self.every :] = 0
        for c in range(self.channels):
            x = samples(freq[c], blocks)
            x[:OVERLAP] += self.tail[c]
            self.tail[c] = x[n:]
            first = pitch_filtered(self.past[c], x[:SHORT], self.pitch_before, self.pitch)
            past = np.concatenate([self.past[c], first])[-HISTORY:]
            rest = pitch_filtered(past, x[SHORT:n], self.pitch, pitch) if lm else np.zeros(0)
            y = np.concatenate([first, rest])
            self.past[c] = np.concatenate([self.past[c], y])[-HISTORY:]
            out.append(self._de_emphasised(y, c))
        self.pitch_before, self.pitch = (pitch if lm else self.pitch), pitch
        return np.array(out) / FULL_SCALE

    def _de_emphasised(self, x: np.ndarray, c: int) -> np.ndarray:
        """The recursion as a decaying convolution over pieces."""
        out = np.empty(len(x))
        for a in range(0, len(x), 240):
            part = x[a : a + 240]
            k = np.arange(len(part))
            y = np.tril(EMPHASIS ** np.maximum(k[:, None] - k, 0)) @ part + self.emphasis[c] * EMPHASIS ** (k + 1)
            out[a : a + 240], self.emphasis[c] = y, y[-1]
        return out

    def conceal(self, lm: int, start: int = 0, end: int = N_BANDS) -> np.ndarray:
        """A lost frame: the last period again while it is fresh, then noise in the shape of the last bands, ever softer."""
        n = 120 << lm
        if self.lost >= 5 or start:
            fall = 1.5 if not self.lost else 0.5
            self.log[:, start:end] -= fall
            freq = np.zeros((self.channels, n))
            for i in range(start, end):
                a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
                for c in range(self.channels):
                    noise = np.empty(z - a)
                    for j in range(z - a):
                        self.seed = alloc.noise_step(self.seed)
                        noise[j] = (self.seed ^ 1 << 31) - (1 << 31) >> 20
                    freq[c, a:z] = bc.unit(noise) * 2 ** min(32.0, self.log[c, i] + bc.MEAN_ENERGY[i])
            out = self._synthesised(freq, 1, self.pitch, lm)
        else:
            fade = 1.0 if not self.lost else 0.8
            if not self.lost:
                self.found = best_period(self.past.mean(axis=0))
            out, rise = np.empty((self.channels, n)), window(OVERLAP)
            for c in range(self.channels):
                last = self.past[c, -self.found :] * fade
                run = np.resize(last, n + OVERLAP)
                y = run[:n].copy()
                # The tail is faded once already; faded again it makes room for the run's square.
                y[:OVERLAP] = y[:OVERLAP] * rise**2 + self.tail[c] * rise[::-1]
                self.tail[c] = run[n:] * rise[::-1]
                self.past[c] = np.concatenate([self.past[c], y])[-HISTORY:]
                out[c] = self._de_emphasised(y, c) / FULL_SCALE
        self.lost += 1
        return out

    # Encoder

    def encode(self, pcm: np.ndarray, size: int, lm: int, start: int = 0, end: int = N_BANDS, wire: bc.Writer | None = None) -> bytes:
        """A frame (channels, 120 << lm) in ``size`` bytes. The stream lags by OVERLAP samples."""
        n = 120 << lm
        writing = wire or bc.Writer(Encoder(size), size)
        x = np.empty((self.channels, n + OVERLAP))
        raw = np.asarray(pcm, float).reshape(self.channels, n) * FULL_SCALE
        silent = not raw.any()
        emphasised = np.empty((self.channels, n))
        for c in range(self.channels):
            emphasised[c] = raw[c] - EMPHASIS * np.concatenate([[self.emphasis[c]], raw[c, :-1]])
            self.emphasis[c] = raw[c, -1]
        plan = Plan(lm=lm, before=self.coded_before, alone=not self.final_range)
        plan.pitch = self._best_pitch(emphasised, size) if lm and not start else Pitch()
        for c in range(self.channels):
            first = pitch_filtered(self.past[c], emphasised[c, :SHORT], self.pitch_before, self.pitch, -1.0)
            past = np.concatenate([self.past[c], emphasised[c, :SHORT]])[-HISTORY:]
            rest = pitch_filtered(past, emphasised[c, SHORT:], self.pitch, plan.pitch, -1.0) if lm else np.zeros(0)
            x[c] = np.concatenate([self.tail[c], first, rest])
            self.tail[c] = x[c, n:]
            self.past[c] = np.concatenate([self.past[c], emphasised[c]])[-HISTORY:]
        self.pitch_before, self.pitch = (plan.pitch if lm else self.pitch), plan.pitch
        plan.transient, strength = transient(x) if lm and size > 15 else (False, 0.0)
        blocks = 1 << lm if plan.transient else 1
        freq = np.array([spectrum(v, blocks) for v in x])
        amplitudes = np.zeros((self.channels, N_BANDS))
        shapes = np.zeros_like(freq)
        for i in range(start, end):
            a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
            amplitudes[:, i] = np.sqrt(1e-27 + (freq[:, a:z] ** 2).sum(axis=1))
            shapes[:, a:z] = freq[:, a:z] / amplitudes[:, i, None]
        target = np.log2(np.maximum(amplitudes, 1e-14)) - np.array(bc.MEAN_ENERGY)
        if not plan.alone:
            plan.alone = bool((np.abs(target[:, start:end] - self.log[: self.channels, start:end]).mean() > 3.0) and plan.transient)
        plan.changes, plan.select = best_changes(shapes, lm, plan.transient, start, end)
        plan.spread = spreading(shapes, lm, end)
        plan.boosts = boosts(target, start, end, lm, size)
        plan.trim = tilt(target, end, strength)
        if self.channels == 2:
            plan.dual = is_dual(shapes, lm)
            plan.intensity = min(end, intensity_from(size, lm))
        self._frame(writing, self.channels, lm, start, end, plan, target, shapes, amplitudes, silent)
        self._remember(self.channels, start, end, plan.transient)
        self.seed = self.final_range
        return writing.coder.finish() if wire is None else b""

    def _best_pitch(self, x: np.ndarray, size: int) -> Pitch:
        """The pre-filter: on from a correlation of 0.2 (more for short packets and new periods), its gain in eight steps."""
        joined = np.concatenate([self.past, x], axis=1).mean(axis=0)
        n = x.shape[1]
        period, gain = period_of(joined, n, self.pitch.period if self.pitch.gain else 0)
        need = 0.2 + 0.1 * (size < 25 * self.channels) + 0.1 * (size < 35 * self.channels) + 0.2 * (self.pitch.gain > 0 and abs(period - self.pitch.period) * 10 > period)
        need = max(0.2, need - 0.1 * (self.pitch.gain > 0.4) - 0.1 * (self.pitch.gain > 0.55))
        if size <= 12 * self.channels or gain < need:
            return Pitch()
        if abs(gain - self.pitch.gain) < 0.1:
            gain = self.pitch.gain
        level = min(7, max(0, int(0.5 + gain * 32 / 3) - 1))
        return Pitch(min(period, 1022), 0.09375 * (level + 1), 0)


# What the encoder looks at


def period_of(x: np.ndarray, n: int, before: int, least: int = 15, most: int = 1022) -> tuple[int, float]:
    """(period, gain) of the last n samples against what precedes them; sub-multiples and the last period are preferred if nearly as good."""
    now, power = x[-n:], float(x[-n:] @ x[-n:])
    if power <= 0:
        return least, 0.0
    lags = np.arange(least, min(most, len(x) - n) + 1)
    size = 1 << (len(x) + n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(now, size)), size)[len(x) - n - lags]
    energy = np.concatenate([[0.0], np.cumsum(x * x)])
    old = energy[len(x) - lags] - energy[len(x) - n - lags]
    score = np.where(cross > 0, cross**2 / (1 + old), 0.0)
    best = int(score.argmax())
    for k in range(2, 9):
        at = round(lags[best] / k) - least
        if 0 <= at < len(lags) and score[at] > 0.85 * score[best]:
            best = at
            break
    if before and 0 <= before - least < len(lags) and score[before - least] > 0.9 * score[best]:
        best = before - least
    return int(lags[best]), float(max(0.0, min(1.0, cross[best] / sqrt(1 + power * old[best])))) if cross[best] > 0 else 0.0


def best_period(past: np.ndarray) -> int:
    """The period of a stream's recent past, for concealment."""
    return period_of(past, 720, 0, 100, 720)[0]


def transient(x: np.ndarray) -> tuple[bool, float]:
    """Whether a frame's energy jumps, by masking forward and backward in time; and how strongly, from 0 to 1."""
    worst = 0.0
    for v in x:
        high = np.diff(v, prepend=0.0) - 0.5 * np.diff(np.concatenate([[0.0], v[:-1]]), prepend=0.0)
        power = (high[: len(high) // 2 * 2].reshape(-1, 2) ** 2).sum(axis=1)
        ahead = np.empty(len(power))
        level = 0.0
        for k, p in enumerate(power):
            level += 0.0625 * (p - level)
            ahead[k] = level
        mean, level, top = float(ahead.sum()), 0.0, 0.0
        for k in range(len(power) - 1, -1, -1):
            level += 0.125 * (ahead[k] - level)
            ahead[k] = level
            top = max(top, level)
        norm = len(power) / (1e-15 + sqrt(mean * top * 0.5 * len(power)))
        steps = np.clip(np.floor(64 * norm * (ahead[12:-5:4] + 1e-15)), 0, 127)
        worst = max(worst, float((128 / (1 + steps)).sum() * 4 * 4 / max(1, 6 * (len(power) - 17))))
    return worst > 12.5, min(1.0, max(0.0, sqrt(max(0.0, 0.0069 * min(163.0, 16 * worst)) - 0.139) if worst > 1.3 else 0.0))


def best_changes(shapes: np.ndarray, lm: int, is_transient: bool, start: int, end: int) -> tuple[list[int], int]:
    """For each band the flag whose time-frequency change makes the shape sparsest (sum of absolute values), smoothed by the cost of a change."""
    if not lm:
        return [0] * N_BANDS, 0
    best = None
    for select in (0, 1):
        row = bc.TIME_FREQUENCY[lm][4 * is_transient + 2 * select : 4 * is_transient + 2 * select + 2]
        cost = np.zeros((N_BANDS, 2))
        for i in range(start, end):
            a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
            for flag in (0, 1):
                cost[i, flag] = sum(_spread_after(v[a:z], row[flag], 1 << lm if is_transient else 1) for v in shapes) / sqrt(z - a)
        paths, total = [], cost[start].copy() + [0, 0.1]
        for i in range(start + 1, end):
            came = np.array([total[f] <= total[1 - f] + 0.1 for f in (0, 1)])
            paths.append([f if came[f] else 1 - f for f in (0, 1)])
            total = np.array([min(total[f], total[1 - f] + 0.1) for f in (0, 1)]) + cost[i]
        flags, flag = [0] * N_BANDS, int(total.argmin())
        for i in range(end - 1, start - 1, -1):
            flags[i] = flag
            if i > start:
                flag = paths[i - start - 1][flag]
        if best is None or total.min() < best[0] - 1e-9:
            best = (float(total.min()), flags, select)
    return best[1], best[2]


def _spread_after(x: np.ndarray, change: int, blocks: int) -> float:
    if len(x) == 1:
        return 0.0
    size = len(x) // blocks
    if change > 0:
        for k in range(change):
            x = bc.haar(x, 1 << k)
    else:
        while change < 0 and not size & 1:
            x = bc.haar(x, blocks)
            blocks, size, change = blocks << 1, size >> 1, change + 1
    return float(np.abs(x).sum())


def spreading(shapes: np.ndarray, lm: int, end: int) -> int:
    """How peaky bands are: much spreading for noise, none for tones."""
    votes = n_bands = 0
    for v in shapes:
        for i in range(end):
            a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
            n = z - a
            if n > 8:
                power = v[a:z] ** 2 * n
                votes += sum(2 * int((power < t).sum()) >= n for t in (0.25, 0.0625, 0.015625))
                n_bands += 1
    level = 256 * votes / n_bands if n_bands else 256
    return 3 if level < 80 else 2 if level < 256 else 1 if level < 384 else 0


def boosts(target: np.ndarray, start: int, end: int, lm: int, size: int) -> list[int]:
    """Quanta for bands that stand out of their neighbourhood (median of five, followers up and down)."""
    out = [0] * N_BANDS
    if size < 30 + 5 * lm or end - start < 5:
        return out
    over = np.zeros(N_BANDS)
    for v in target:
        part = v[start:end]
        padded = np.concatenate([part[:2][::-1], part, part[-2:][::-1]])
        floor = np.median(np.lib.stride_tricks.sliding_window_view(padded, 5), axis=1)
        up, down = floor.copy(), floor.copy()
        for k in range(1, len(part)):
            up[k] = min(up[k - 1] + 1.5, up[k])
        for k in range(len(part) - 2, -1, -1):
            down[k] = min(down[k + 1] + 2.0, down[k])
        over[start:end] = np.maximum(over[start:end], part - np.maximum(floor - 1, np.minimum(up, down)))
    quanta = np.clip(np.floor(over - 1.0), 0, 4).astype(int)
    left = size // 12
    for i in np.argsort(-quanta, kind="stable"):
        out[i] = min(int(quanta[i]), left)
        left -= out[i]
    return out


def tilt(target: np.ndarray, end: int, strength: float) -> int:
    """Allocation tilt from the slope of the bands' energies."""
    weight = 2 + 2 * np.arange(end) - end
    slope = float((target[:, :end] * weight).sum() / len(target) / max(1, end - 1))
    return int(np.clip(np.floor(0.5 + 5 - np.clip((slope + 1) / 6, -2, 2) - 2 * strength), 0, 10))


def is_dual(shapes: np.ndarray, lm: int) -> bool:
    """Whether left and right are told apart better than mid and side, by the sums of absolute values of the lower bands."""
    n = BAND_EDGES[13] << lm
    left, right = shapes[0, :n], shapes[1, :n]
    apart = np.abs(left).sum() + np.abs(right).sum()
    together = (np.abs(left + right).sum() + np.abs(left - right).sum()) * sqrt(0.5)
    extra = 5 if lm < 2 else 13
    return bool((n + extra) * together > n * apart)


def intensity_from(size: int, lm: int) -> int:
    """The band from which only one shape is sent, by the bit rate in kb/s."""
    rate = size * 8 * 50 * (8 >> lm) / 8 / 1000
    edges = (1, 2, 3, 4, 5, 6, 7, 8, 16, 24, 36, 44, 50, 56, 62, 67, 72, 79, 88, 106, 134)  # fixed values of the public encoder
    return sum(rate >= e for e in edges)


def demand(x: np.ndarray) -> float:
    """How many bytes a frame (channels, samples) wants, of what an average one gets: few for silence and for
    narrow bands, more for attacks."""
    power = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1)) ** 2 / x.shape[1]
    edges = np.minimum(np.array(BAND_EDGES) * x.shape[1] // (2 * BAND_EDGES[-1]), power.shape[1])
    bands = np.array([power[:, a : max(b, a + 1)].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    loud = float((bands > 1e-7).mean())
    parts = (x[:, : x.shape[1] // 8 * 8].reshape(len(x), 8, -1) ** 2).mean(axis=2) + 1e-9
    attack = float(np.log2(parts.max(axis=1) / parts.mean(axis=1)).max()) / 3
    return 0.1 if not loud else 0.45 + 0.6 * loud + 0.5 * min(1.0, attack)


def held(value: float, edges: list[float], margins: list[float], before: int) -> int:
    """How many edges the value has passed; it must pass one by its margin to leave the choice before."""
    k = sum(value >= e for e in edges)
    if k > before and value < edges[before] + margins[before]:
        return before
    if k < before and value > edges[before - 1] - margins[before - 1]:
        return before
    return k
