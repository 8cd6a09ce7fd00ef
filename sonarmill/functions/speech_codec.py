"""Frames of the speech layer: side information, pulses, synthesis, stereo, and an encoder (RFC 6716, sections 4.2 and 5.2).

As in the transform layer one code path reads and writes (``band_codec.Wire``), and one
routine synthesises: the decoder hands it the pulses, the encoder lets it choose
them sample by sample. Symbols are exact; samples are computed in floating point,
so they differ from an integer implementation by rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass, field
from math import log2, pi, sqrt

import numpy as np

from sonarmill.functions import speech_tables as st
from sonarmill.functions.band_codec import Reader, Wire, Writer
from sonarmill.functions.entropy import Encoder
from sonarmill.functions.lpc import autocorrelation, levinson
from sonarmill.functions.speech import from_line_spectra, gain_of, line_spectra, next_random, stable, unmix_stereo

INACTIVE, UNVOICED, VOICED = 0, 1, 2
BLOCK = 16
MOST = 16  # pulses of a block before its low bits are sent apart
SHAPE = 0.94  # how far the encoder's noise follows the spectrum


@dataclass
class Side:
    """Side information of a frame, as coded."""

    kind: int = INACTIVE
    offset: int = 0
    gains: list[int] = field(default_factory=list)
    vector: int = 0
    residual: list[int] = field(default_factory=list)
    interpolation: int = 4
    lag: int = 0
    contour: int = 0
    periodicity: int = 0
    filters: list[int] = field(default_factory=list)
    scale: int = 0
    seed: int = 0


def code_side(wire: Wire, want: Side | None, khz: int, parts: int, active: bool, follows: bool, before: Side | None, tables: st.SpeechTables, scaled: bool = True) -> Side:
    """Side information in order. ``follows``: gains and lag may refer to the frame ``before``; ``scaled``: the
    long-term scale is coded where they don't."""
    w, out = want or Side(gains=[0] * parts, residual=[0] * 16, filters=[0] * parts), Side()
    kind = wire.table(2 * w.kind + w.offset - 2 * active, st.TYPE_ACTIVE if active else st.TYPE_INACTIVE, 8) + 2 * active
    out.kind, out.offset = kind >> 1, kind & 1
    if follows:
        out.gains = [wire.table(w.gains[0], st.GAIN_DELTA, 8)]
    else:
        out.gains = [wire.table(w.gains[0] >> 3, st.GAIN_HIGH[out.kind], 8) << 3]
        out.gains[0] += wire.table(w.gains[0] & 7, st.UNIFORM[8], 8)
    out.gains += [wire.table(w.gains[k], st.GAIN_DELTA, 8) for k in range(1, parts)]
    book = tables.spectra[16 if khz == 16 else 10]
    out.vector = wire.table(w.vector, book.choice[out.kind >> 1], 8)
    for i in range(book.order):
        table = book.residual[book.table[out.vector][i]]
        r = wire.table(max(0, min(8, w.residual[i] + 4)), table, 8) - 4
        if abs(r) == 4:
            r += (1 if r > 0 else -1) * wire.table(max(0, abs(w.residual[i]) - 4), st.SPECTRUM_MORE, 8)
        out.residual.append(r)
    out.interpolation = wire.table(w.interpolation, st.INTERPOLATION, 8) if parts == 4 else 4
    if out.kind == VOICED:
        absolute = True
        if follows and before is not None and before.kind == VOICED:
            step = w.lag - before.lag + 9
            step = wire.table(step if 0 < step < 21 else 0, st.LAG_DELTA, 8)
            if step > 0:
                out.lag, absolute = before.lag + step - 9, False
        if absolute:
            half = khz >> 1
            out.lag = wire.table(w.lag // half, st.LAG_HIGH, 8) * half
            out.lag += wire.table(w.lag % half, st.UNIFORM[half], 8)
        out.contour = wire.table(w.contour, st.CONTOUR[khz == 8, parts], 8)
        out.periodicity = wire.table(w.periodicity, st.PERIODICITY, 8)
        out.filters = [wire.table(w.filters[k], st.LONG_TERM[out.periodicity], 8) for k in range(parts)]
        out.scale = 0 if follows or not scaled else wire.table(w.scale, st.LONG_TERM_SCALE, 8)
    out.seed = wire.table(w.seed, st.UNIFORM[4], 8)
    return out


# Pulses


def _split(wire: Wire, level: int, sizes: list[int], total: int, at: int, tables: st.SpeechTables, out: list[int]) -> None:
    """A block's pulses halve by halve; a half without pulses costs nothing."""
    width = 2 << level
    if total == 0:
        out[at : at + width] = [0] * width
        return
    half = width >> 1
    first = wire.table(sum(sizes[at : at + half]), tables.shells[level][total], 8)
    for k, part in enumerate((first, total - first)):
        if level:
            _split(wire, level - 1, sizes, part, at + k * half, tables, out)
        else:
            out[at + k] = part


def _table_cost(table: list[int], value: int) -> float:
    return -log2(((table[value - 1] if value else 256) - table[value]) / 256)


def code_pulses(wire: Wire, want: np.ndarray | None, kind: int, offset: int, length: int, tables: st.SpeechTables) -> np.ndarray:
    blocks = -(-length // BLOCK)
    sizes, shifts, sums = [0] * (blocks * BLOCK), [0] * blocks, [0] * blocks
    signs = np.zeros(blocks * BLOCK, int)
    whole = list(sizes)
    if want is not None:
        signs[:length] = np.sign(want)
        whole[:length] = np.abs(want).astype(int).tolist()
        for b in range(blocks):
            part = whole[b * BLOCK : (b + 1) * BLOCK]
            while sum(part) > MOST:
                part = [x >> 1 for x in part]
                shifts[b] += 1
            sizes[b * BLOCK : (b + 1) * BLOCK], sums[b] = part, sum(part)
    levels = st.RATE_LEVELS[kind >> 1]
    level = 0
    if want is not None:
        level = min(range(9), key=lambda k: _table_cost(levels, k) + sum(_table_cost(st.BLOCK_PULSES[k], 17 if h else s) for s, h in zip(sums, shifts, strict=True)))
    level = wire.table(level, levels, 8)
    for b in range(blocks):
        left, got, n = shifts[b], 17, 0
        while got == 17:
            table = st.BLOCK_PULSES[level] if not n else st.BLOCK_PULSES[9]
            # After ten low bits no more are possible.
            skip = int(n == 10)
            got = wire.table((17 if n < left else sums[b]) - skip, table[skip:], 8) + skip
            n += got == 17
        sums[b], shifts[b] = got, n
    out = [0] * (blocks * BLOCK)
    for b in range(blocks):
        part = [0] * BLOCK
        _split(wire, 3, sizes[b * BLOCK : (b + 1) * BLOCK], sums[b], 0, tables, part)
        out[b * BLOCK : (b + 1) * BLOCK] = part
    for b in range(blocks):
        for k in range(b * BLOCK, (b + 1) * BLOCK) if shifts[b] else ():
            for s in range(shifts[b] - 1, -1, -1):
                out[k] = out[k] << 1 | wire.table(whole[k] >> s & 1, st.LOW_BIT, 8)
    base = 7 * (offset + 2 * kind)
    for b in range(blocks):
        if sums[b] or shifts[b]:
            table = [st.SIGNS[base + min(sums[b], 6)], 0]
            for k in range(b * BLOCK, (b + 1) * BLOCK):
                if out[k] and not wire.table(int(signs[k] > 0), table, 8):
                    out[k] = -out[k]
    return np.array(out[:length])


# Spectra


def spectrum_of(vector: int, residual: list[int], book: st.Spectra) -> np.ndarray:
    """Line spectra in 1/32768 of the band."""
    first, above, out = book.vectors[vector], 0, [0] * book.order
    weights = spectrum_weights(first)
    for k in range(book.order - 1, -1, -1):
        r = residual[k]
        back = (above * book.weight[vector][k] >> 8) if k + 1 < book.order else 0
        above = back + (((r << 10) - (102 if r > 0 else -102 if r < 0 else 0)) * st.QUANTISER_STEP[book.order] >> 16)
        out[k] = min(32767, max(0, (first[k] << 7) + int((above << 14) / weights[k])))
    return _apart(np.array(out), book.order)


def spectrum_weights(first: list[int]) -> list[int]:
    """Weights of the residual, in 1/512: roots of the sums of inverse distances, roughly."""
    edges, out = [0, *first, 256], []
    for k in range(1, len(edges) - 1):
        square = (1024 // (edges[k] - edges[k - 1]) + 1024 // (edges[k + 1] - edges[k])) << 16
        length = square.bit_length()
        part = square >> (length - 8) & 127
        y = (32768 if length & 1 else 46214) >> ((32 - length) >> 1)
        out.append(y + (213 * part * y >> 16))
    return out


def _apart(w: np.ndarray, order: int) -> np.ndarray:
    """Line spectra at their least distances: the worst pair is moved apart round its centre, twenty times at most."""
    least = st.SPACING[order]
    w = w.astype(int).copy()
    for _ in range(20):
        edges = np.concatenate([[0], w, [32768]])
        lack = np.diff(edges) - least
        k = int(np.argmin(lack))
        if lack[k] >= 0:
            return w
        if k == 0:
            w[0] = least[0]
        elif k == order:
            w[-1] = 32768 - least[order]
        else:
            low = sum(least[:k]) + (least[k] >> 1)
            high = 32768 - sum(least[k + 1 :]) - (least[k] >> 1)
            centre = min(max(low, int(w[k - 1] + w[k] + 1) >> 1), high)
            w[k - 1] = centre - (least[k] >> 1)
            w[k] = w[k - 1] + least[k]
    w.sort()
    w[0] = max(w[0], least[0])
    for k in range(1, order):
        w[k] = max(w[k], w[k - 1] + least[k])
    w[-1] = min(w[-1], 32768 - least[order])
    for k in range(order - 2, -1, -1):
        w[k] = min(w[k], w[k + 1] - least[k + 1])
    return w


def quantised_spectrum(w: np.ndarray, book: st.Spectra) -> tuple[int, list[int]]:
    """First vector and residual whose spectrum is nearest, weighted by closeness of lines."""
    edges = np.concatenate([[0], w, [32768]])
    weight = 1 / np.maximum(1, np.diff(edges)[:-1]) + 1 / np.maximum(1, np.diff(edges)[1:])
    order = np.argsort([(weight * (w - np.array(v) * 128) ** 2).sum() for v in book.vectors])[:4]
    best = None
    for vector in order.tolist():
        weights, above, residual = spectrum_weights(book.vectors[vector]), 0, [0] * book.order
        for k in range(book.order - 1, -1, -1):
            back = (above * book.weight[vector][k] >> 8) if k + 1 < book.order else 0
            want = (w[k] - book.vectors[vector][k] * 128) * weights[k] / 16384

            def value(r: int, back: int = back) -> int:
                return back + (((r << 10) - (102 if r > 0 else -102 if r < 0 else 0)) * st.QUANTISER_STEP[book.order] >> 16)

            near = round((want - back) * 64 / st.QUANTISER_STEP[book.order])
            r = min((max(-10, min(10, near + d)) for d in (-1, 0, 1)), key=lambda r: abs(value(r) - want))  # noqa: B023
            residual[k], above = r, value(r)
        error = float((weight * (spectrum_of(vector, residual, book) - w) ** 2).sum())
        if best is None or error < best[0]:
            best = (error, vector, residual)
    return best[1], best[2]


def predictor_of(w: np.ndarray) -> np.ndarray:
    return stable(from_line_spectra(np.asarray(w, float) * pi / 32768))


# A channel


@dataclass
class SpeechChannel:
    """One channel's state, for either direction. Samples are on the scale of 16-bit numbers."""

    khz: int = 16
    tables: st.SpeechTables = field(default_factory=st.SpeechTables)

    def __post_init__(self) -> None:
        if self.khz not in (8, 12, 16):
            raise ValueError("the speech layer runs at 8, 12 or 16 kHz")
        self.order = 16 if self.khz == 16 else 10
        self.out = np.zeros(20 * self.khz + 2 * self.khz + 18)  # what was put out, before clamping
        self.spectrum: np.ndarray | None = None
        self.level: int | None = None
        self.before: Side | None = None
        self.lost = 0
        self.last_lag = 0

    def synthesis(self, side: Side, pulses: np.ndarray | None, parts: int, chooser: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Samples and pulses of a frame: given pulses, or those that ``chooser`` picks from (place, expected sample, gain, offset, flip, predictor)."""
        n = 5 * self.khz
        book = self.tables.spectra[self.order]
        w = spectrum_of(side.vector, side.residual, book)
        a = predictor_of(w)
        halves = [a, a]
        if side.interpolation < 4 and self.spectrum is not None and parts == 4:
            halves[0] = predictor_of(self.spectrum + (side.interpolation * (w - self.spectrum) >> 2))
        self.spectrum = w
        levels = levels_of(side.gains, self.level, self.follows)
        self.level = levels[-1]
        gains = [gain_of(v) / 65536 for v in levels]
        offset = st.OFFSETS[side.kind >> 1][side.offset] / 1024
        lags, filters = [0] * parts, [None] * parts
        if side.kind == VOICED:
            lags = lags_of(side.lag, side.contour, self.khz, parts)
            filters = [np.array(st.FILTERS[side.periodicity][f]) / 128 for f in side.filters]
        history = len(self.out)
        x = np.concatenate([self.out, np.zeros(parts * n)])
        res = np.zeros(len(x))
        seed = side.seed
        made = np.zeros(parts * n, int)
        for s in range(parts):
            a, start = halves[int(s >= 2)] if parts == 4 else halves[1], history + s * n
            back = a[::-1]
            if filters[s] is not None:
                # The past as this subframe's filter sees it: what lies before the frame (or its second half) is scaled down.
                cut = history + (2 * n if side.interpolation < 4 and s >= 2 else 0)
                scale = 1.0 if side.interpolation < 4 and s >= 2 else st.FILTER_SCALE[side.scale] / 16384
                low = max(self.order, start - lags[s] - 3)
                windows = np.lib.stride_tricks.sliding_window_view(x, self.order)[low - self.order : start - self.order]
                seen = np.where(np.arange(low, start) < cut, np.clip(x[low:start], -32768, 32767), x[low:start])
                res[low:start] = (seen - windows @ back) / gains[s]
                res[low : max(low, cut)] *= scale
            for i in range(start, start + n):
                guess = float(back @ x[i - self.order : i])
                long = float(filters[s] @ res[i - lags[s] + 2 : i - lags[s] - 3 : -1]) if filters[s] is not None else 0.0
                seed = next_random(seed)
                flip = seed & 0x80000000
                k = i - history
                pulse = int(pulses[k]) if pulses is not None else chooser(k, guess + gains[s] * long, gains[s], offset, flip, back)
                e = pulse - (0.078125 if pulse > 0 else -0.078125 if pulse < 0 else 0.0) + offset
                seed = (seed + pulse) & 0xFFFFFFFF
                res[i] = (-e if flip else e) + long
                x[i] = guess + gains[s] * res[i]
                made[k] = pulse
        np.clip(x, -(1 << 20), 1 << 20, out=x)
        self.out = x[-history:]
        self.before, self.lost, self.last_lag = side, 0, lags[-1]
        return np.clip(x[history:], -32768, 32767), made

    follows = False

    def decode(self, wire: Reader, parts: int, active: bool, follows: bool, scaled: bool = True) -> np.ndarray:
        self.follows = follows
        side = code_side(wire, None, self.khz, parts, active, follows, self.before, self.tables, scaled)
        pulses = code_pulses(wire, None, side.kind, side.offset, parts * 5 * self.khz, self.tables)
        return self.synthesis(side, pulses, parts)[0]

    def skip(self, wire: Reader, parts: int, follows: bool, before: Side | None) -> Side:
        """Reads a recovery frame without using it."""
        side = code_side(wire, None, self.khz, parts, True, follows, before, self.tables)
        code_pulses(wire, None, side.kind, side.offset, parts * 5 * self.khz, self.tables)
        return side

    def conceal(self, parts: int) -> np.ndarray:
        """A lost frame: the last period (or noise) through the last filter, softer with every frame."""
        n, history = parts * 5 * self.khz, len(self.out)
        a = predictor_of(self.spectrum) * 0.99 ** np.arange(1, self.order + 1) if self.spectrum is not None else np.zeros(self.order)
        x = np.concatenate([self.out, np.zeros(n)])
        back, fade = a[::-1], 0.9 ** (self.lost + 1)
        windows = np.lib.stride_tricks.sliding_window_view(x, self.order)[: history - self.order]
        res = np.concatenate([np.zeros(self.order), x[self.order : history] - windows @ back, np.zeros(n)])
        lag = self.last_lag or 4 * self.khz
        voiced = self.before is not None and self.before.kind == VOICED
        noise = np.random.Generator(np.random.PCG64(self.lost)).normal(0, 1, n) * (res[history - 10 * self.khz : history].std() if history else 0)
        for k, i in enumerate(range(history, history + n)):
            res[i] = fade * (res[i - lag] if voiced else 0.7 * noise[k])
            x[i] = back @ x[i - self.order : i] + res[i]
        self.out = np.clip(x[-history:], -32768, 32767)
        self.lost += 1
        self.level = None if self.lost > 3 else self.level
        return np.clip(x[history:], -32768, 32767)

    # Encoder

    def analysed(self, x: np.ndarray, parts: int, quality: float) -> tuple[Side, np.ndarray]:
        """Side information that suits a frame of samples (with gains as absolute levels), and the samples."""
        n, side = 5 * self.khz, Side()
        past = np.concatenate([self.clean, x])
        self.clean = past[-len(self.clean) :]
        span = past[-(parts * n + 10 * self.khz) :]
        energy = float(x @ x) / len(x)
        faded = span * np.sin(pi * (np.arange(len(span)) + 0.5) / len(span))
        r = autocorrelation(faded, self.order)
        r[0] = r[0] * 1.0005 + 1.0
        a = levinson(r, self.order)
        a = np.zeros(self.order) if a is None else a * 0.995 ** np.arange(1, self.order + 1)
        spectra = line_spectra(a) * 32768 / pi
        book = self.tables.spectra[self.order]
        w = spectra if len(spectra) == self.order else np.arange(1, self.order + 1) * 32768 / (self.order + 1)
        side.vector, side.residual = quantised_spectrum(_apart(np.round(w), self.order), book)
        a = predictor_of(spectrum_of(side.vector, side.residual, book))
        windows = np.lib.stride_tricks.sliding_window_view(past, self.order)
        res = np.concatenate([np.zeros(self.order), past[self.order :] - windows[:-1] @ a[::-1]])
        frame = len(past) - parts * n
        lags = np.arange(2 * self.khz, 18 * self.khz + 1)
        now, power = res[frame:], float(res[frame:] @ res[frame:])
        score = np.array([float(now @ res[frame - k : len(res) - k]) / sqrt(1 + power * float(res[frame - k : len(res) - k] @ res[frame - k : len(res) - k])) for k in lags.tolist()])
        best = int(score.argmax())
        side.kind = INACTIVE if energy < 30 else VOICED if score[best] > 0.35 else UNVOICED
        levels = []
        if side.kind == VOICED:
            side.lag, side.periodicity, side.scale = int(lags[best]) - 2 * self.khz, 2, 0
            tracks = [lags_of(side.lag, c, self.khz, parts) for c in range(len(st.CONTOUR[self.khz == 8, parts]))]
            fit = [sum(float(res[frame + s * n : frame + (s + 1) * n] @ res[frame + s * n - t[s] : frame + (s + 1) * n - t[s]]) for s in range(parts)) for t in tracks]
            side.contour = int(np.argmax(fit))
            lag = tracks[side.contour]
        for s in range(parts):
            part = res[frame + s * n : frame + (s + 1) * n]
            if side.kind == VOICED:
                at = frame + s * n - lag[s]
                shifted = np.array([res[at + 2 - k : at + 2 - k + n] for k in range(5)])
                left = [part - (np.array(f) / 128) @ shifted for f in st.FILTERS[2]]
                side.filters.append(int(np.argmin([float(v @ v) for v in left])))
                part = left[side.filters[-1]]
            level = sqrt(float(part @ part) / n + 1e-3) * quality
            levels.append(max(0, min(63, round((128 * log2(max(level * 65536, 1)) - 2090) * 65536 / 0x1D1C71))))
        side.gains, side.seed = levels, int(energy) & 3
        side.offset = int(side.kind == UNVOICED)
        return side, x

    def plan(self, x: np.ndarray, parts: int) -> Side:
        if not hasattr(self, "clean"):
            self.clean = np.zeros(40 * self.khz)
        return self.analysed(np.asarray(x, float), parts, 1.0)[0]

    def encode(self, wire: Writer, x: np.ndarray, base: Side, parts: int, follows: bool, most_bits: int) -> tuple[Side, np.ndarray]:
        """A frame that ends before ``most_bits`` as the wire counts: gains go up until it fits. Returns what was coded."""
        start = deepcopy((self.out, self.spectrum, self.level, self.before))
        soften = SHAPE ** np.arange(self.order, 0, -1)
        for raise_by in (-8, -5, -2, 1, 4, 7, 10, 13, 17, 22, None):
            self.out, self.spectrum, self.level, self.before = deepcopy(start)
            self.follows = follows
            side = deepcopy(base)
            # The last resort is silence: no pulses, and gains so low that the excitation's offset isn't heard.
            side.gains = self._coded([max(0, min(63, g + raise_by)) if raise_by is not None else 0 for g in base.gains])
            wrong = np.zeros(self.order + len(x))

            def choose(k: int, guess: float, gain: float, offset: float, flip: int, back: np.ndarray) -> int:
                # Noise goes where the signal is: part of the error so far is left as it is.
                want = (x[k] - guess - (back * soften) @ wrong[k : k + self.order]) / gain  # noqa: B023
                want = (-want if flip else want) - offset
                pulse = round(want + (0.078125 if want > 0.5 else -0.078125 if want < -0.5 else 0.0))
                pulse = 0 if raise_by is None else max(-30, min(30, pulse))  # noqa: B023
                e = pulse - (0.078125 if pulse > 0 else -0.078125 if pulse < 0 else 0.0) + offset
                wrong[k + self.order] = x[k] - guess - gain * (-e if flip else e)  # noqa: B023
                return pulse

            _, pulses = self.synthesis(side, None, parts, choose)
            trial = deepcopy(wire)
            code_side(trial, side, self.khz, parts, side.kind != INACTIVE, follows, start[3], self.tables)
            code_pulses(trial, pulses, side.kind, side.offset, len(x), self.tables)
            if trial.tell() <= most_bits:
                wire.coder = trial.coder
                return side, pulses
        raise ValueError("the packet is too small for the speech layer")

    def _coded(self, levels: list[int]) -> list[int]:
        """Codes that give the levels, or come near."""
        codes, now = [], self.level
        for k, level in enumerate(levels):
            if k == 0 and not self.follows:
                codes.append(level)
                now = max(level, (now or 0) - 16)
            else:
                codes.append(min(range(41), key=lambda c: abs(_step(now, c) - level)))  # noqa: B023
                now = _step(now, codes[-1])
        return codes


def levels_of(codes: list[int], previous: int | None, follows: bool) -> list[int]:
    """Gain levels: the first absolute (at most 16 below the last one) unless it follows, others by steps."""
    out: list[int] = []
    for k, code in enumerate(codes):
        last = out[-1] if out else previous or 0
        out.append(max(code, last - 16) if k == 0 and not follows else _step(last, code))
    return out


def _step(level: int, code: int) -> int:
    return min(max(max(2 * code - 16, level + code - 4), 0), 63)


def lags_of(lag: int, contour: int, khz: int, parts: int) -> list[int]:
    table = st.CONTOUR_LAGS[khz == 8, parts]
    return [min(max(2 * khz + lag + table[s][contour], 2 * khz), 18 * khz) for s in range(parts)]


# Packets


class Resampler:
    """Changes the rate by a whole factor, frame by frame; lags by TAPS samples of the lower rate."""

    TAPS = 8

    def __init__(self, factor: int, up: bool):
        self.factor, self.up = factor, up
        t = np.arange(-self.TAPS * factor, self.TAPS * factor) / factor
        cut = 0.95
        self.h = np.sinc(cut * t) * cut * np.cos(pi * t / (2 * self.TAPS)) ** 2
        if not up:
            self.h /= factor
        self.past = np.zeros(2 * self.TAPS - 1 if up else 2 * self.TAPS * factor - 1)

    def process(self, x: np.ndarray) -> np.ndarray:
        whole = np.concatenate([self.past, x])
        self.past = whole[-len(self.past) :]
        if self.up:
            windows = np.lib.stride_tricks.sliding_window_view(whole, 2 * self.TAPS)
            phases = [windows @ self.h[p :: self.factor][::-1] for p in range(self.factor)]
            return np.stack(phases, axis=1).ravel()
        windows = np.lib.stride_tricks.sliding_window_view(whole, len(self.h))[:: self.factor]
        return windows @ self.h[::-1]


def _flags(wire: Wire, n: int, active: list[bool] | None, copy: bool = False) -> tuple[list[bool], list[bool]]:
    """Activity of n frames, and which have a recovery copy (of the frames of the packet before)."""
    voice = [bool(wire.bit(active[k] if active else False, 1)) for k in range(n)]
    copies = [False] * n
    if wire.bit(copy, 1):
        pattern = wire.table(0, st.RECOVERY[n], 8) + 1 if n > 1 else 1
        copies = [bool(pattern >> k & 1) for k in range(n)]
    return voice, copies


def predictor_value(coarse: int, fifth: int) -> int:
    """A stereo predictor in 1/8192: a fifth of the way between two coarse steps."""
    low = st.STEREO_LEVELS[coarse]
    return low + ((st.STEREO_LEVELS[coarse + 1] - low) * 6554 >> 16) * (2 * fifth + 1)


NO_PREDICTION = (7, 2)


def code_predictors(wire: Wire, want: tuple[int, int] = NO_PREDICTION) -> tuple[float, float]:
    """Predictors of the side from the smoothed mid and from the mid; what is written has no say of the smoothed one."""
    coarse, fifth = want
    joint = wire.table(6 * (coarse // 3), st.STEREO_JOINT, 8)
    out = []
    for third in (joint // 5, joint % 5):
        at = wire.table(coarse % 3, st.UNIFORM[3], 8) + 3 * third
        out.append(predictor_value(at, wire.table(fifth, st.UNIFORM[5], 8)))
    return (out[0] - out[1]) / 8192, out[1] / 8192


@dataclass
class SpeechDecoder:
    """The speech layer of a stream, at 48 kHz and full scale 1."""

    channels: int = 1
    tables: st.SpeechTables = field(default_factory=st.SpeechTables)
    khz: int = 0

    def _start(self, khz: int) -> None:
        if khz != self.khz:
            self.khz = khz
            self.layers = [SpeechChannel(khz, self.tables) for _ in range(2)]
            self.up = [Resampler(48 // khz, True) for _ in range(2)]
            self.mid, self.side = np.zeros(2), np.zeros(1)
            self.predictors, self.only_mid = (0.0, 0.0), False

    def decode(self, wire: Reader, ms: int, khz: int, coded: int) -> np.ndarray:
        self._start(khz)
        n, parts = max(1, ms // 20), 2 if ms == 10 else 4
        heads = [_flags(wire, n, None) for _ in range(coded)]
        before: list[Side | None] = [None, None]
        for k in range(n):
            for c in range(coded):
                if heads[c][1][k]:
                    if coded == 2 and c == 0:
                        code_predictors(wire)
                        if not heads[1][1][k]:
                            wire.table(0, st.MID_ONLY, 8)
                    before[c] = self.layers[c].skip(wire, parts, k > 0 and heads[c][1][k - 1], before[c])
        out = []
        for k in range(n):
            predictors, only_mid = (0.0, 0.0), False
            if coded == 2:
                predictors = code_predictors(wire)
                only_mid = not heads[1][0][k] and bool(wire.table(0, st.MID_ONLY, 8))
            mid = self.layers[0].decode(wire, parts, heads[0][0][k], k > 0)
            side = np.zeros(len(mid))
            if coded == 2 and not only_mid:
                if self.only_mid:
                    self.layers[1] = SpeechChannel(khz, self.tables)
                side = self.layers[1].decode(wire, parts, heads[1][0][k], k > 0 and not self.only_mid, k == 0)
            out.append(self._unmixed(mid, side, predictors, coded))
            self.only_mid = only_mid if coded == 2 else False
        return np.concatenate(out, axis=1)

    def recover(self, wire: Reader, ms: int, khz: int, coded: int) -> np.ndarray | None:
        """The frames before, from the copies in this packet; frames without one are concealed. None if there is no copy."""
        if self.khz != khz:
            return None
        n, parts = max(1, ms // 20), 2 if ms == 10 else 4
        heads = [_flags(wire, n, None) for _ in range(coded)]
        if not any(heads[0][1]):
            return None
        out = []
        for k in range(n):
            predictors, side = (0.0, 0.0), np.zeros(parts * 5 * khz)
            if not heads[0][1][k]:
                out.append(self._unmixed(self.layers[0].conceal(parts), side, self.predictors, 1))
                continue
            if coded == 2:
                predictors = code_predictors(wire)
                if not heads[1][1][k]:
                    wire.table(0, st.MID_ONLY, 8)
            mid = self.layers[0].decode(wire, parts, True, k > 0 and heads[0][1][k - 1])
            if coded == 2 and heads[1][1][k]:
                side = self.layers[1].decode(wire, parts, True, k > 0 and heads[1][1][k - 1])
            out.append(self._unmixed(mid, side, predictors, coded))
        return np.concatenate(out, axis=1)

    def conceal(self, ms: int) -> np.ndarray:
        if not self.khz:
            return np.zeros((self.channels, ms * 48))
        out = []
        for _ in range(max(1, ms // 20)):
            parts = 2 if ms == 10 else 4
            out.append(self._unmixed(self.layers[0].conceal(parts), np.zeros(parts * 5 * self.khz), self.predictors, 1))
        return np.concatenate(out, axis=1)

    def _unmixed(self, mid: np.ndarray, side: np.ndarray, predictors: tuple[float, float], coded: int) -> np.ndarray:
        wide = np.concatenate([self.mid, mid]) / 32768
        late = np.concatenate([self.side, side])[:-1] / 32768
        if coded == 2:
            left, right = unmix_stereo(wide, late, self.predictors, predictors, 8 * self.khz)
        else:
            left = right = wide[1:-1]
        self.mid, self.side, self.predictors = mid[-2:], side[-1:], predictors
        if self.channels == 1:
            return self.up[0].process((left + right) / 2)[None]
        return np.array([self.up[0].process(left), self.up[1].process(right)])


@dataclass
class SpeechEncoder:
    """Frames of 10 to 60 ms at 48 kHz to the speech layer of packets."""

    channels: int = 1
    khz: int = 16
    tables: st.SpeechTables = field(default_factory=st.SpeechTables)
    copies: bool = False  # of the frame before, for recovery (one channel, one frame a packet)
    last: tuple[Side, np.ndarray, int] | None = None
    predictor: float = 0.0

    #: Samples at 48 kHz by which the decoded signal lags.
    @property
    def lag(self) -> int:
        return (2 * Resampler.TAPS + 1) * 48 // self.khz

    def __post_init__(self) -> None:
        self.layers = [SpeechChannel(self.khz, self.tables) for _ in range(2)]
        self.down = [Resampler(48 // self.khz, False) for _ in range(2)]

    def encode(self, wire: Writer, pcm: np.ndarray, bits: int) -> None:
        """Codes a frame in at most ``bits`` as the wire counts."""
        low = np.array([self.down[c].process(pcm[c]) for c in range(self.channels)]) * 32768
        tracks = [low[0]] if self.channels == 1 else [(low[0] + low[1]) / 2, (low[0] - low[1]) / 2]
        ms = pcm.shape[1] // 48
        n, parts = max(1, ms // 20), 2 if ms == 10 else 4
        size = parts * 5 * self.khz
        chosen = [self._predicted(tracks, slice(k * size, (k + 1) * size)) for k in range(n)] if self.channels == 2 else []
        plans = [[self.layers[c].plan(x[k * size : (k + 1) * size], parts) for k in range(n)] for c, x in enumerate(tracks)]
        copy = self.last if self.copies and self.channels == n == 1 and self.last and wire.tell() + self.last[2] < bits // 2 else None
        for c in range(self.channels):
            _flags(wire, n, [p.kind != INACTIVE for p in plans[c]], copy is not None)
        if copy:
            code_side(wire, copy[0], self.khz, parts, True, False, None, self.tables)
            code_pulses(wire, copy[1], copy[0].kind, copy[0].offset, size, self.tables)
        first = wire.tell()
        for k in range(n):
            if self.channels == 2:
                code_predictors(wire, chosen[k])
                if plans[1][k].kind == INACTIVE:
                    wire.table(0, st.MID_ONLY, 8)
            for c, x in enumerate(tracks):
                share = 1.0 if c == self.channels - 1 else 0.65
                end = first + (bits - first) * (k + share) / n
                if self.copies and self.channels == n == 1:  # its copy must fit into the next packet
                    end = min(end, wire.tell() + 0.45 * bits)
                used = wire.tell()
                side, pulses = self.layers[c].encode(wire, x[k * size : (k + 1) * size], plans[c][k], parts, k > 0, int(end))
                self.last = (side, pulses, wire.tell() - used) if side.kind != INACTIVE else None


    def _predicted(self, tracks: list[np.ndarray], part: slice) -> tuple[int, int]:
        """Takes what the mid tells of the side out of it, and says by which predictor; it fades in from the one before."""
        mid, side = tracks[0][part], tracks[1][part]
        want = 8192 * float(mid @ side) / (1 + float(mid @ mid))
        choice = min(((c, f) for c in range(15) for f in range(5)), key=lambda v: abs(predictor_value(*v) - want))
        new = predictor_value(*choice) / 8192
        step = np.minimum(np.arange(2, len(mid) + 2) / (8 * self.khz), 1.0)
        tracks[1][part] = side - (self.predictor + (new - self.predictor) * step) * mid
        self.predictor = new
        return choice


def speech_packet(encoder: SpeechEncoder, pcm: np.ndarray, size: int) -> tuple[bytes, int]:
    """A speech frame in at most ``size`` bytes, as short as it comes out, and its final range."""
    wire = Writer(Encoder(size), size)
    encoder.encode(wire, pcm, 8 * size)
    wire.coder.size = max(2, (wire.tell() + 7) >> 3)
    return wire.coder.finish(), wire.coder.range
