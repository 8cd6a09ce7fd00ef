"""Band shapes and energies of the transform layer, read or written by one code path.

A ``Wire`` either reads symbols or writes them; every function hands it the value it
would write and goes on with the value it returns, so decoder and encoder can't
drift apart. The rules are those of RFC 6716, section 4.3.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import atan2, cos, floor, pi, sqrt

import numpy as np

from sonarmill.functions import allocation as alloc
from sonarmill.functions.allocation import N_BANDS, noise_step
from sonarmill.functions.entropy import Decoder, Encoder, decode_laplace, decode_pulses, encode_laplace, encode_pulses
from sonarmill.functions.transform import BAND_EDGES, haar, pulses

#: Fixed values of the format: mean band energies (log2), prediction over time and over bands by frame size,
#: order of short blocks, tables of small energies, tapsets, spreading and tilt, time-frequency steps.
MEAN_ENERGY = (6.4375, 6.25, 5.75, 5.3125, 5.0625, 4.8125, 4.5, 4.375, 4.875, 4.6875, 4.5625, 4.4375, 4.875, 4.625, 4.3125, 4.5, 4.375, 4.625, 4.75, 4.4375, 3.75)
OVER_TIME = tuple(x / 32768 for x in (29440, 26112, 21248, 16384))
OVER_BANDS = tuple(x / 32768 for x in (30147, 22282, 12124, 6554))
OVER_BANDS_ALONE = 4915 / 32768
BLOCK_ORDER = {2: (1, 0), 4: (3, 0, 2, 1), 8: (7, 0, 4, 3, 6, 1, 5, 2), 16: (15, 0, 8, 7, 12, 3, 11, 4, 14, 1, 9, 6, 13, 2, 10, 5)}
SMALL_ENERGY = [2, 1, 0]
SPREADING = [25, 23, 2, 0]
TILT = [126, 124, 119, 109, 87, 41, 19, 9, 4, 2, 0]
TIME_FREQUENCY = ((0, -1, 0, -1, 0, -1, 0, -1), (0, -1, 0, -2, 1, 0, 1, -1), (0, -2, 0, -3, 2, 0, 1, -1), (0, -2, 0, -3, 3, 0, 1, -1))
TURN = (0, 15, 10, 5)

#: (chance of 0 in 1/256, decay in 1/256) of the coarse energy of a band, from (frame size, coded alone, band).
CoarseModel = Callable[[int, bool, int], tuple[int, int]]


def plain_model(lm: int, alone: bool, band: int) -> tuple[int, int]:
    """A model by rule. Streams of the public format need the format's own table (``model_from_table``)."""
    return (40 + 4 * band, max(35, 130 - 5 * band)) if alone else (60 + 5 * band - 4 * (3 - lm), max(12, 80 - 4 * band))


def model_from_table(rows: list[tuple[int, bool, int, int, int]]) -> CoarseModel:
    """The model of a table (lm, alone, band, chance, decay), 336 numbers in the public format."""
    known = {(lm, bool(alone), band): (chance, decay) for lm, alone, band, chance, decay in rows}
    missing = [(lm, alone, band) for lm in range(4) for alone in (False, True) for band in range(N_BANDS) if (lm, alone, band) not in known]
    if missing:
        raise ValueError(f"the energy model lacks {len(missing)} of {8 * N_BANDS} cells")
    return lambda lm, alone, band: known[lm, bool(alone), min(band, 20)]


class Wire:
    """Symbols of one frame."""

    writing = False

    def __init__(self, coder: Decoder | Encoder, size: int):
        self.coder, self.bits, self.over = coder, 8 * size, 0

    def tell(self) -> int:
        return self.coder.tell() + self.over

    def eighths(self) -> int:
        return self.coder.tell_eighths() + 8 * self.over

    def room(self, bits: int) -> bool:
        return self.tell() + bits <= self.bits

    def exhaust(self) -> None:
        """All that is left counts as used."""
        self.over = max(0, self.bits - self.coder.tell())


class Reader(Wire):
    def bit(self, value, log_odds: int) -> int:
        return int(self.coder.bit(log_odds))

    def table(self, value, falling: list[int], bits: int) -> int:
        return self.coder.from_table(falling, bits)

    def raw(self, value, bits: int) -> int:
        return self.coder.raw_number(bits)

    def uniform(self, value, total: int) -> int:
        return self.coder.uniform(total)

    def laplace(self, value, centre: int, decay: int) -> int:
        return decode_laplace(self.coder, centre, decay)

    def cells(self, value, edges: list[int]) -> int:
        place = self.coder.where(edges[-1])
        k = int(np.searchsorted(edges, place, "right")) - 1
        self.coder.take(edges[k], edges[k + 1], edges[-1])
        return k

    def pulses(self, value, n: int, k: int) -> list[int]:
        return decode_pulses(self.coder, n, k)


class Writer(Wire):
    writing = True

    def bit(self, value, log_odds: int) -> int:
        self.coder.bit(bool(value), log_odds)
        return int(bool(value))

    def table(self, value, falling: list[int], bits: int) -> int:
        self.coder.from_table(value, falling, bits)
        return value

    def raw(self, value, bits: int) -> int:
        self.coder.raw_number(value, bits)
        return value

    def uniform(self, value, total: int) -> int:
        self.coder.uniform(value, total)
        return value

    def laplace(self, value, centre: int, decay: int) -> int:
        return encode_laplace(self.coder, value, centre, decay)

    def cells(self, value, edges: list[int]) -> int:
        self.coder.symbol(edges[value], edges[value + 1], edges[-1])
        return value

    def pulses(self, value, n: int, k: int) -> list[int]:
        encode_pulses(self.coder, list(value))
        return list(value)


# Energies


def coarse_energy(wire: Wire, log: np.ndarray, target: np.ndarray | None, start: int, end: int, alone: bool, lm: int, model: CoarseModel) -> None:
    """Whole steps of the band energies, predicted over time and bands; ``log`` holds the last frame's and becomes this one's."""
    channels = len(log)
    over_time, over_bands = (0.0, OVER_BANDS_ALONE) if alone else (OVER_TIME[lm], OVER_BANDS[lm])
    carried = [0.0] * channels
    for i in range(start, end):
        for c in range(channels):
            expected = over_time * max(-9.0, log[c, i]) + carried[c]
            step = floor(target[c, i] - expected + 0.5) if target is not None else 0
            if target is not None and i != start:  # keep some bits for the bands above
                left = wire.bits - wire.tell() - 3 * channels * (end - i)
                step = max(step, -1) if left < 16 else step
                step = min(step, 1) if left < 24 else step
            chance, decay = model(lm, alone, min(i, 20))
            if wire.room(15):
                step = wire.laplace(step, chance << 7, decay << 6)
            elif wire.room(2):
                step = max(-1, min(1, step))
                coded = wire.table(2 * step ^ -(step < 0), SMALL_ENERGY, 2)
                step = (coded >> 1) ^ -(coded & 1)
            elif wire.room(1):
                step = -wire.bit(step < 0, 1)
            else:
                step = -1
            log[c, i] = expected + step
            carried[c] += step - over_bands * step


def fine_energy(wire: Wire, log: np.ndarray, target: np.ndarray | None, start: int, end: int, fine: list[int]) -> None:
    for i in range(start, end):
        for c in range(len(log)):
            if fine[i] > 0:
                steps = 1 << fine[i]
                want = min(steps - 1, max(0, floor((target[c, i] - log[c, i] + 0.5) * steps))) if target is not None else 0
                log[c, i] += (wire.raw(want, fine[i]) + 0.5) / steps - 0.5


def last_energy(wire: Wire, log: np.ndarray, target: np.ndarray | None, start: int, end: int, fine: list[int], first: list[bool]) -> None:
    """One more bit for as many bands as bits are left, those that were rounded down first."""
    left = wire.bits - wire.tell()
    for turn in (True, False):
        for i in range(start, end):
            if left < len(log):
                return
            if fine[i] >= alloc.MAX_FINE or first[i] is not (not turn):
                continue
            for c in range(len(log)):
                up = wire.raw(int(target is not None and target[c, i] >= log[c, i]), 1)
                log[c, i] += (up - 0.5) / (1 << (fine[i] + 1))
                left -= 1


# Shapes


def turned(x: np.ndarray, back: bool, blocks: int, k: int, spread: int) -> np.ndarray:
    """Spreading rotation of a shape with k pulses: before quantising, or ``back`` after it."""
    n = len(x)
    if 2 * k >= n or not spread:
        return x
    share = n / (n + TURN[spread] * k)
    angle = share * share / 2
    c, s = cos(pi / 2 * angle), cos(pi / 2 * (1 - angle))
    wide = 0
    if n >= 8 * blocks:
        wide = 1
        while (wide * wide + wide) * blocks + (blocks >> 2) < n:
            wide += 1

    def pass_over(v: list[float], step: int, c: float, s: float) -> None:
        m = len(v)
        for places in (range(m - step), range(m - 2 * step - 1, -1, -1)):
            for i in places:
                a, b = v[i], v[i + step]
                v[i + step], v[i] = c * b + s * a, c * a - s * b

    out = []
    for part in x.reshape(blocks, -1).tolist():
        if back:
            if wide:
                pass_over(part, wide, s, c)
            pass_over(part, 1, c, s)
        else:
            pass_over(part, 1, c, -s)
            if wide:
                pass_over(part, wide, s, -c)
        out += part
    return np.array(out)


def unit(x: np.ndarray, gain: float = 1.0) -> np.ndarray:
    return x * (gain / sqrt(1e-15 + float(x @ x)))


def blocks_hit(vector: np.ndarray, blocks: int) -> int:
    """Bit k: the k-th part of the vector has pulses."""
    if blocks <= 1:
        return 1
    return sum(1 << k for k, hit in enumerate(np.asarray(vector).reshape(blocks, -1).any(axis=1)) if hit)


def dealt(x: np.ndarray, size: int, blocks: int, by_sequency: bool, back: bool = False) -> np.ndarray:
    """Interleaved blocks one after the other (in order of sequency), or back."""
    order = list(BLOCK_ORDER[blocks]) if by_sequency else list(range(blocks))
    if back:
        return x.reshape(blocks, size)[order].T.ravel()
    out = np.empty((blocks, size))
    out[order] = x.reshape(size, blocks).T
    return out.ravel()


def _angle(x: np.ndarray, y: np.ndarray) -> int:
    """Angle between two parts by their energies, 16384 to a quarter turn."""
    return floor(0.5 + 16384 * 2 / pi * atan2(sqrt(1e-15 + float(y @ y)), sqrt(1e-15 + float(x @ x))))



def _halved(b: int) -> int:
    return alloc._toward_zero(b, 2)


@dataclass
class Split:
    mid: float
    side: float
    delta: int
    angle: int
    cost: int
    flip: bool


@dataclass
class Shapes:
    """Codes the unit shapes of a frame's bands."""

    wire: Wire
    spread: int
    intensity: int
    seed: int
    energies: np.ndarray | None = None  # amplitudes by channel and band, where written
    left: int = 0
    band: int = 0
    step: int = 0
    masks: list[list[int]] = field(default_factory=list)

    def split(self, x, y, n: int, b: int, blocks: int, whole: int, lm: int, stereo: bool, fill: int) -> tuple[Split, int, int]:
        """The angle between two halves or channels, the budget and the blocks to fill after it."""
        cap = alloc.LOG_WIDTH[self.band] + lm * 8
        offset = (cap >> 1) - (alloc.ANGLE_OFFSET_PAIR if stereo and n == 2 else alloc.ANGLE_OFFSET)
        steps = alloc.angle_steps(n, b, offset, cap, stereo)
        if stereo and self.band >= self.intensity:
            steps = 1
        want = 0
        if x is not None:
            want = _angle((x + y) / 2, (y - x) / 2) if stereo else _angle(x, y)
        before, flip, angle = self.wire.eighths(), False, 0
        if steps > 1:
            want = (want * steps + 8192) >> 14
            half = steps >> 1
            if stereo and n > 2:
                edges = [3 * k for k in range(half + 2)]
                edges += [edges[-1] + k for k in range(1, half + 1)]
                got = self.wire.cells(want, edges)
            elif whole > 1 or stereo:
                got = self.wire.uniform(want, steps + 1)
            else:
                edges = np.cumsum([0, *(min(k, steps - k) + 1 for k in range(steps + 1))]).tolist()
                got = self.wire.cells(want, edges)
            angle = got * 16384 // steps
        elif stereo and b > 16 and self.left > 16:
            flip = bool(self.wire.bit(want > 8192, 2))
        cost = self.wire.eighths() - before
        part = (1 << blocks) - 1
        if angle == 0:
            out = Split(32767, 0, -16384, 0, cost, flip)
            fill &= part
        elif angle == 16384:
            out = Split(0, 32767, 16384, angle, cost, flip)
            fill &= part << blocks
        else:
            mid, side = alloc.cosine(angle), alloc.cosine(16384 - angle)
            out = Split(mid, side, alloc.multiply_16((n - 1) << 7, alloc.log_tangent(side, mid)), angle, cost, flip)
        out.mid, out.side = out.mid / 32768, out.side / 32768
        return out, b - cost, fill

    def _noise(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for k in range(n):
            self.seed = noise_step(self.seed)
            out[k] = self.seed
        return out

    def part(self, x, n: int, b: int, blocks: int, low, lm: int, gain: float, fill: int) -> tuple[np.ndarray, int]:
        """The shape of (a part of) a band and which of its blocks are not empty."""
        size = alloc.part_size(self.band, lm)
        costs = alloc.ladder(size)
        if lm != -1 and b > costs[-1] + 11 and n > 2:
            return self._parted(x, n >> 1, b, blocks, low, lm - 1, gain, fill)
        level = alloc.level_for(size, b)
        self.left -= costs[level]
        while self.left < 0 and level > 0:
            self.left += costs[level]
            level -= 1
            self.left -= costs[level]
        if level:
            k = alloc.pulses_of(level)
            want = pulses(turned(x, False, blocks, k, self.spread), k) if x is not None else None
            vector = np.array(self.wire.pulses(want, n, k), float)
            return turned(unit(vector, gain), True, blocks, k, self.spread), blocks_hit(vector, blocks)
        every = (1 << blocks) - 1
        fill &= every
        if not fill:
            return np.zeros(n), 0
        if low is None:
            noise = self._noise(n)
            return unit(np.where(noise >= 1 << 31, noise - (1 << 32), noise) >> 20, gain), every
        return unit(low + np.where(self._noise(n) & 0x8000, 1 / 256, -1 / 256), gain), fill

    def _parted(self, x, n: int, b: int, blocks: int, low, lm: int, gain: float, fill: int) -> tuple[np.ndarray, int]:
        whole = blocks
        if blocks == 1:
            fill = (fill & 1) | (fill << 1)
        blocks = (blocks + 1) >> 1
        halves = [None, None] if x is None else [x[:n], x[n:]]
        lows = [None, None] if low is None else [low[:n], low[n:]]
        s, b, fill = self.split(*halves, n, b, blocks, whole, lm, False, fill)
        delta = s.delta
        if whole > 1 and s.angle & 0x3FFF:
            delta = delta - (delta >> (4 - lm)) if s.angle > 8192 else min(0, delta + (n << 3 >> (5 - lm)))
        shares = [max(0, min(b, _halved(b - delta)))]
        shares.append(b - shares[0])
        self.left -= s.cost
        out, mask = [None, None], 0
        turns = ((0, s.mid, s.angle != 0), (1, s.side, s.angle != 16384))
        order = turns if shares[0] >= shares[1] else turns[::-1]
        for which, (k, factor, other) in enumerate(order):
            before = self.left
            out[k], hit = self.part(halves[k], n, shares[k], blocks, lows[k], lm, gain * factor, fill >> blocks * k)
            mask |= hit << (whole >> 1) * k
            if not which:  # what the first half left over goes to the other
                spare = shares[k] - (before - self.left)
                if spare > 24 and other:
                    shares[1 - k] += spare - 24
        return np.concatenate(out), mask

    def single(self, values: list) -> tuple[list[np.ndarray], int]:
        """Bands of one bin have a sign only."""
        out = []
        for x in values:
            sign = 0
            if self.left >= 8:
                sign = self.wire.raw(int(x is not None and x[0] < 0), 1)
                self.left -= 8
            out.append(np.array([-1.0 if sign else 1.0]))
        return out, 1

    def mono(self, x, n: int, b: int, blocks: int, low, lm: int, gain: float, fill: int) -> tuple[np.ndarray, int, np.ndarray]:
        """A band's shape; also its blocks, and the shape scaled for folding into higher bands."""
        if n == 1:
            (y,), mask = self.single([x])
            return y, mask, y
        whole, long, size, steps = blocks, blocks == 1, n // blocks, self.step
        merged = max(steps, 0)
        for k in range(merged):
            x, low = (None if v is None else haar(v, 1 << k) for v in (x, low))
            fill = sum(1 << j for j in range(4) if fill >> 2 * j & 3)
        blocks >>= merged
        size <<= merged
        cut = 0
        while not size & 1 and steps < 0:
            x, low = (None if v is None else haar(v, blocks) for v in (x, low))
            fill |= fill << blocks
            blocks <<= 1
            size >>= 1
            cut += 1
            steps += 1
        dealing = (size >> merged, blocks << merged, long)
        if blocks > 1:
            x, low = (None if v is None else dealt(v, *dealing) for v in (x, low))
        y, mask = self.part(x, n, b, blocks, low, lm, gain, fill)
        if blocks > 1:
            y = dealt(y, *dealing, back=True)
        for _ in range(cut):
            blocks >>= 1
            size <<= 1
            mask |= mask >> blocks
            y = haar(y, blocks)
        for k in range(merged):
            mask = sum(3 << 2 * j for j in range(8) if mask >> j & 1)
            y = haar(y, 1 << k)
        return y, mask & ((1 << whole) - 1), y * sqrt(n)

    def both(self, x, y, n: int, b: int, blocks: int, low, lm: int, fill: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """Two channels of a band as mid and side; also the blocks and the mid shape for folding."""
        if n == 1:
            (u, v), mask = self.single([x, y])
            return u, v, mask, u
        given = fill
        s, b, fill = self.split(x, y, n, b, blocks, blocks, lm, True, fill)
        if x is not None:
            if s.flip:
                y = -y
            if s.angle == 0:
                l, r = self.energies[:, self.band]
                x = (x * l + y * r) / sqrt(1e-15 + l * l + r * r)
            else:
                x, y = (x + y) * sqrt(0.5), (y - x) * sqrt(0.5)
        if n == 2:
            signed = 0 < s.angle < 16384
            self.left -= s.cost + 8 * signed
            swap = s.angle > 8192
            long, short = (y, x) if swap else (x, y)
            sign = 0
            if signed:
                sign = self.wire.raw(int(x is not None and long[0] * short[1] - long[1] * short[0] < 0), 1)
            sign = 1 - 2 * sign
            u, mask, kept = self.mono(long, 2, b - 8 * signed, blocks, low, lm, 1.0, given)
            v = np.array([-sign * u[1], sign * u[0]])
            mid, side = (v, u) if swap else (u, v)
            mid, side = s.mid * mid, s.side * side
            l, r = mid - side, mid + side
        else:
            shares = [max(0, min(b, _halved(b - s.delta)))]
            shares.append(b - shares[0])
            self.left -= s.cost
            got, mask, kept = [None, None], 0, None
            turns = ((0, s.angle != 0), (1, s.angle != 16384))
            for which, (k, other) in enumerate(turns if shares[0] >= shares[1] else turns[::-1]):
                before = self.left
                if k == 0:
                    got[0], hit, kept = self.mono(x, n, shares[0], blocks, low, lm, 1.0, fill)
                else:
                    got[1], hit, _ = self.mono(y, n, shares[1], blocks, None, lm, s.side, fill >> blocks)
                mask |= hit
                if not which:
                    spare = shares[k] - (before - self.left)
                    if spare > 24 and other:
                        shares[1 - k] += spare - 24
            l, r = merge(got[0], got[1], s.mid)
        return l, -r if s.flip else r, mask, kept

    def all_bands(self, spectra: np.ndarray | None, start: int, end: int, bits: list[int], blocks: int, changes: list[int], total: int, balance: int, lm: int, coded: int, dual: bool, channels: int) -> np.ndarray:
        """Unit shapes of all bands by channel. ``total`` eighths may be used in all."""
        scale = 1 << lm
        out = np.zeros((channels, 120 << lm))
        base = scale * BAND_EDGES[start]
        norm = np.zeros((2, scale * BAND_EDGES[-1]))
        source, fresh = 0, True
        self.masks = [[0, 0] for _ in range(N_BANDS)]
        for i in range(start, end):
            self.band, self.step = i, changes[i]
            a, z = BAND_EDGES[i] * scale, BAND_EDGES[i + 1] * scale
            n = z - a
            told = self.wire.eighths()
            if i != start:
                balance -= told
            self.left = total - told - 1
            b = 0
            if i < coded:
                b = max(0, min(16383, self.left + 1, bits[i] + alloc._toward_zero(balance, min(3, coded - i))))
            if (a - n >= base or i == start + 1) and (fresh or not source):
                source = i
            if i == start + 1:  # the second band of a frame may be wider than the first
                first = BAND_EDGES[start + 1] * scale - base
                second = n - first
                if second > 0:
                    norm[:, first : first + second] = norm[:, 2 * first - n : first]
            low_at, every = -1, (1 << blocks) - 1
            fill = [every, every]
            if source and (self.spread != 3 or blocks > 1 or changes[i] < 0):
                low_at = max(0, BAND_EDGES[source] * scale - base - n)
                head = source - 1
                while BAND_EDGES[head] * scale > low_at + base:
                    head -= 1
                tail = source
                while tail < i and BAND_EDGES[tail] * scale < low_at + base + n:
                    tail += 1
                fill = [0, 0]
                for k in range(head, max(tail, head + 1)):
                    fill[0] |= self.masks[k][0]
                    fill[1] |= self.masks[k][channels - 1]
            if dual and i == self.intensity:
                dual = False
                norm[0, : a - base] = (norm[0, : a - base] + norm[1, : a - base]) / 2
            lows = [None if low_at < 0 else norm[c, low_at : low_at + n].copy() for c in range(2)]
            parts = [None, None] if spectra is None else [spectra[c, a:z] for c in range(channels)]
            kept = [None, None]
            if dual:
                for c in range(2):
                    out[c, a:z], self.masks[i][c], kept[c] = self.mono(parts[c], n, b >> 1, blocks, lows[c], lm, 1.0, fill[c])
            elif channels == 2:
                out[0, a:z], out[1, a:z], mask, kept[0] = self.both(parts[0], parts[1], n, b, blocks, lows[0], lm, fill[0] | fill[1])
                self.masks[i] = [mask, mask]
            else:
                out[0, a:z], mask, kept[0] = self.mono(parts[0], n, b, blocks, lows[0], lm, 1.0, fill[0] | fill[1])
                self.masks[i] = [mask, mask]
            for c in range(2):
                if kept[c] is not None:
                    norm[c, a - base : z - base] = kept[c]
            balance += bits[i] + told
            fresh = b > n << 3
        return out


def merge(x: np.ndarray, y: np.ndarray, mid: float) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of a unit mid (to be scaled) and a scaled side, each of unit length."""
    cross, side = mid * float(x @ y), float(y @ y)
    left, right = mid * mid + side - 2 * cross, mid * mid + side + 2 * cross
    if min(left, right) < 6e-4:
        return x.copy(), x.copy()
    return (mid * x - y) / sqrt(left), (mid * x + y) / sqrt(right)


def revive(x: np.ndarray, masks: list[list[int]], lm: int, start: int, end: int, log: np.ndarray, older: np.ndarray, oldest: np.ndarray, shape_bits: list[int], seed: int) -> int:
    """Noise for short blocks without any pulse, no louder than what was there before. Returns the seed."""
    channels = len(x)
    for i in range(start, end):
        width = alloc.WIDTH[i]
        depth = (1 + shape_bits[i]) // width >> lm
        bound, root = 0.5 * 2 ** (-0.125 * depth), 1 / sqrt(width << lm)
        for c in range(channels):
            before = [older[c, i], oldest[c, i]]
            if channels == 1 and len(older) > 1:
                before = [max(older[0, i], older[1, i]), max(oldest[0, i], oldest[1, i])]
            size = 2 * 2 ** -max(0.0, log[c, i] - min(before)) * (sqrt(2) if lm == 3 else 1)
            size = min(bound, size) * root
            a, z = BAND_EDGES[i] << lm, BAND_EDGES[i + 1] << lm
            touched = False
            for k in range(1 << lm):
                if not masks[i][c] >> k & 1:
                    for j in range(width):
                        seed = noise_step(seed)
                        x[c, a + (j << lm) + k] = size if seed & 0x8000 else -size
                    touched = True
            if touched:
                x[c, a:z] = unit(x[c, a:z])
    return seed
