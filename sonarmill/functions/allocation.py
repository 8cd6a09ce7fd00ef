"""Bit allocation of the transform layer (RFC 6716, section 4.3.3): all whole numbers, eighths of bits.

What both sides must agree on: how many pulses a budget buys, each band's cap,
how a frame's budget is shared among bands, and the resolution of a split's angle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

from sonarmill.functions.entropy import pulse_vectors
from sonarmill.functions.transform import BAND_EDGES

N_BANDS = len(BAND_EDGES) - 1
WIDTH = [b - a for a, b in zip(BAND_EDGES[:-1], BAND_EDGES[1:], strict=True)]

#: Fixed values of the format: logarithms of band widths in eighths, bits per sample and band at eleven
#: qualities (in 1/32), caps by frame size and channels, costs of the intensity field.
LOG_WIDTH = (0, 0, 0, 0, 0, 0, 0, 0, 8, 8, 8, 8, 16, 16, 16, 21, 21, 24, 29, 34, 36)
QUALITY = (
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (90, 80, 75, 69, 63, 56, 49, 40, 34, 29, 20, 18, 10, 0, 0, 0, 0, 0, 0, 0, 0),
    (110, 100, 90, 84, 78, 71, 65, 58, 51, 45, 39, 32, 26, 20, 12, 0, 0, 0, 0, 0, 0),
    (118, 110, 103, 93, 86, 80, 75, 70, 65, 59, 53, 47, 40, 31, 23, 15, 4, 0, 0, 0, 0),
    (126, 119, 112, 104, 95, 89, 83, 78, 72, 66, 60, 54, 47, 39, 32, 25, 17, 12, 1, 0, 0),
    (134, 127, 120, 114, 103, 97, 91, 85, 78, 72, 66, 60, 54, 47, 41, 35, 29, 23, 16, 10, 1),
    (144, 137, 130, 124, 113, 107, 101, 95, 88, 82, 76, 70, 64, 57, 51, 45, 39, 33, 26, 15, 1),
    (152, 145, 138, 132, 123, 117, 111, 105, 98, 92, 86, 80, 74, 67, 61, 55, 49, 43, 36, 20, 1),
    (162, 155, 148, 142, 133, 127, 121, 115, 108, 102, 96, 90, 84, 77, 71, 65, 59, 53, 46, 30, 1),
    (172, 165, 158, 152, 143, 137, 131, 125, 118, 112, 106, 100, 94, 87, 81, 75, 69, 63, 56, 45, 20),
    (200, 200, 200, 200, 200, 200, 200, 200, 198, 193, 188, 183, 178, 173, 168, 163, 158, 153, 148, 129, 104),
)
CAPS = (
    (224, 224, 224, 224, 224, 224, 224, 224, 160, 160, 160, 160, 185, 185, 185, 178, 178, 168, 134, 61, 37),
    (224, 224, 224, 224, 224, 224, 224, 224, 240, 240, 240, 240, 207, 207, 207, 198, 198, 183, 144, 66, 40),
    (160, 160, 160, 160, 160, 160, 160, 160, 185, 185, 185, 185, 193, 193, 193, 183, 183, 172, 138, 64, 38),
    (240, 240, 240, 240, 240, 240, 240, 240, 207, 207, 207, 207, 204, 204, 204, 193, 193, 180, 143, 66, 40),
    (185, 185, 185, 185, 185, 185, 185, 185, 193, 193, 193, 193, 193, 193, 193, 183, 183, 172, 138, 65, 39),
    (207, 207, 207, 207, 207, 207, 207, 207, 204, 204, 204, 204, 201, 201, 201, 188, 188, 176, 141, 66, 40),
    (193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 194, 194, 194, 184, 184, 173, 139, 65, 39),
    (204, 204, 204, 204, 204, 204, 204, 204, 201, 201, 201, 201, 198, 198, 198, 187, 187, 175, 140, 66, 40),
)
INTENSITY_COST = (0, 8, 13, 16, 19, 21, 23, 24, 26, 27, 28, 29, 30, 31, 32, 32, 33, 34, 34, 35, 36, 36, 37, 37)

MAX_FINE = 8
FINE_OFFSET, ANGLE_OFFSET, ANGLE_OFFSET_PAIR = 21, 4, 16
MAX_LEVEL = 40


def pulses_of(level: int) -> int:
    """Pulses of a step of the ladder: 0 to 8 one by one, then eight steps an octave."""
    return level if level < 8 else (8 + (level & 7)) << ((level >> 3) - 1)


def _cost(count: int) -> int:
    """Eighths of bits, rounded up, that one of ``count`` equally likely things costs."""
    eighth = 8 * (count.bit_length() - 1)
    while (1 << eighth) < count**8:
        eighth += 1
    return eighth


@lru_cache(maxsize=None)
def ladder(size: int) -> tuple[int, ...]:
    """Costs of the levels 0, 1, ... of a band of ``size`` bins; the last is the most that 32 bits can tell apart."""
    out = [0]
    while len(out) <= MAX_LEVEL and (count := pulse_vectors(size, pulses_of(len(out)))) < 1 << 32:
        out.append(_cost(count))
    return tuple(out)


def part_size(band: int, lm: int) -> int:
    """Bins of a band in frames of 120 << lm; lm -1 is half a band of the shortest frame."""
    return WIDTH[band] << lm if lm >= 0 else WIDTH[band] >> 1


@lru_cache(maxsize=None)
def level_for(size: int, bits: int) -> int:
    """The level whose cost is nearest to the bits (the lower one of equally near ones)."""
    costs = ladder(size)
    low, high = 0, len(costs) - 1
    for _ in range(6):
        middle = (low + high + 1) >> 1
        if costs[middle] >= bits:
            high = middle
        else:
            low = middle
    return low if bits - costs[low] <= costs[high] - bits else high


def caps(lm: int, channels: int) -> list[int]:
    """Most eighths of bits a band may get."""
    return [(CAPS[2 * lm + channels - 1][j] + 64) * channels * (WIDTH[j] << lm) >> 2 for j in range(N_BANDS)]


def multiply_16(a: int, b: int) -> int:
    """Product of two 16-bit fractions, rounded."""
    return (16384 + _short(a) * _short(b)) >> 15


def _short(x: int) -> int:
    return (x + 32768) % 65536 - 32768


def cosine(x: int) -> int:
    """cos of a quarter turn times x / 16384, in 1/32768."""
    square = (4096 + x * x) >> 13
    series = (32767 - square) + multiply_16(square, -7651 + multiply_16(square, 8277 + multiply_16(-626, square)))
    return 1 + series


def log_tangent(sine: int, cos: int) -> int:
    """log2 of their quotient in 1/2048."""

    def fraction(v: int) -> int:
        return multiply_16(v, multiply_16(v, -2597) + 7932)

    n_sine, n_cos = sine.bit_length(), cos.bit_length()
    return (n_sine - n_cos) * 2048 + fraction(sine << (15 - n_sine)) - fraction(cos << (15 - n_cos))


def angle_steps(n: int, bits: int, offset: int, cap: int, stereo: bool) -> int:
    """Into how many steps a split's angle is quantised (even, or 1: not coded)."""
    freedom = 2 * n - 1 - (stereo and n == 2)
    share = min(bits - cap - 32, _toward_zero(bits + freedom * offset, freedom), 64)
    if share < 4:
        return 1
    root = (16384, 17866, 19483, 21247, 23170, 25267, 27554, 30048)[share & 7]  # fixed values: 2 ** (14 + k / 8)
    return ((root >> (14 - (share >> 3))) + 1) >> 1 << 1


def _toward_zero(a: int, b: int) -> int:
    return a // b if a >= 0 else -(-a // b)


def noise_step(seed: int) -> int:
    """The generator of folded and filled noise."""
    return (seed * 1664525 + 1013904223) & 0xFFFFFFFF


def whole_root(value: int) -> int:
    return isqrt(value)


@dataclass
class Allocation:
    """Eighths of bits for shapes, fine energy bits, which bands come first at the end, and what was coded."""

    shape: list[int]
    fine: list[int]
    first: list[bool]
    balance: int
    coded: int
    intensity: int
    dual: bool


def allocate(wire, start: int, end: int, boosts: list[int], cap: list[int], trim: int, total: int, channels: int, lm: int, choice=None) -> Allocation:
    """Shares ``total`` eighths among the bands; ``wire`` codes skips, intensity and dual stereo.

    ``choice`` is the writing side's wish: keep(band, bits, width) whether a band at the top is kept, intensity and dual.
    """
    total = max(total, 0)
    skip_reserve = 8 if total >= 8 else 0
    total -= skip_reserve
    intensity_reserve = dual_reserve = 0
    if channels == 2:
        cost = INTENSITY_COST[end - start]
        if cost <= total:
            intensity_reserve = cost
            total -= cost
            dual_reserve = 8 if total >= 8 else 0
            total -= dual_reserve
    span = range(start, end)
    floor = channels << 3
    least = {j: max(floor, 3 * (WIDTH[j] << lm << 3) >> 4) for j in span}
    tilt = {j: (channels * WIDTH[j] * (trim - 5 - lm) * (end - j - 1) * (1 << (lm + 3)) >> 6) - (floor if WIDTH[j] << lm == 1 else 0) for j in span}

    def wanted(quality: int, j: int) -> int:
        bits = cap[j] if quality >= len(QUALITY) else channels * WIDTH[j] * QUALITY[quality][j] << lm >> 2
        return max(0, bits + tilt[j]) if bits > 0 else bits

    def given(bits_of) -> dict[int, int]:
        """From the top: nothing (or the floor) until a band reaches its least, then all up to the cap."""
        out, reached = {}, False
        for j in reversed(span):
            bits = bits_of(j)
            reached |= bits >= least[j]
            out[j] = min(bits, cap[j]) if reached else (floor if bits >= floor else 0)
        return out

    low, high = 1, len(QUALITY) - 1
    while low <= high:
        middle = (low + high) >> 1
        if sum(given(lambda j: wanted(middle, j) + boosts[j]).values()) > total:  # noqa: B023
            high = middle - 1
        else:
            low = middle + 1
    high, low = low, low - 1
    base, more, skip_start = {}, {}, start
    for j in span:
        base[j], up = wanted(low, j) + (boosts[j] if low > 0 else 0), wanted(high, j) + boosts[j]
        more[j] = max(0, up - base[j])
        if boosts[j] > 0:
            skip_start = j

    at, top = 0, 64
    for _ in range(6):
        middle = (at + top) >> 1
        if sum(given(lambda j: base[j] + (middle * more[j] >> 6)).values()) > total:  # noqa: B023
            top = middle
        else:
            at = middle
    bits = given(lambda j: base[j] + (at * more[j] >> 6))
    used = sum(bits.values())

    coded = end
    while True:
        j = coded - 1
        if j <= skip_start:
            total += skip_reserve
            break
        spread = BAND_EDGES[coded] - BAND_EDGES[start]
        each, left = divmod(total - used, spread)
        rest = max(left - (BAND_EDGES[j] - BAND_EDGES[start]), 0)
        width = WIDTH[j]
        here = bits[j] + each * width + rest
        if here >= max(least[j], floor + 8):
            if wire.bit(choice is None or choice.keep(j, here, width), 1):
                break
            used += 8
            here -= 8
        used -= bits[j] + intensity_reserve
        if intensity_reserve > 0:
            intensity_reserve = INTENSITY_COST[j - start]
        used += intensity_reserve
        bits[j] = floor if here >= floor else 0
        used += bits[j]
        coded = j

    intensity, dual = 0, False
    if intensity_reserve > 0:
        intensity = start + wire.uniform(min(max(choice.intensity, start), coded) - start if choice else 0, coded + 1 - start)
    if intensity <= start:
        total += dual_reserve
        dual_reserve = 0
    if dual_reserve > 0:
        dual = bool(wire.bit(bool(choice and choice.dual), 1))

    each, left = divmod(total - used, BAND_EDGES[coded] - BAND_EDGES[start])
    for j in range(start, coded):
        bits[j] += each * WIDTH[j]
    for j in range(start, coded):
        extra = min(left, WIDTH[j])
        bits[j] += extra
        left -= extra

    fine, first, balance = [0] * N_BANDS, [False] * N_BANDS, 0
    stereo = channels - 1
    for j in range(start, coded):
        n = WIDTH[j] << lm
        have = bits[j] + balance
        if n > 1:
            excess = max(have - cap[j], 0)
            bits[j] = have - excess
            freedom = channels * n + (channels == 2 and n > 2 and not dual and j < intensity)
            log = freedom * (LOG_WIDTH[j] + (lm << 3))
            offset = (log >> 1) - freedom * FINE_OFFSET + (freedom << 1 if n == 2 else 0)
            if bits[j] + offset < freedom << 4:
                offset += log >> 2
            elif bits[j] + offset < freedom * 24:
                offset += log >> 3
            fine[j] = max(0, bits[j] + offset + (freedom << 2)) // freedom >> 3
            if channels * fine[j] > bits[j] >> 3:
                fine[j] = bits[j] >> stereo >> 3
            fine[j] = min(fine[j], MAX_FINE)
            first[j] = fine[j] * (freedom << 3) >= bits[j] + offset
            bits[j] -= channels * fine[j] << 3
        else:
            excess = max(0, have - floor)
            bits[j] = have - excess
            fine[j], first[j] = 0, True
        if excess > 0:
            extra = min(excess >> (stereo + 3), MAX_FINE - fine[j])
            fine[j] += extra
            first[j] = extra * channels << 3 >= excess - balance
            excess -= extra * channels << 3
        balance = excess
    for j in range(coded, end):
        fine[j] = bits[j] >> stereo >> 3
        first[j] = fine[j] < 1
        bits[j] = 0
    return Allocation([bits.get(j, 0) for j in range(N_BANDS)], fine, first, balance, coded, intensity, dual)
