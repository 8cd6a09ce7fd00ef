"""Range coder, Laplace symbols and pulse-vector indices (RFC 6716, sections 4.1, 4.3 and 5.1).

The encoder keeps its low end as one integer of any size instead of passing
carries along bytes; packets are short, so this is both simple and exact. The
decoder follows the RFC's 32-bit registers; after each symbol both sides hold
the same range, which is what ``final_range`` shows.
"""

from __future__ import annotations

from functools import lru_cache

TOP, BOTTOM = 1 << 31, 1 << 23
RAW_LIMIT = 8  # larger uniform numbers send their low bits raw

LAPLACE_TOTAL, LAPLACE_LEAST, LAPLACE_GUARD = 1 << 15, 1, 16


class BudgetError(ValueError):
    """The packet has no room for what was coded."""


class Encoder:
    def __init__(self, size: int):
        """A packet of ``size`` bytes."""
        self.size = size
        self.low, self.range, self.shifts = 0, TOP, 0
        self.raw, self.raw_bits = 0, 0

    def tell(self) -> int:
        """Bits used so far, rounded up."""
        return 33 + 8 * self.shifts + self.raw_bits - self.range.bit_length()

    def tell_eighths(self) -> int:
        return _eighths(33 + 8 * self.shifts + self.raw_bits, self.range)

    def _narrow(self, skip: int, width: int) -> None:
        self.low += skip
        self.range = width
        while self.range <= BOTTOM:
            self.range <<= 8
            self.low <<= 8
            self.shifts += 1

    def symbol(self, first: int, stop: int, total: int) -> None:
        """A symbol that owns [first, stop) of ``total``."""
        part = self.range // total
        if first:
            self._narrow(self.range - part * (total - first), part * (stop - first))
        else:
            self._narrow(0, self.range - part * (total - stop))

    def bit(self, value: bool, log_odds: int) -> None:
        """A bit that is 1 with chance 2 ** -log_odds."""
        one = self.range >> log_odds
        self._narrow(self.range - one, one) if value else self._narrow(0, self.range - one)

    def from_table(self, value: int, falling: list[int], bits: int) -> None:
        """A symbol of a table of 2 ** bits minus cumulated frequencies."""
        total = 1 << bits
        self.symbol(total - falling[value - 1] if value else 0, total - falling[value], total)

    def raw_number(self, value: int, bits: int) -> None:
        self.raw |= value << self.raw_bits
        self.raw_bits += bits

    def uniform(self, value: int, total: int) -> None:
        """One of ``total`` equally likely numbers."""
        low_bits = max(0, (total - 1).bit_length() - RAW_LIMIT)
        if total > 1:
            self.symbol(value >> low_bits, (value >> low_bits) + 1, ((total - 1) >> low_bits) + 1)
        if low_bits:
            self.raw_number(value & ((1 << low_bits) - 1), low_bits)

    def finish(self) -> bytes:
        """The packet: the shortest number inside the last interval, raw bits from the end."""
        keep = 32 - self.range.bit_length()
        while True:
            mask = (TOP - 1) >> keep
            end = (self.low + mask) & ~mask
            if end | mask < self.low + self.range:
                break
            keep += 1
        front_bits = 8 * self.shifts + keep
        front = (end << 1).to_bytes(4 + self.shifts + 1, "big")[1:] if end.bit_length() <= 31 + 8 * self.shifts else None
        if front is None:
            raise AssertionError("the low end left its interval")
        n_front = -(-front_bits // 8)
        n_back = -(-self.raw_bits // 8)
        if front_bits + self.raw_bits > 8 * self.size:
            raise BudgetError(f"{front_bits + self.raw_bits} bits don't fit in {self.size} bytes")
        out = bytearray(self.size)
        out[: min(n_front, self.size)] = front[: min(n_front, self.size)]
        back = self.raw.to_bytes(n_back, "little")
        for k, b in enumerate(back):
            out[self.size - 1 - k] |= b
        return bytes(out)


class Decoder:
    def __init__(self, data: bytes):
        """Bytes past the end read as zero, so no input is an error."""
        self.data, self.at = data, 0
        self.back_bits = 0
        self.raw = int.from_bytes(data[::-1], "big") if data else 0
        self.total_bits = 9
        self.range = 128
        self.rest = self._byte()
        self.value = 127 - (self.rest >> 1)
        self._fill()

    def _byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def _fill(self) -> None:
        while self.range <= BOTTOM:
            self.range <<= 8
            self.total_bits += 8
            sym, self.rest = self.rest, self._byte()
            sym = ((sym << 8) | self.rest) >> 1
            self.value = ((self.value << 8) + (255 & ~sym)) & (TOP - 1)

    def tell(self) -> int:
        return self.total_bits - self.range.bit_length()

    def tell_eighths(self) -> int:
        return _eighths(self.total_bits, self.range)

    def where(self, total: int) -> int:
        """The place of the next symbol in [0, total); ``take`` must follow."""
        self.part = self.range // total
        return total - min(self.value // self.part + 1, total)

    def shrink(self, size: int) -> None:
        """The packet ends after ``size`` bytes: raw bits are read from there."""
        self.data = self.data[:size]

    def take(self, first: int, stop: int, total: int) -> None:
        over = self.part * (total - stop)
        self.value -= over
        self.range = self.part * (stop - first) if first else self.range - over
        self._fill()

    def bit(self, log_odds: int) -> bool:
        one = self.range >> log_odds
        hit = self.value < one
        if hit:
            self.range = one
        else:
            self.value -= one
            self.range -= one
        self._fill()
        return hit

    def from_table(self, falling: list[int], bits: int) -> int:
        total = 1 << bits
        place, k = self.where(total), 0
        while total - falling[k] <= place:
            k += 1
        self.take(total - falling[k - 1] if k else 0, total - falling[k], total)
        return k

    def raw_number(self, bits: int) -> int:
        # Raw bits are read from the last byte on, low bits first.
        out = 0
        for k in range(bits):
            at = self.back_bits + k
            byte = len(self.data) - 1 - at // 8
            out |= ((self.data[byte] >> (at % 8)) & 1 if byte >= 0 else 0) << k
        self.back_bits += bits
        self.total_bits += bits
        return out

    def uniform(self, total: int) -> int:
        """A number below ``total``; a corrupt one is the largest."""
        low_bits = max(0, (total - 1).bit_length() - RAW_LIMIT)
        high = 0
        if total > 1:
            parts = ((total - 1) >> low_bits) + 1
            high = self.where(parts)
            self.take(high, high + 1, parts)
        return min(high << low_bits | (self.raw_number(low_bits) if low_bits else 0), total - 1)


def _eighths(bits: int, rng: int) -> int:
    """Bits used in eighths: the logarithm of the range by repeated squaring."""
    length = rng.bit_length()
    r, log = rng >> (length - 16), length
    for _ in range(3):
        r = r * r >> 15
        up = r >> 16
        log = 2 * log + up
        r >>= up
    return bits * 8 - log


def laplace_cells(value: int, centre: int, decay: int) -> tuple[int, int, int]:
    """(first, stop, coded value) in 2**15 of a Laplace-distributed number; far values are clamped."""
    size = abs(value)
    if not size:
        return 0, centre, 0
    first, width, k = centre, _next_width(centre, decay), 1
    while k < size and width > 0:
        first += 2 * (width + LAPLACE_LEAST)
        width = width * decay >> 15
        k += 1
    if width <= 0:  # the tail: cells of the least width
        room = (LAPLACE_TOTAL - first + LAPLACE_LEAST - 1) // LAPLACE_LEAST
        steps = min(size - k, (room - (value < 0)) // 2 - 1 if value < 0 else (room - 1) // 2)
        first += 2 * steps * LAPLACE_LEAST
        k, width = k + steps, 0
    cell = width + LAPLACE_LEAST
    if value > 0:
        first += cell
    return first, min(first + cell, LAPLACE_TOTAL), k if value > 0 else -k


def _next_width(centre: int, decay: int) -> int:
    return (LAPLACE_TOTAL - LAPLACE_LEAST * 2 * LAPLACE_GUARD - centre) * (16384 - decay) >> 15


def encode_laplace(enc: Encoder, value: int, centre: int, decay: int) -> int:
    """Codes a number, or the nearest that has a cell; returns what was coded."""
    first, stop, coded = laplace_cells(value, centre, decay)
    enc.symbol(first, stop, LAPLACE_TOTAL)
    return coded


def decode_laplace(dec: Decoder, centre: int, decay: int) -> int:
    place = dec.where(LAPLACE_TOTAL)
    if place < centre:
        dec.take(0, centre, LAPLACE_TOTAL)
        return 0
    first, width, k = centre, _next_width(centre, decay), 1
    while width > 0 and place >= first + 2 * (width + LAPLACE_LEAST):
        first += 2 * (width + LAPLACE_LEAST)
        width = width * decay >> 15
        k += 1
    if width <= 0:
        steps = (place - first) // (2 * LAPLACE_LEAST)
        k, first, width = k + steps, first + 2 * steps * LAPLACE_LEAST, 0
    cell = width + LAPLACE_LEAST
    positive = place >= first + cell
    first += cell * positive
    dec.take(first, min(first + cell, LAPLACE_TOTAL), LAPLACE_TOTAL)
    return k if positive else -k


@lru_cache(maxsize=None)
def pulse_vectors(n: int, k: int) -> int:
    """How many integer vectors of length n have absolute values that add up to k."""
    if k == 0:
        return 1
    if n == 0:
        return 0
    return pulse_vectors(n - 1, k) + pulse_vectors(n, k - 1) + pulse_vectors(n - 1, k - 1)


def pulse_index(vector: list[int]) -> int:
    """The vector's place among all with its length and sum."""
    left, out = sum(map(abs, vector)), 0
    for j, x in enumerate(vector):
        n = len(vector) - j
        half = (pulse_vectors(n - 1, left) + pulse_vectors(n, left)) // 2
        out += half if x < 0 else 0
        out += half - sum(pulse_vectors(n - 1, left - t) for t in range(abs(x) + 1))
        left -= abs(x)
    return out


def pulse_vector(index: int, n: int, k: int) -> list[int]:
    """The inverse of ``pulse_index``."""
    out = []
    for j in range(n):
        rest = n - j - 1
        p = (pulse_vectors(rest, k) + pulse_vectors(rest + 1, k)) // 2
        negative = index >= p
        index -= p if negative else 0
        p -= pulse_vectors(rest, k)
        used = 0
        while p > index:
            used += 1
            p -= pulse_vectors(rest, k - used)
        out.append(-used if negative else used)
        index -= p
        k -= used
    return out


def encode_pulses(enc: Encoder, vector: list[int]) -> None:
    enc.uniform(pulse_index(vector), pulse_vectors(len(vector), sum(map(abs, vector))))


def decode_pulses(dec: Decoder, n: int, k: int) -> list[int]:
    return pulse_vector(dec.uniform(pulse_vectors(n, k)), n, k)
