"""Fixed-point arithmetic of the speech and transform layers as Columns.

Values are longs that hold 32-bit numbers; ``wrap`` brings a result back into
32 bits as machine arithmetic does. Nulls stay null. All of it is SQL
functions, so it runs inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 31
HIGHEST = TOP - 1


def _shift(x: Column, by: Column | int, name: str = "shiftright") -> Column:
    return F.call_function(name, x, by.cast("int") if isinstance(by, Column) else F.lit(by))


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def wrap(x: Column, bits: int = 32) -> Column:
    half = 1 << (bits - 1)
    return F.pmod(x + F.lit(half), F.lit(2 * half)) - F.lit(half)


def clamp(x: Column, low: int | Column, high: int | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low) if isinstance(low, int) else low), F.lit(high) if isinstance(high, int) else high)


def low(x: Column) -> Column:
    """The signed lower half."""
    return wrap(x, 16)


def high(x: Column) -> Column:
    """The signed upper half."""
    return _shift(x, 16)


def unsigned(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


# Products


def word_by_low(a: Column, b: Column) -> Column:
    """a times b's lower half, in 1/65536."""
    return _shift(a * low(b), 16)


def add_word_by_low(a: Column, b: Column, c: Column) -> Column:
    return wrap(a + wrap(word_by_low(b, c)))


def add_word_by_high(a: Column, b: Column, c: Column) -> Column:
    return wrap(a + wrap(_shift(b * high(c), 16)))


def low_by_low(a: Column, b: Column) -> Column:
    return low(a) * low(b)


def add_low_by_low(a: Column, b: Column, c: Column) -> Column:
    return wrap(a + low_by_low(b, c))


def high_by_high(a: Column, b: Column) -> Column:
    return wrap(high(a) * high(b))


def words(a: Column, b: Column) -> Column:
    """The product in 1/65536."""
    return wrap(_shift(a * b, 16))


def add_words(a: Column, b: Column, c: Column) -> Column:
    return wrap(a + _shift(b * c, 16))


def top_of_words(a: Column, b: Column) -> Column:
    return _shift(a * b, 32)


def fractions(a: Column, b: Column) -> Column:
    """Product of two 16-bit fractions, rounded."""
    return _shift(low(a) * low(b) + 16384, 15)


# Saturation, shifts, bits


def add_capped(a: Column, b: Column, bits: int = 32) -> Column:
    half = 1 << (bits - 1)
    return clamp(a + b, -half, half - 1)


def subtract_capped(a: Column, b: Column) -> Column:
    return clamp(a - b, -TOP, HIGHEST)


def left_capped(a: Column, by: Column) -> Column:
    return clamp(a, _shift(F.lit(-TOP), by), _shift(F.lit(HIGHEST), by)) * _power(by)


def right_rounded(a: Column, by: Column) -> Column:
    """Shift by one or more, halves up."""
    return _shift(_shift(a, by - 1) + 1, 1)


def add_right_unsigned(a: Column, b: Column, by: Column) -> Column:
    return unsigned(unsigned(a) + _shift(unsigned(b), by))


def rotated_right(a: Column, by: Column) -> Column:
    """By any number of bits; negative ones to the left."""
    n, u = F.pmod(by, F.lit(32)), unsigned(a)
    return wrap(F.pmod(u, _power(n)) * _power(F.lit(32) - n) + _shift(u, n))


def leading_zeros(a: Column) -> Column:
    u = unsigned(a)
    return (F.lit(32) - F.when(u == 0, 0).otherwise(F.length(F.bin(u)))).cast("long")


def leading_fraction(a: Column) -> Column:
    """The seven bits behind the leading one."""
    return rotated_right(a, F.lit(24) - leading_zeros(a)).bitwiseAND(127)


# Approximations


def root(x: Column) -> Column:
    """The square root, roughly; 0 for what is not positive."""
    zeros = leading_zeros(x)
    y = _shift(F.when(zeros.bitwiseAND(1) == 1, 32768).otherwise(46214).cast("long"), _shift(zeros, 1))
    return F.when(x <= 0, F.lit(0).cast("long")).otherwise(add_word_by_low(y, y, leading_fraction(x) * 213))


def log2(x: Column) -> Column:
    """128 times the logarithm of a positive number: a parabola between powers of two."""
    part = leading_fraction(x)
    return add_word_by_low(part, part * (F.lit(128) - part), F.lit(179).cast("long")) + (F.lit(31) - leading_zeros(x)) * 128


def power2(x: Column) -> Column:
    """The inverse of ``log2``; negative numbers give 0, large ones the largest."""
    inside = clamp(x, 0, 3966)
    whole, part = _power(_shift(inside, 7)), inside.bitwiseAND(127)
    bend = part + _shift(part * (F.lit(128) - part) * -174, 16)
    value = F.when(inside < 2048, whole + _shift(whole * bend, 7)).otherwise(whole + _shift(whole, 7) * bend)
    return F.when(x < 0, F.lit(0).cast("long")).when(x >= 3967, F.lit(HIGHEST).cast("long")).otherwise(value)


def _normal(x: Column) -> tuple[Column, Column]:
    room = leading_zeros(F.abs(x)) - 1
    return room, x * _power(room)


def _placed(x: Column, by: Column) -> Column:
    return F.when(by <= 0, left_capped(x, F.greatest(-by, F.lit(0)))).when(by < 32, _shift(x, clamp(by, 0, 31))).otherwise(F.lit(0).cast("long"))


def _inverse(normal: Column) -> Column:
    """2 ** 29 over the upper half, toward zero."""
    half = high(normal)
    return F.sign(half).cast("long") * F.floor(F.lit(HIGHEST >> 2) / F.abs(half)).cast("long")


def reciprocal(b: Column, q: Column) -> Column:
    """2 ** q / b, for b not 0, to some 30 bits."""
    room, normal = _normal(b)
    inverse = _inverse(normal)
    error = wrap((F.lit(1 << 29) - word_by_low(normal, inverse)) * 8)
    return _placed(add_words(wrap(inverse * 65536), error, inverse), F.lit(61) - room - q)


def quotient(a: Column, b: Column, q: Column) -> Column:
    """2 ** q * a / b, for a and b not 0, to some 30 bits."""
    room_a, normal_a = _normal(a)
    room_b, normal_b = _normal(b)
    inverse = _inverse(normal_b)
    first = word_by_low(normal_a, inverse)
    rest = wrap(normal_a - wrap(top_of_words(normal_b, first) * 8))
    return _placed(add_word_by_low(first, rest, inverse), F.lit(29) + room_a - room_b - q)


# Transform layer


def cosine(x: Column) -> Column:
    """cos of a quarter turn times x / 16384, in 1/32768."""
    square = _shift(x * x + 4096, 13)
    return F.lit(1) + (F.lit(32767) - square) + fractions(square, F.lit(-7651) + fractions(square, F.lit(8277) + fractions(F.lit(-626).cast("long"), square)))


def log_tangent(sine: Column, cos: Column) -> Column:
    """log2 of their quotient in 1/2048, for positive numbers below 32768."""

    def bits(v: Column) -> Column:
        return F.length(F.bin(v)).cast("long")

    def fraction(v: Column) -> Column:
        v = v * _power(F.lit(15) - bits(v))
        return fractions(v, fractions(v, F.lit(-2597).cast("long")) + 7932)

    return (bits(sine) - bits(cos)) * 2048 + fraction(sine) - fraction(cos)


def noise_step(seed: Column) -> Column:
    """The generator of noise: seed * 1664525 + 1013904223 in 32 bits."""
    return unsigned(unsigned(seed) * 1664525 + 1013904223)


def whole_root(x: Column) -> Column:
    """The whole part of the square root of a number below 2 ** 32."""
    guess = F.floor(F.sqrt(x.cast("double"))).cast("long")
    return F.when(guess * guess > x, guess - 1).when((guess + 1) * (guess + 1) <= x, guess + 1).otherwise(guess)


def angle_steps(n: Column, bits: Column, offset: Column, cap: Column, stereo: Column) -> Column:
    """Steps of a split's angle: even, or 1 where the budget is too small."""
    freedom = n * 2 - 1 - F.when(stereo & (n == 2), 1).otherwise(0)
    wanted = bits + freedom * offset
    share = F.least(bits - cap - 32, F.sign(wanted).cast("long") * F.floor(F.abs(wanted) / freedom).cast("long"), F.lit(64))
    roots = F.array(*[F.lit(v).cast("long") for v in (16384, 17866, 19483, 21247, 23170, 25267, 27554, 30048)])  # fixed values: 2 ** (14 + k / 8)
    kept = F.greatest(share, F.lit(0))
    steps = _shift(_shift(F.element_at(roots, (kept.bitwiseAND(7) + 1).cast("int")), F.lit(14) - _shift(kept, 3)) + 1, 1) * 2
    return F.when(share < 4, F.lit(1).cast("long")).otherwise(steps)


# Speech layer


def sigmoid(x: Column) -> Column:
    """32768 over 1 + exp(-x / 32), in six straight pieces to either side."""
    slopes = F.array(*[F.lit(v).cast("long") for v in (237, 153, 73, 30, 12, 7)])  # fixed values: slopes and the pieces' starts
    above = F.array(*[F.lit(v).cast("long") for v in (16384, 23955, 28861, 31213, 32178, 32548)])
    below = F.array(*[F.lit(v).cast("long") for v in (16384, 8812, 3906, 1554, 589, 219)])
    size = F.least(F.abs(x), F.lit(191))
    place, rest = (_shift(size, 5) + 1).cast("int"), size.bitwiseAND(31)
    step = F.element_at(slopes, place) * rest
    return F.when(x >= 192, 32767).when(x <= -192, 0).when(x < 0, F.element_at(below, place) - step).otherwise(F.element_at(above, place) + step).cast("long")


def energy_and_shift(x: Column) -> Column:
    """struct<energy, shift>: the sum of squares of 16-bit samples, shifted right until it leaves two bits of 32 free."""
    squares = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long"))
    need = F.greatest(F.lit(0), F.when(squares > 0, F.length(F.bin(squares))).otherwise(0) - 30).cast("int")
    return F.struct(F.call_function("shiftright", squares, need).alias("energy"), need.alias("shift"))
