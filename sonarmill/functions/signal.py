"""Signal functions over ``array<float>`` or ``array<double>`` columns.

Folds go through higher-order functions from the first sample to the last, in
double precision, so results don't depend on how rows are dealt. An empty or null
array gives null unless a function says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.aggregate(_d(x), F.lit(0.0), lambda a, v: a + v))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(_d(x), _d(y), lambda a, b: a * b))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places by scaling, halves away from zero, as SQL engines round doubles: what vanishes from below is -0.0."""
    scaled = x * 10.0**digits
    near = F.rint(scaled)  # a half goes to the even side
    off = scaled - near
    whole = F.when((F.abs(off) == 0.5) & (off * scaled > 0), near + F.signum(scaled)).otherwise(near)
    return F.when(F.abs(whole) < float("inf"), whole / 10.0**digits).otherwise(x)


def energy(x: Column) -> Column:
    """Mean square."""
    return total(F.transform(_d(x), lambda v: v * v)) / F.size(x)


def lagged_product(x: Column, lag: int | Column) -> Column:
    """Sum of x[n] * x[n - lag]; 0 where the signal is not longer than the lag."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    wide = _d(x)
    tail = F.slice(wide, lag + 1, F.greatest(F.size(x) - lag, F.lit(0)))
    return F.aggregate(F.zip_with(tail, F.slice(wide, 1, F.greatest(F.size(x) - lag, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def autocorrelation(x: Column, order: int) -> Column:
    """Lags 0 to ``order``."""
    return F.array(*[lagged_product(x, k) for k in range(order + 1)])


def zero_crossings(x: Column) -> Column:
    """How often the sign changes; zero counts as positive."""
    sign = F.transform(_d(x), lambda v: v >= 0)
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(sign, 2, n), F.slice(sign, 1, n), lambda a, b: a != b), lambda c: c))


def lag1_correlation(x: Column) -> Column:
    """Lag-1 product over the energy of all samples but the first, within [-1, 1]."""
    r0 = total(F.transform(F.slice(_d(x), 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda v: v * v))
    return F.when(r0 > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lagged_product(x, 1) / r0))).otherwise(F.lit(0.0))


def to_int16(x: Column) -> Column:
    """Scaled by 32768, clamped, ties to even."""
    return F.transform(_d(x), lambda v: F.bround(F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), v * 32768.0)), 0).cast("int"))


def from_int16(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") / 32768.0)


def to_bytes(pcm: Column) -> Column:
    """16-bit samples as bytes, low byte first."""
    word = lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(65536))), 4, "0")
    return F.unhex(F.array_join(F.transform(pcm, lambda v: F.concat(F.substring(word(v), 3, 2), F.substring(word(v), 1, 2))), ""))


def from_bytes(data: Column) -> Column:
    """16-bit samples of bytes, low byte first; an odd last byte is left out."""
    hexed, n = F.hex(data), F.floor(F.length(data) / 2).cast("int")
    value = lambda k: F.conv(F.concat(F.substring(hexed, 4 * k + 3, F.lit(2)), F.substring(hexed, 4 * k + 1, F.lit(2))), 16, 10).cast("int")
    signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: signed(value(k)))).otherwise(F.when(data.isNotNull(), F.array().cast("array<int>")))


def projection(x: Column, hz: float, rate: float = 48000.0) -> Column:
    """struct<cos, sin, amplitude, snr_db>: the sine of one frequency that fits best, and what it leaves."""
    wide, n = _d(x), F.size(x).cast("double")
    step = 2 * math.pi * hz / rate
    a = total(F.transform(wide, lambda v, k: v * F.cos(k * F.lit(step)))) * 2 / n
    b = total(F.transform(wide, lambda v, k: v * F.sin(k * F.lit(step)))) * 2 / n
    fit = F.transform(wide, lambda v, k: a * F.cos(k * F.lit(step)) + b * F.sin(k * F.lit(step)))
    rest = F.zip_with(wide, fit, lambda v, f: (v - f) * (v - f))
    return F.struct(a.alias("cos"), b.alias("sin"), F.sqrt(a * a + b * b).alias("amplitude"), (F.lit(10.0) * F.log10(total(F.transform(fit, lambda f: f * f)) / total(rest))).alias("snr_db"))


def downmix(x: Column) -> Column:
    """Interleaved stereo to mono: the mean of each pair."""
    wide = _d(x)
    return F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), lambda k: (F.get(wide, 2 * k) + F.get(wide, 2 * k + 1)) * 0.5)


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))


def gain(x: Column, gain_q8: Column) -> Column:
    """Scaled by 10 ** (q8 / 5120): a gain in 1/256 dB."""
    return F.transform(_d(x), lambda v: v * F.pow(F.lit(10.0), gain_q8 / 5120.0))


def trimmed(x: Column, skip: Column, keep: Column) -> Column:
    """``keep`` samples after ``skip``."""
    return F.slice(x, skip + 1, F.greatest(keep, F.lit(0)))


def ltp_residual(x: Column, lag: int, tap: float) -> Column:
    """x[n] - tap * x[n - lag]; samples before the start are 0."""
    wide = _d(x)
    return F.transform(wide, lambda v, n: v - F.when(n >= lag, tap * F.get(wide, n - lag)).otherwise(0.0))


def ltp_synthesis(x: Column, lag: int, tap: float) -> Column:
    """The inverse of ``ltp_residual``."""
    step = lambda done, v: F.concat(done, F.array(v + F.when(F.size(done) >= lag, tap * F.get(done, F.size(done) - lag)).otherwise(0.0)))
    return F.aggregate(_d(x), F.array().cast("array<double>"), step)


def one_pole(x: Column, coef: float) -> Column:
    """y += coef * (x - y), from 0, as an array. Runs over Arrow batches: SQL's folds would copy the array at every sample."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([None if v is None else low_passed(np.asarray(v, float), coef).tolist() for v in series], dtype=object)

    return run.asNondeterministic()(_d(x))


def low_passed(x: np.ndarray, coef: float, last: float = 0.0, piece: int = 128) -> np.ndarray:
    """The recursion from ``last`` on as a product with a triangle of powers, piece by piece."""
    out, keep = np.empty(len(x)), 1.0 - coef
    k = np.arange(min(piece, max(len(x), 1)))
    triangle = np.tril(coef * keep ** np.maximum(k[:, None] - k, 0))
    for a in range(0, len(x), piece):
        part = x[a : a + piece]
        n = len(part)
        out[a : a + n] = triangle[:n, :n] @ part + last * keep ** (k[:n] + 1)
        last = out[a + n - 1]
    return out


def high_pass(x: Column, coef: float) -> Column:
    """x[n] - m, then m moves by coef toward x[n]: what a one-pole low-pass leaves."""
    low = F.concat(F.array(F.lit(0.0)), one_pole(x, coef))
    return F.zip_with(_d(x), F.slice(low, 1, F.size(x)), lambda v, m: v - m)


def cross_fade(old: Column, new: Column) -> Column:
    """From old to new under the square of a power-complementary sine window."""
    n = F.size(old)

    def weight(k: Column) -> Column:
        inner = F.sin(F.lit(1.5707963267948966) * (k + 0.5) / n)
        w = F.sin(F.lit(1.5707963267948966) * inner * inner)
        return w * w

    pairs = F.arrays_zip(_d(old).alias("a"), _d(new).alias("b"))
    return F.transform(pairs, lambda p, k: (1 - weight(k)) * p["a"] + weight(k) * p["b"])


def normalised_lag(x: Column, lag: int | Column) -> Column:
    """Lagged product over the root of the lagged signal's energy; 0 for a silent past."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    past = F.slice(_d(x), 1, F.greatest(F.size(x) - lag, F.lit(0)))
    norm = F.aggregate(F.transform(past, lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    return F.when(norm > 0, lagged_product(x, lag) / F.sqrt(norm)).otherwise(F.lit(0.0))


def pitch_lag(x: Column, lo: int, hi: int) -> Column:
    """The lag in [lo, hi] with the largest normalised product; ties go to the smallest, silence to ``lo``."""
    top = F.least(F.lit(hi), F.size(x) - 1)
    scored = F.transform(F.sequence(F.lit(lo), F.greatest(top, F.lit(lo))), lambda k: F.struct(normalised_lag(x, k).alias("c"), (-k).alias("k")))
    return F.when(energy(x) == 0, F.lit(lo)).otherwise(-F.array_max(scored)["k"])


def median_of(values: list[Column]) -> Column:
    """The middle of an odd number of columns."""
    return F.get(F.array_sort(F.array(*values)), len(values) // 2)


def snr_db(signal: Column, decoded: Column) -> Column:
    """10 log10 of signal energy over error energy; null if there is no error."""
    error = total(F.zip_with(_d(signal), _d(decoded), lambda a, b: (a - b) * (a - b)))
    return F.when(error > 0, 10 * F.log10(total(F.transform(_d(signal), lambda v: v * v)) / error))
