"""Frame analysis: energy, band energies, tilt and zero crossings to a bandwidth and a music score.

The recursive low-passes are one fold with a struct of states, so a frame is
swept once on the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarmill.functions import signal
from sonarmill.functions.packet import BANDWIDTHS, bandwidth_rank

#: Band edges in Hz, and the share of energy above an edge that makes a band count.
EDGES = (4000.0, 6000.0, 8000.0, 12000.0)
BAND_SHARE = 0.02
RATE = 48000.0

#: Fixed values: (bits a second and channel, of these for the speech layer) of the hybrid split.
HYBRID_SPLIT = ((0, 0), (12000, 10000), (16000, 13500), (20000, 16000), (24000, 18000), (32000, 22000), (64000, 38000))
#: Bit rates from which each bandwidth is affordable.
AFFORDABLE = ((11000, "narrow"), (14000, "medium"), (24000, "wide"), (42000, "superwide"))


def pole(hz: float) -> float:
    dt, rc = 1 / RATE, 1 / (2 * math.pi * hz)
    return dt / (rc + dt)


def band_energies(x: Column) -> Column:
    """struct<e0..e3>: mean squares behind the four low-passes."""
    poles = [pole(f) for f in EDGES]
    zero = F.struct(*[F.lit(0.0).alias(f"{n}{k}") for k in range(4) for n in "ye"])

    def step(s: Column, v: Column) -> Column:
        ys = [s[f"y{k}"] + p * (v - s[f"y{k}"]) for k, p in enumerate(poles)]
        return F.struct(*[c for k in range(4) for c in (ys[k].alias(f"y{k}"), (s[f"e{k}"] + ys[k] * ys[k]).alias(f"e{k}"))])

    return F.aggregate(x.cast("array<double>"), zero, step, lambda s: F.struct(*[F.try_divide(s[f"e{k}"], F.size(x)).alias(f"e{k}") for k in range(4)]))


def features(x: Column) -> Column:
    """struct<energy, music, bandwidth> of a mono 48 kHz frame; an empty frame is undecided (0.5), full and silent.

    The sums over samples stand in an array of one, so that each is computed once.
    """
    sums = F.struct(
        band_energies(x).alias("low"),
        signal.energy(x).alias("energy"),
        F.try_divide(signal.zero_crossings(x), F.size(x)).alias("crossings"),
        signal.lag1_correlation(x).alias("tilt"),
        F.size(x).alias("n"),
    )
    return F.get(F.transform(F.array(sums), _judged), 0)


def _judged(s: Column) -> Column:
    whole = F.greatest(s["energy"], F.lit(1e-12))
    low_e = [s["low"][f"e{k}"] for k in range(4)]
    bands = [low_e[0], *[F.greatest(low_e[k] - low_e[k - 1], F.lit(0.0)) for k in (1, 2, 3)], F.greatest(whole - low_e[3], F.lit(0.0))]
    share = [b / whole for b in bands]
    high = share[3] + share[4]
    music = 0.5 + 1.6 * high + 2.0 * share[4] - 0.5 * share[0]
    music = music - F.when((s["tilt"] > 0.9) & (s["crossings"] < 0.1) & (high < 0.05), 0.2).otherwise(0.0)
    music = music + F.when((s["crossings"] > 0.25) & (high > 0.1), 0.2).otherwise(0.0)
    band = F.when(share[4] > BAND_SHARE, "full").when(share[3] > BAND_SHARE, "superwide").when(share[2] > BAND_SHARE, "wide").when(share[1] > BAND_SHARE, "medium").otherwise("narrow")
    empty = s["n"] == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(s["energy"]).alias("energy"),
        F.when(empty, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), music))).alias("music"),
        F.when(empty, "full").otherwise(band).alias("bandwidth"),
    )


def speech_rate(rate: Column, superwide: Column, channels: Column | int = 1) -> Column:
    """Bits a second of the hybrid speech layer: a piecewise-linear table, integer steps, half of what exceeds it."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    each = F.floor(rate / channels)
    out = None
    for (x0, y0), (x1, y1) in zip(HYBRID_SPLIT[:-1], HYBRID_SPLIT[1:], strict=True):
        here = F.floor((y0 * (x1 - each) + y1 * (each - x0)) / (x1 - x0))
        out = F.when(each < x1, here) if out is None else out.when(each < x1, here)
    last_x, last_y = HYBRID_SPLIT[-1]
    out = out.otherwise(last_y + F.floor((each - last_x) / 2))
    return ((out + F.when(superwide, 300).otherwise(0)) * channels).cast("long")


def affordable_bandwidth(rate: Column) -> Column:
    """The widest band a bit rate can fill; no rate affords all."""
    out = None
    for limit, name in AFFORDABLE:
        out = F.when(rate < limit, name) if out is None else out.when(rate < limit, name)
    return out.otherwise("full")


def auto_bandwidth(detected: Column, rate: Column, cap: str = "full") -> Column:
    """The narrowest of what the signal fills, the rate affords and the caller allows."""
    rank = F.least(bandwidth_rank(detected), bandwidth_rank(affordable_bandwidth(rate)), F.lit(BANDWIDTHS.index(cap)))
    return F.get(F.array(*map(F.lit, BANDWIDTHS)), rank)


def chosen_mode(music: Column, band: Column, rate: Column, hint: str = "auto", application: str = "audio") -> Column:
    """speech, hybrid or transform for a smoothed music score, a bandwidth and a bit rate (null: none set)."""
    if application == "low_delay":
        return F.lit("transform")
    shift = {"voice": -0.35, "music": 0.35, "auto": 0.0}[hint] - (0.2 if application == "voip" else 0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), music + shift))
    low = bandwidth_rank(band) <= BANDWIDTHS.index("wide")
    backbone = F.when(low & (rate <= 24000), "speech").when(~low & (rate <= 40000), "hybrid")
    asked = hint == "voice" or application == "voip"
    without = F.when((score < 0.25) & F.lit(asked), F.when(low, "speech").otherwise("hybrid")).otherwise("transform")
    return F.when(backbone.isNull(), without).when(score > 0.7, "transform").otherwise(backbone)
