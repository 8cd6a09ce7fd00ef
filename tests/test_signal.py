import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarmill.functions import analysis, lpc, signal


def _one(spark, column, x, **more):
    rows = spark.createDataFrame([(x,)], "x array<double>")
    return rows.select(column.alias("y")).first()["y"]


def test_folds_and_edges(spark):
    x = F.col("x")
    v = [1.0, -2.0, 0.0, 3.0]
    assert _one(spark, signal.energy(x), v) == 3.5
    assert _one(spark, signal.autocorrelation(x, 5), v) == [14.0, -2.0, -6.0, 3.0, 0.0, 0.0]
    assert _one(spark, signal.zero_crossings(x), v) == 2
    assert _one(spark, signal.energy(x), []) is None
    assert _one(spark, signal.energy(x), None) is None
    assert _one(spark, signal.to_int16(x), [0.5 / 32768, 1.5 / 32768, -2.5 / 32768, 2.0, -2.0]) == [0, 2, -2, 32767, -32768]
    assert _one(spark, signal.downmix(x), v) == [-0.5, 1.5]
    assert _one(spark, signal.trimmed(x, F.lit(1), F.lit(2)), v) == [-2.0, 0.0]
    assert _one(spark, signal.pitch_lag(x, 1, 3), [0.0] * 5) == 1


def test_long_term_pair_and_filters(spark):
    v = [float(k % 7) - 2 for k in range(30)]
    back = signal.ltp_synthesis(signal.ltp_residual(F.col("x"), 4, 0.6), 4, 0.6)
    assert np.allclose(_one(spark, back, v), v)
    y, want = 0.0, []
    for s in v:
        y += 0.25 * (s - y)
        want.append(y)
    assert np.allclose(_one(spark, signal.one_pole(F.col("x"), 0.25), v), want)
    high = _one(spark, signal.high_pass(F.col("x"), 0.25), v)
    assert np.allclose(high, [s - m for s, m in zip(v, [0.0, *want[:-1]], strict=True)])
    fade = _one(spark, signal.cross_fade(F.col("x"), F.transform(F.col("x"), lambda s: -s)), v)
    assert abs(fade[0] - v[0]) < 0.05 and abs(fade[-1] + v[-1]) < 0.05


@pytest.mark.parametrize(("tones", "speech"), [((180, 900, 2400), True), ((220, 3000, 9000, 15000), False)])
def test_music_score(spark, tones, speech):
    x = [sum(0.2 * math.sin(2 * math.pi * f * n / 48000) for f in tones) for n in range(960)]
    got = _one(spark, analysis.features(F.col("x")), x)
    assert (got["music"] < 0.45) if speech else (got["music"] > 0.55 and got["bandwidth"] == "full")


def test_silence_and_empty_frames(spark):
    assert _one(spark, analysis.features(F.col("x")), [0.0] * 120)["energy"] < 1e-9
    got = _one(spark, analysis.features(F.col("x")), [])
    assert (got["energy"], got["music"], got["bandwidth"]) == (0.0, 0.5, "full")


def test_rate_split(spark):
    rows = spark.createDataFrame([(r,) for r in (0, 12000, 14000, 32000, 64000, 70000)], "r long")
    got = [r[0] for r in rows.select(analysis.speech_rate(F.col("r"), F.lit(False))).collect()]
    assert got == [0, 10000, 11750, 22000, 38000, 41000]


def test_predictor_whitens_and_inverts(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(400)
    for n in range(1, 400):
        x[n] = 0.9 * x[n - 1] + rng.normal()
    a = lpc.levinson(lpc.autocorrelation(x, 4), 4)
    e = lpc.filter_residual(x, a)
    assert (e @ e) < 0.3 * (x @ x)
    assert np.allclose(lpc.filter_synthesis(e, a), x)
    halves = np.concatenate([lpc.filter_residual(x[:150], a), lpc.filter_residual(x[150:], a, x[:150])])
    assert np.allclose(halves, e)
    assert lpc.levinson(np.zeros(5), 4) is None
    rows = spark.createDataFrame([(x.tolist(),), ([0.0] * 20,), (None,)], "x array<double>")
    got = rows.withColumn("a", lpc.predictor(F.col("x"), 4)).select("a", lpc.residual(F.col("x"), F.col("a")).alias("e")).collect()
    assert np.allclose(got[0]["a"], a) and np.allclose(got[0]["e"], e)
    assert got[1]["a"] is None and got[2]["a"] is None
