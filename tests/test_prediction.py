"""Predictors by Burg's and Schur's recursions, windows, warped autocorrelation."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sonarmill.functions import lpc
from sonarmill.functions.speech import prediction_gain
from sonarmill.plans.catalog import ORACLE_SQL, QUERIES


def process(a, n, seed=0):
    e, x = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for i in range(n):
        x[i] = e[i] + sum(c * x[i - 1 - k] for k, c in enumerate(a) if i > k)
    return x


def test_burg_finds_the_process_and_its_residual():
    a = np.array([1.2, -0.7, 0.1])
    x = process(a, 4000)
    got, left = lpc.burg(x, 3)
    assert np.allclose(got, a, atol=0.06)
    e = lpc.filter_residual(x, got)
    assert abs(left / (e @ e) - 1) < 0.02


def test_burg_keeps_its_gain_bounded():
    x = np.sin(0.3 * np.arange(500))
    a, _ = lpc.burg(x, 8, 0.01)
    assert prediction_gain(a) >= 0.0099
    assert lpc.burg(np.zeros(50), 4)[0].tolist() == [0.0] * 4


def test_schur_equals_levinson():
    x = process([0.9, -0.4, 0.2, -0.1], 2000, 1)
    r = lpc.autocorrelation(x, 6)
    rc, left = lpc.schur(r, 6)
    a = lpc.levinson(r, 6)
    assert np.allclose(lpc.from_reflections(rc), a)
    assert abs(left - (r[0] - a @ r[1:])) < 1e-6 * r[0]


def test_windows_and_warping():
    assert np.allclose(lpc.sine_window(40, True) ** 2 + lpc.sine_window(40, False) ** 2, 1)
    x = process([0.5], 600, 2)
    assert np.allclose(lpc.warped_autocorrelation(x, 0.0, 5), lpc.autocorrelation(x, 5))
    assert abs(lpc.warped_autocorrelation(x, 0.3, 5)[1]) < lpc.warped_autocorrelation(x, 0.3, 5)[0]


def test_query_gives_its_sql_to_the_bit_on_odd_frames(spark, tmp_path):
    """Null, silent, short and non-finite frames, missing samples, one pulse, smooth frames that magnify a last digit, -0.0."""
    rng, n = np.random.default_rng(0), np.arange(64)
    frames = [None, [], [0.0] * 64, [1.0] * 64, [1.0] + [0.0] * 63, [1.0, -3e-7] + [0.0] * 62, [1.0] * 5, [1.0] * 40, [None] + [1.0] * 63, [None] * 64]
    frames += [[1.0] * 20 + [None] * 20 + [0.5] * 24, [math.nan] + [1.0] * 63, [1.0] * 30 + [math.inf] + [1.0] * 33, (1e15 * rng.normal(size=64)).tolist(), np.exp(-(((n - 32) / 12) ** 2)).tolist(), np.hanning(64).tolist()]
    frames += [(np.convolve(rng.normal(size=95), np.hanning(32), "valid") * np.hanning(64)).tolist() for _ in range(40)] + rng.normal(size=(20, 64)).tolist()
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": range(len(frames)), "embedding": pa.array(frames, pa.list_(pa.float32())), "label": [0] * len(frames)}), path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    want = sorted(con.execute(ORACLE_SQL["linear_prediction"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["linear_prediction"](spark, str(tmp_path)).collect())
    for a, b in zip(got, want, strict=True):
        assert [repr(v) for v in a] == [repr(v) for v in b], frames[a[0]]
    assert QUERIES["linear_prediction"](spark.newSession(), str(tmp_path)).where("vec_id < 0").count() == 0


def test_restoring_is_measured():
    """A predictor whose synthesis explodes does not restore."""
    x = np.random.default_rng(3).normal(size=64)
    assert lpc._restored(x, np.array([1.2, -0.7]), False)
    assert not lpc._restored(x, np.array([40.0, 30.0]), False)


def test_synthesis_restores_a_frame(spark):
    x, a = process([1.2, -0.7], 64, 4), [1.2, -0.7]
    e = lpc.filter_residual(x, np.array(a)).tolist()
    rows = spark.createDataFrame([(e, a), (None, a), (e, None)], "e array<double>, a array<double>")
    got = [r["back"] for r in rows.select(lpc.synthesis(F.col("e"), F.col("a")).alias("back")).collect()]
    assert np.allclose(got[0], x, rtol=0, atol=1e-12) and got[1:] == [None, None]
