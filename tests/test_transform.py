import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarmill.functions import transform as t
from sonarmill.functions.entropy import pulse_index, pulse_vector


@pytest.mark.parametrize("n", [120, 240, 480, 960])
def test_lapped_transform_restores_the_signal(n):
    x = np.random.default_rng(n).normal(size=3 * n + 17)
    assert np.allclose(t.synthesis_frames(t.analysis_frames(x, n), len(x)), x)


def test_window_is_power_complementary():
    w = t.window(120)
    assert np.allclose(w**2 + w[::-1] ** 2, 1)


def test_emphasis_pair():
    x = np.random.default_rng(1).normal(size=50)
    assert np.allclose(t.de_emphasis(t.pre_emphasis(x)), x)


def test_bands():
    assert t.bands(960)[-1] == (624, 800) and len(t.bands(120)) == 21
    c = np.random.default_rng(2).normal(size=960)
    u = t.unit_bands(c)
    assert all(abs(np.linalg.norm(u[a:b]) - 1) < 1e-9 for a, b in t.bands(960)) and not u[800:].any()


@pytest.mark.parametrize("k", [0, 1, 3, 8, 20])
def test_pulses(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        x = rng.normal(size=8)
        y = t.pulses(x, k)
        assert np.abs(y).sum() == k and (y * x >= 0).all()
        assert pulse_vector(pulse_index(y.tolist()), 8, k) == y.tolist()
        if k >= 8:
            assert y @ x / np.linalg.norm(y) / np.linalg.norm(x) > 0.95
    assert t.pulses(np.zeros(4), 3).tolist() == [3, 0, 0, 0]


def test_one_pulse_is_at_the_largest_place():
    assert t.pulses(np.array([0.1, -0.9, 0.3]), 1).tolist() == [0, -1, 0]


def test_rotations_and_orders():
    x = np.random.default_rng(3).normal(size=12)
    for spread in range(4):
        y = t.rotate(x, 2, spread)
        assert np.allclose(t.rotate(y, 2, spread, inverse=True), x)
        assert abs(np.linalg.norm(y) - np.linalg.norm(x)) < 1e-9
    assert np.allclose(t.haar(t.haar(x, 2), 2), x)
    assert sorted(t.hadamard_order(8)) == list(range(8))


def test_comb_and_stereo():
    x = np.zeros(60)
    x[0] = 1.0
    y = t.comb(x, 20, 0.5)
    assert y[20] == pytest.approx(0.5 * 0.3066406250) and y[19] == y[21] == pytest.approx(0.5 * 0.2170410156) and y[18] == y[22]
    assert t.mid_side(x, x)[2] == 0 and t.mid_side(x, -x)[2] == 1


def test_resampling_keeps_a_tone():
    n = np.arange(480)
    x = np.sin(2 * np.pi * 0.02 * n)
    for up, down in ((1, 2), (2, 1), (1, 3), (3, 2)):
        y = t.resample(x, up, down)
        want = np.sin(2 * np.pi * 0.02 * np.arange(len(y)) * down / up)
        assert len(y) == 480 * up // down
        assert np.abs((y - want)[60:-60]).max() < 0.02


def test_kernel_column(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "x array<double>")
    got = [r["y"] for r in rows.select(t.kernel(t.pre_emphasis)(F.col("x")).alias("y")).collect()]
    assert got[0] == pytest.approx([1.0, 2.0 - t.EMPHASIS]) and got[1:] == [None, None]
