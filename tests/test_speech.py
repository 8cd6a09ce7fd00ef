import numpy as np
import pytest

from sonarmill.functions import lpc, perceptual, speech


def test_logarithms_are_inverse_within_a_percent():
    for x in (1, 2, 3, 5, 100, 127, 128, 1000, 65535, 1 << 20, (1 << 30) + 12345):
        assert speech.log2_of(x) == pytest.approx(128 * np.log2(x), abs=2)
        assert speech.power2_of(speech.log2_of(x)) == pytest.approx(x, rel=0.02, abs=1)
    assert speech.power2_of(-1) == 0 and speech.power2_of(4000) == 0x7FFFFFFF


def test_gains():
    levels = [speech.gain_of(k) for k in range(64)]
    assert levels[0] == 81920 and levels[63] == 1686110208
    assert levels == sorted(levels)
    assert speech.gain_indices([20, 4, 10, 0], None) == [20, 20, 26, 22]
    assert speech.gain_indices([3], 40) == [24]


def test_random_sequence_wraps():
    assert speech.next_random(0) == 907633515
    assert 0 <= speech.next_random(0xFFFFFFFF) < 1 << 32


@pytest.mark.parametrize("order", [2, 5, 10, 16])
def test_line_spectra_round_trip(order):
    rng = np.random.default_rng(order)
    x = np.convolve(rng.normal(size=800), rng.normal(size=6))
    a = lpc.levinson(lpc.autocorrelation(x, order), order)
    w = speech.line_spectra(a)
    assert len(w) == order and (np.diff(w) > 0).all()
    assert np.allclose(speech.from_line_spectra(w), a, atol=1e-6)
    assert 0 < speech.prediction_gain(a) <= 1


def test_spacing_and_stability():
    w = speech.spaced(np.array([0.01, 0.5, 0.5001, 3.14]), 0.05)
    assert np.diff(np.concatenate([[0], w, [np.pi]])).min() >= 0.05 - 1e-9
    wild = np.array([2.5, -1.4])
    assert speech.prediction_gain(wild) is None
    assert speech.prediction_gain(speech.stable(wild)) >= 1e-4


def test_stereo_restores_left_and_right():
    rng = np.random.default_rng(1)
    left, right = rng.uniform(-0.4, 0.4, (2, 50))
    mid, side = (left + right) / 2, (left - right) / 2
    got = speech.unmix_stereo(mid, side[1:-1], (0.0, 0.0), (0.0, 0.0), 8)
    assert np.allclose(got[0], left[1:-1]) and np.allclose(got[1], right[1:-1])
    now, smooth = mid[1:-1], (mid[:-2] + 2 * mid[1:-1] + mid[2:]) / 4
    got = speech.unmix_stereo(mid, side[1:-1] - 0.3 * smooth + 0.1 * now, (0.3, -0.1), (0.3, -0.1), 8)
    assert np.allclose(got[0], left[1:-1])


def test_voice_activity_rises_with_level_and_state_goes_along():
    rng = np.random.default_rng(2)
    vad = speech.VoiceActivity()
    calm = [vad.frame(rng.normal(0, 1e-3, 320))["activity"] for _ in range(60)][-1]
    t = np.arange(320) / 16000
    loud = vad.frame(0.3 * np.sin(2 * np.pi * 300 * t))
    assert calm < 0.2 < 0.8 < loud["activity"] and loud["tilt"] > 0
    whole, halves = speech.Halves().split(np.arange(40.0)), speech.Halves()
    parts = [halves.split(np.arange(40.0)[k : k + 20]) for k in (0, 20)]
    assert np.allclose(whole[0], np.concatenate([p[0] for p in parts]))


def test_concealment_goes_on_with_the_pitch():
    t = np.arange(960)
    x = np.sin(2 * np.pi * t / 80)
    made = speech.concealed(x[:640], 160, 0)
    assert np.corrcoef(made, x[640:800])[0, 1] > 0.9
    assert np.abs(speech.concealed(x[:640], 160, 6)).max() < 0.7
    assert not speech.concealed(np.zeros(640), 100, 0).any() and not speech.concealed(np.zeros(0), 10, 0).any()


def test_score_falls_with_noise():
    rng = np.random.default_rng(3)
    t = np.arange(9600) / 48000
    x = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t)
    scores = [perceptual.score(x, x + rng.normal(0, s, len(x))) for s in (0, 1e-4, 1e-3, 1e-2)]
    assert scores[0] == pytest.approx(100) and scores == sorted(scores, reverse=True) and scores[3] < 60
    stereo = np.stack([x, x], axis=1)
    assert perceptual.score(stereo, stereo) == pytest.approx(100)
    assert perceptual.score(x[:500], x[:500]) is None


def test_lag_and_dominant_frequency():
    t = np.arange(4800)
    x = np.sin(2 * np.pi * 440 / 48000 * t) + np.sin(0.001 * t * t)
    lag, snr = perceptual.best_lag_snr(x, np.concatenate([np.zeros(37), x]), 100)
    assert lag == 37 and snr > 100
    assert perceptual.dominant(np.sin(2 * np.pi * 700 / 48000 * t), [300.0, 500.0, 700.0, 1100.0]) == 700.0
