"""The transform codec: both sides agree to the last bit of state, and samples come back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarmill.functions import allocation as alloc
from sonarmill.functions import band_codec as bc
from sonarmill.functions import speech_codec as sc
from sonarmill.functions import speech_tables as st
from sonarmill.functions import transform_codec as tc
from sonarmill.functions.entropy import Decoder, Encoder
from sonarmill.functions.speech_tables import SpeechTables
from sonarmill.functions.transform import mdct
from sonarmill.operators import codec


def music(channels, n=24_000, burst=True):
    t = np.arange(n) / 48_000
    left = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 1800 * t)
    right = 0.3 * np.sin(2 * np.pi * 440 * t + 0.3) + 0.1 * np.sin(2 * np.pi * 3000 * t)
    noise = np.random.default_rng(1).normal(size=(2, n)) * 0.01
    noise[0, n // 2 : n // 2 + 300] *= 40 if burst else 1
    return (np.array([left, right]) + noise)[:channels]


def snr(x, y):
    return 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum())


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("lm", [0, 1, 2, 3])
def test_both_sides_stay_in_step(channels, lm):
    x, n = music(channels), 120 << lm
    enc, dec, out = tc.FrameCodec(channels), tc.FrameCodec(channels), []
    for k in range(x.shape[1] // n):
        data = enc.encode(x[:, k * n : (k + 1) * n], 200 * channels * n // 960, lm)
        out.append(dec.decode(data, lm))
        assert enc.final_range == dec.final_range and len(data) == 200 * channels * n // 960
        assert np.array_equal(enc.log, dec.log) and enc.seed == dec.seed
    y = np.concatenate(out, axis=1)
    assert snr(x[:, 960 : y.shape[1] - 120], y[:, 1080:]) > 12


@pytest.mark.parametrize(("size", "least"), [(20, 10), (60, 25), (160, 35), (400, 40)])
def test_a_tone_gets_better_with_the_rate(size, least):
    x = 0.4 * np.sin(2 * np.pi * 440 * np.arange(24_000) / 48_000)[None]
    enc, dec = tc.FrameCodec(1), tc.FrameCodec(1)
    y = np.concatenate([dec.decode(enc.encode(x[:, k : k + 960], size, 3), 3) for k in range(0, 24_000, 960)], axis=1)
    assert snr(x[:, 1920:-120], y[:, 2040:]) > least


@pytest.mark.parametrize("size", [2, 3, 5, 9, 17, 40])
def test_tiny_packets_keep_their_budget(size):
    rng = np.random.default_rng(size)
    enc, dec = tc.FrameCodec(2), tc.FrameCodec(2)
    for k in range(12):
        pcm = rng.normal(size=(2, 960)) * (k % 4) / 8
        dec.decode(enc.encode(pcm, size, 3), 3)
        assert enc.final_range == dec.final_range


def test_silence_costs_a_bit_and_is_silent():
    enc, dec = tc.FrameCodec(1), tc.FrameCodec(1)
    for _ in range(3):
        assert not dec.decode(enc.encode(np.zeros((1, 960)), 40, 3), 3).any()


def test_any_bytes_decode_to_finite_samples():
    rng = np.random.default_rng(0)
    decoders = {c: tc.FrameCodec(c) for c in (1, 2)}
    for k in range(300):
        lm, channels, coded = int(rng.integers(4)), int(rng.integers(1, 3)), int(rng.integers(1, 3))
        y = decoders[channels].decode(rng.bytes(int(rng.integers(0, 120))), lm, coded, 0, int(rng.choice([13, 17, 19, 21])))
        assert y.shape == (channels, 120 << lm) and np.isfinite(y).all()
        if k % 9 == 0:
            assert np.isfinite(decoders[channels].conceal(lm)).all()


def test_spectrum_is_the_lapped_transform_and_comes_back():
    rng = np.random.default_rng(2)
    for n, blocks in ((960, 1), (960, 8), (240, 2), (120, 1)):
        x = rng.normal(size=3 * n + tc.OVERLAP)
        freq = [tc.spectrum(x[k * n : (k + 1) * n + tc.OVERLAP], blocks) for k in range(3)]
        out = np.zeros(len(x))
        for k, f in enumerate(freq):
            out[k * n : (k + 1) * n + tc.OVERLAP] += tc.samples(f, blocks)
        assert np.allclose(out[tc.OVERLAP : -tc.OVERLAP], x[tc.OVERLAP : -tc.OVERLAP])
    flat = (960 - tc.OVERLAP) // 2
    x = rng.normal(size=960 + tc.OVERLAP)
    assert np.allclose(tc.spectrum(x, 1), mdct(np.concatenate([np.zeros(flat), x, np.zeros(flat)])) * (2 / 960) ** 0.5)


def test_pitch_filters_undo_each_other():
    rng = np.random.default_rng(3)
    x, past = rng.normal(size=960), rng.normal(size=tc.HISTORY)
    for old, new in ((tc.Pitch(), tc.Pitch(100, 0.5)), (tc.Pitch(100, 0.5), tc.Pitch(40, 0.3, 1)), (tc.Pitch(20, 0.75, 2), tc.Pitch())):
        sent = tc.pitch_filtered(past, x, old, new, -1.0)
        assert np.allclose(tc.pitch_filtered(past, sent, old, new), x)


def test_ladder_and_levels():
    assert [c - 1 for c in alloc.ladder(2)[1:8]] == [15, 23, 28, 31, 34, 36, 38]
    assert [alloc.pulses_of(k) for k in (0, 7, 8, 9, 16, 24, 40)] == [0, 7, 8, 9, 16, 32, 128]
    for size in (2, 4, 16, 176):
        costs = alloc.ladder(size)
        for bits in range(0, costs[-1] + 10):
            best = min(range(len(costs)), key=lambda k: (abs(costs[k] - bits), k))
            assert abs(costs[alloc.level_for(size, bits)] - bits) == abs(costs[best] - bits)


def test_fixed_point_trigonometry():
    angles = range(64, 16321, 64)
    for x in angles:
        assert abs(alloc.cosine(x) / 32768 - np.cos(np.pi / 2 * x / 16384)) < 2e-4
        s, c = alloc.cosine(16384 - x), alloc.cosine(x)
        assert abs(alloc.log_tangent(s, c) / 2048 - np.log2(s / c)) < 1e-2


@pytest.mark.parametrize("channels", [1, 2])
def test_allocation_spends_what_there_is_and_both_sides_agree(channels):
    for size in (10, 40, 120, 300):
        for lm in range(4):
            enc = Encoder(size)
            plan = tc.Plan(lm=lm, intensity=12)
            total = (size * 8 << 3) - 40
            sent = alloc.allocate(bc.Writer(enc, size), 0, 21, [0] * 21, alloc.caps(lm, channels), 5, total, channels, lm, plan)
            got = alloc.allocate(bc.Reader(Decoder(enc.finish()), size), 0, 21, [0] * 21, alloc.caps(lm, channels), 5, total, channels, lm)
            assert sent == got
            assert sum(sent.shape) + 8 * channels * sum(sent.fine) <= total
            assert all(b == 0 for b in sent.shape[sent.coded :])


def test_energies_come_back():
    rng = np.random.default_rng(6)
    target = rng.normal(size=(2, 21)) * 3
    a, b = np.zeros((2, 21)), np.zeros((2, 21))
    enc = Encoder(200)
    out, fine = bc.Writer(enc, 200), [3] * 21
    bc.coarse_energy(out, a, target, 0, 21, True, 3, bc.plain_model)
    assert np.abs(a - target).max() <= 0.5 + 1e-9
    bc.fine_energy(out, a, target, 0, 21, fine)
    bc.last_energy(out, a, target, 0, 21, fine, [False] * 21)
    back = bc.Reader(Decoder(enc.finish()), 200)
    bc.coarse_energy(back, b, None, 0, 21, True, 3, bc.plain_model)
    bc.fine_energy(back, b, None, 0, 21, fine)
    bc.last_energy(back, b, None, 0, 21, fine, [False] * 21)
    assert np.array_equal(a, b) and np.abs(a - target).max() < 1 / 16 + 1e-9


def test_a_model_from_a_table_must_be_whole():
    rows = [(lm, alone, band, 50 + band, 60) for lm in range(4) for alone in (False, True) for band in range(21)]
    assert bc.model_from_table(rows)(2, True, 30) == (70, 60)
    with pytest.raises(ValueError, match="lacks 1"):
        bc.model_from_table(rows[:-1])


def test_rotation_and_dealing_are_undone():
    rng = np.random.default_rng(7)
    for n, blocks, k, spread in ((16, 1, 3, 2), (64, 4, 5, 1), (48, 2, 4, 3), (8, 1, 6, 2)):
        x = rng.normal(size=n)
        assert np.allclose(bc.turned(bc.turned(x, False, blocks, k, spread), True, blocks, k, spread), x)
    for size, blocks in ((4, 2), (3, 4), (2, 8), (1, 16)):
        x = rng.normal(size=size * blocks)
        for by_sequency in (False, True):
            assert np.array_equal(bc.dealt(bc.dealt(x, size, blocks, by_sequency), size, blocks, by_sequency, back=True), x)


def test_held_choices():
    edges, margins = [10.0, 20.0], [2.0, 2.0]
    assert tc.held(11, edges, margins, 0) == 0 and tc.held(12.5, edges, margins, 0) == 1
    assert tc.held(9, edges, margins, 1) == 1 and tc.held(7, edges, margins, 1) == 0


def frames(spark, channels=1, n=960, count=12, streams=2):
    x = music(channels, n * count, burst=False)
    rows = [(f"s{s}", k, (x[:, k * n : (k + 1) * n] * (1 - 0.5 * s)).T.ravel().tolist()) for s in range(streams) for k in range(count)]
    return x, spark.createDataFrame(rows, "stream string, seq long, pcm array<double>")


def test_streams_through_packets_and_back(spark):
    x, rows = frames(spark, 2)
    packets = codec.encode(rows, ["stream"], 2, 128.0).cache()
    assert packets.where("error is not null").count() == 0 and packets.selectExpr("max(length(data))").first()[0] == 320
    got = codec.decode(packets.select("stream", "seq", "data"), ["stream"], 2)
    sent = {(r["stream"], r["seq"]): r["final_range"] for r in packets.collect()}
    back = sorted(got.collect(), key=lambda r: (r["stream"], r["seq"]))
    assert all(r["final_range"] == sent[r["stream"], r["seq"]] and r["samples"] == 960 and len(r["pcm"]) == 1920 for r in back)
    y = np.concatenate([np.array(r["pcm"]).reshape(-1, 2).T for r in back if r["stream"] == "s0"], axis=1)
    assert snr(x[:, 960:-120], y[:, 1080:]) > 15
    mono = codec.decode(packets.select("stream", "seq", "data"), ["stream"], 1, 16_000).collect()
    assert all(r["channels"] == 1 and len(r["pcm"]) == 320 for r in mono)


def test_lost_and_broken_packets(spark):
    _, rows = frames(spark, streams=1)
    packets = codec.encode(rows, ["stream"]).select("stream", "seq", F.when(F.col("seq") == 5, None).when(F.col("seq") == 7, F.unhex(F.lit("FF"))).otherwise(F.col("data")).alias("data"))
    got = {r["seq"]: r for r in codec.decode(packets, ["stream"], 1).collect()}
    assert got[5]["concealed"] and got[5]["samples"] == 960 and np.abs(got[5]["pcm"]).max() > 0.05
    assert got[7]["error"] == "bad_frame_length" and got[7]["pcm"] is None
    assert got[8]["error"] is None


def test_files_are_trimmed_and_gained(spark):
    x, rows = frames(spark, 1, streams=1)
    files = codec.encode_files(rows, "stream").select(F.col("stream").alias("path"), "content")
    got = sorted(codec.decode_files(files).collect(), key=lambda r: r["seq"])
    y = np.concatenate([r["pcm"] for r in got])
    assert len(y) == x.shape[1] - 120 and snr(x[0, 960:-120], y[960:]) > 15


def test_multistream_routes_and_checks(spark):
    x = music(2, 960 * 6, burst=False)
    stereo, mono = tc.FrameCodec(2), tc.FrameCodec(1)
    rows = []
    for k in range(6):
        part = x[:, k * 960 : (k + 1) * 960]
        a, b = stereo.encode(part, 200, 3), mono.encode(part[:1], 100, 3)
        first = bytes([31 << 3 | 4]) + bytes([200]) + a
        rows.append(("s", k, first + bytes([31 << 3]) + b))
    rows.append(("s", 6, rows[0][2][:202] + bytes([30 << 3]) + b"xyz"))
    got = {r["seq"]: r for r in codec.decode_multistream(spark.createDataFrame(rows, "stream string, seq long, data binary"), ["stream"], 2, 1, [2, 0, 255, 1]).collect()}
    assert got[6]["error"] == "bad_frame_count"
    y = np.concatenate([np.array(got[k]["pcm"]).reshape(-1, 4).T for k in range(6)], axis=1)
    assert not y[2].any()
    for ch, want in ((0, 0), (1, 0), (3, 1)):
        assert snr(x[want, 960:-120], y[ch, 1080:]) > 10
    with pytest.raises(ValueError, match="layout"):
        codec.MultistreamDecoder(1, 2, (0,))


def test_options_out_of_range_are_errors(spark):
    for bad in ({"channels": 3}, {"rate": 44_100}):
        with pytest.raises(ValueError):
            codec.PacketDecoder(**bad)
    with pytest.raises(ValueError):
        codec.PacketEncoder(kbps=1.0)
    rows = spark.createDataFrame([("s", 1, [0.0] * 123), ("s", 2, None), ("s", 3, [float("nan")] * 120)], "stream string, seq long, pcm array<double>")
    got = {r["seq"]: r for r in codec.encode(rows, ["stream"]).collect()}
    assert got[1]["error"] == "bad_frame_size" and got[2]["data"] is not None and got[3]["samples"] == 120


def voice(n=38_400, f0=120):
    """Pulses through two resonances, and a little noise."""
    x = np.zeros(n)
    x[:: 48_000 // f0] = 1.0
    for f, width in ((700, 100), (1800, 150)):
        r = np.exp(-np.pi * width / 48_000)
        a, b = 2 * r * np.cos(2 * np.pi * f / 48_000), -r * r
        y = np.zeros(n)
        for i in range(n):
            y[i] = x[i] + a * y[i - 1] + b * y[i - 2]
        x = y
    return x / np.abs(x).max() * 0.4 + np.random.default_rng(3).normal(size=n) * 0.002


@pytest.fixture(scope="module")
def speech():
    return voice()


@pytest.mark.parametrize("khz", [8, 12, 16])
@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("ms", [10, 20, 40, 60])
def test_speech_layer_stays_in_step(speech, khz, channels, ms):
    t = np.arange(len(speech)) / 48_000
    x = np.array([speech, 0.6 * np.roll(speech, 3) + 0.05 * np.sin(2 * np.pi * 300 * t)])[:channels]
    enc, dec, out, n = sc.SpeechEncoder(channels, khz), sc.SpeechDecoder(channels), [], ms * 48
    for k in range(8 if ms < 40 else 4):
        data, final = sc.speech_packet(enc, x[:, k * n : (k + 1) * n], 5 * ms)
        wire = bc.Reader(Decoder(data), len(data))
        out.append(dec.decode(wire, ms, khz, channels))
        assert wire.coder.range == final and len(data) <= 5 * ms and not wire.room(17)
        for e, d in zip(enc.layers[:channels], dec.layers, strict=False):
            assert np.array_equal(e.out, d.out) and e.level == d.level
    y = np.concatenate(out, axis=1)
    assert snr(x[:, 1000 : y.shape[1] - enc.lag], y[:, 1000 + enc.lag :]) > (10 if channels == 2 or ms == 10 else 15)


def test_pulses_of_any_size_come_back():
    rng = np.random.default_rng(8)
    tables = SpeechTables()
    for scale, length in ((0.3, 320), (2.0, 160), (9.0, 120), (40.0, 80), (2000.0, 80)):
        want = np.round(rng.laplace(0, scale, length)).astype(int)
        enc = Encoder(2000)
        sc.code_pulses(bc.Writer(enc, 2000), want, 2, 1, length, tables)
        assert np.array_equal(sc.code_pulses(bc.Reader(Decoder(enc.finish()), 2000), None, 2, 1, length, tables), want)


def test_spectra_keep_their_distances_and_come_near():
    rng = np.random.default_rng(9)
    for order in (10, 16):
        book = SpeechTables().spectra[order]
        for _ in range(30):
            w = np.sort(rng.uniform(300, 32_400, order))
            vector, residual = sc.quantised_spectrum(sc._apart(np.round(w), order), book)
            got = sc.spectrum_of(vector, residual, book)
            assert (np.diff(np.concatenate([[0], got, [32768]])) >= np.array(st.SPACING[order])).all()
            assert np.abs(got - sc._apart(np.round(w), order)).mean() < 2000


def test_weights_of_a_first_vector():
    """Pinned values of the public format: the weights that belong to this vector."""
    assert sc.spectrum_weights([12, 35, 60, 83, 108, 132, 157, 180, 206, 228]) == [2897, 2314, 2314, 2314, 2287, 2287, 2314, 2300, 2327, 2287]


def test_tables_from_rows_must_be_whole():
    rows = [(f"shell_{k}", p, v) for k in range(4) for p, v in enumerate(v for t in SpeechTables().shells[k][1:] for v in t)]
    for order in (10, 16):
        book = SpeechTables().spectra[order]
        flat = {"vectors": [x for v in book.vectors for x in v], "choice": book.choice[0] + book.choice[1], "select": [0x64] * (16 * order), "predict": [150] * (2 * order - 2), "residual": [x for r in book.residual for x in r]}
        rows += [(f"{name}_{order}", p, v) for name, values in flat.items() for p, v in enumerate(values)]
    got = SpeechTables.from_rows(rows)
    assert got.shells == SpeechTables().shells and got.spectra[10].table[0][:2] == [2, 3] and got.spectra[16].weight[5] == [150] * 15
    with pytest.raises(ValueError, match="shell_3"):
        SpeechTables.from_rows([r for r in rows if r[0] != "shell_3"])


def test_any_bytes_decode_in_every_mode():
    rng = np.random.default_rng(4)
    decoders = {c: codec.PacketDecoder(c) for c in (1, 2)}
    for k in range(250):
        channels = int(rng.integers(1, 3))
        data = bytes([int(rng.integers(0, 32)) << 3 | int(rng.integers(0, 2)) << 2]) + rng.bytes(int(rng.integers(0, 70)))
        row = decoders[channels].step({"seq": k, "data": None if k % 11 == 5 else data})[0]
        assert row["error"] is None and np.isfinite(row["pcm"]).all()


def spoken(spark, x, n, key="s"):
    return spark.createDataFrame([(key, k, x[k * n : (k + 1) * n].tolist()) for k in range(len(x) // n)], "stream string, seq long, pcm array<double>")


def decoded(rows):
    return np.concatenate([r["pcm"] for r in sorted(rows, key=lambda r: r["seq"])])


@pytest.mark.parametrize(("mode", "bandwidth", "n", "kbps"), [("speech", "wide", 960, 24.0), ("speech", "medium", 1920, 20.0), ("hybrid", "full", 960, 40.0), ("hybrid", "superwide", 480, 48.0), ("auto", "full", 960, 32.0), ("auto", "wide", 960, 16.0)])
def test_every_mode_through_packets(spark, speech, mode, bandwidth, n, kbps):
    packets = codec.encode(spoken(spark, speech, n), ["stream"], 1, kbps, bandwidth, mode).cache()
    sent = {r["seq"]: r for r in packets.collect()}
    got = codec.decode(packets.select("stream", "seq", "data"), ["stream"], 1).collect()
    assert all(r["final_range"] == sent[r["seq"]]["final_range"] and r["samples"] == n for r in got)
    y = decoded(got)
    best = max(snr(speech[4800:-600], y[4800 + d : len(y) - 600 + d][: len(speech) - 5400]) for d in (50, 51, 52, 68, 120) if len(y) == len(speech))
    assert best > 10


def test_copies_recover_a_lost_packet(spark, speech):
    packets = codec.encode(spoken(spark, speech, 960), ["stream"], 1, 48.0, "wide", "speech", copies=True).cache()
    holes = packets.select("stream", "seq", F.when(~F.col("seq").isin(9, 20), F.col("data")).alias("data"))
    whole, with_copy, without = (decoded(codec.decode(d, ["stream"], 1, recover=r).collect()) for d, r in ((packets.select("stream", "seq", "data"), False), (holes, True), (holes, False)))
    part = slice(9 * 960, 11 * 960)
    assert np.allclose(with_copy, whole, atol=1e-6)
    assert snr(whole[part], without[part]) < 40


def test_silence_is_suppressed(spark):
    packets = codec.encode(spoken(spark, np.zeros(960 * 60), 960), ["stream"], 1, 24.0, "full", dtx=True).orderBy("seq").collect()
    sizes = [len(r["data"]) for r in packets]
    assert min(sizes[:10]) > 1 and sizes.count(1) > 40 and max(sizes[30:]) > 1


def test_lower_rates_hold_no_mirror_tones(spark):
    t = np.arange(19_200) / 48_000
    x = 0.3 * np.sin(2 * np.pi * 1000 * t) + 0.3 * np.sin(2 * np.pi * 10_000 * t)
    packets = codec.encode(spoken(spark, x, 960), ["stream"], 1, 96.0).select("stream", "seq", "data")
    y = decoded(codec.decode(packets, ["stream"], 1, 16_000).collect())[1600:]
    power = np.abs(np.fft.rfft(y * np.hanning(len(y)))) ** 2
    hz = np.fft.rfftfreq(len(y), 1 / 16_000)
    assert power[(hz > 5500) & (hz < 6500)].sum() < 1e-3 * power[(hz > 900) & (hz < 1100)].sum()


def test_variable_sizes_follow_the_signal_and_keep_the_rate(spark):
    quiet, loud = np.zeros(960 * 10), music(1, 960 * 40)[0]
    packets = codec.encode(spoken(spark, np.concatenate([loud, quiet, loud]), 960), ["stream"], 1, 64.0, vbr=True).orderBy("seq").collect()
    sizes = np.array([len(r["data"]) for r in packets])
    assert sizes[42:50].max() < 60 and sizes[20] > 100 and len(set(sizes.tolist())) > 5
    assert abs(sizes.mean() / 160 - 1) < 0.25 and all(r["error"] is None for r in packets)


@pytest.mark.parametrize(("channels", "coded"), [(2, 1), (1, 2)])
def test_channels_are_mixed_down_or_doubled(spark, channels, coded):
    x, rows = frames(spark, channels, streams=1)
    packets = codec.encode(rows, ["stream"], channels, 128.0, coded_channels=coded)
    assert {r["data"][0] >> 2 & 1 for r in packets.collect()} == {coded - 1}
    got = sorted(codec.decode(packets.select("stream", "seq", "data"), ["stream"], 2).collect(), key=lambda r: r["seq"])
    y = np.concatenate([np.array(r["pcm"]).reshape(-1, 2).T for r in got], axis=1)
    want = x.mean(axis=0)
    assert snr(want[960:-120], y.mean(axis=0)[1080:]) > 15


def test_a_constant_is_taken_out(spark):
    x = 0.2 * np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000) + 0.3
    y = decoded(codec.decode(codec.encode(spoken(spark, x, 960), ["stream"], 1, 96.0, reject_dc=True).select("stream", "seq", "data"), ["stream"], 1).collect())
    assert abs(y[-9600:].mean()) < 0.02


@pytest.mark.parametrize(("mode", "kbps", "band"), [("transform", 10.0, "narrow"), ("transform", 30.0, "superwide"), ("speech", 13.0, "medium"), ("speech", 64.0, "wide"), ("hybrid", 30.0, "superwide"), ("auto", 96.0, "full")])
def test_bandwidth_by_rate(mode, kbps, band):
    assert codec.PacketEncoder(1, kbps, "auto", mode).bandwidth == band


@pytest.mark.parametrize("rate", [8000, 12_000, 16_000, 24_000, 48_000])
def test_every_output_rate(spark, speech, rate):
    """A signal below 3 kHz comes back at every rate."""
    t = np.arange(19_200) / 48_000
    x = 0.3 * np.sin(2 * np.pi * 500 * t) + 0.2 * np.sin(2 * np.pi * 2200 * t)
    packets = codec.encode(spoken(spark, x, 960), ["stream"], 1, 96.0).select("stream", "seq", "data")
    y = decoded(codec.decode(packets, ["stream"], 1, rate).collect())
    every = 48_000 // rate
    lag = 120 // every
    assert len(y) == len(x) // every and snr(x[1920:-120:every], y[1920 // every + lag :][: len(x[1920:-120:every])]) > 25
