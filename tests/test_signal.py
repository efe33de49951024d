import numpy as np
import pytest
from pyspark.sql import functions as F

from voxward.functions import dsp, signal
from voxward.operators import features, framing, quality
from voxward.params import CNN_MEL, GMM_MEL, MelParams, SilenceParams

RNG = np.random.default_rng(11)


def arrays(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "i int, samples array<float>")


def column(df, expr):
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


SILENCE = [
    (np.zeros(2399), 1.0),
    (np.r_[np.zeros(2400), np.full(2400, 0.5)], 0.5),
    (np.r_[np.full(2400, 0.0099), np.full(7200, 0.0101)], 0.25),
    (np.r_[np.full(2400, 1.0), np.zeros(2399)], 0.0),
]


def test_silence_golden_in_both_forms(spark):
    df = arrays(spark, [x for x, _ in SILENCE])
    want = [r for _, r in SILENCE]
    assert column(df, signal.silence_ratio(F.col("samples"))) == pytest.approx(want)
    audio = quality.frame_quality(df, audio=True).orderBy("i").collect()
    assert [r.silence_ratio for r in audio] == pytest.approx(want)
    assert [r.is_silent for r in audio] == [True, True, False, False]
    assert [round(r.max_amplitude, 4) for r in audio] == [0.0, 0.5, 0.0101, 1.0]
    assert quality.drop_silent(df).count() == 2


def test_exactly_at_the_limit_is_kept(spark):
    x = np.r_[np.zeros(4), np.ones(6)]
    params = SilenceParams(sample_rate=2, chunk_ms=1000)
    assert quality.drop_silent(arrays(spark, [x]), params).count() == 1


def test_column_forms_equal_kernels(spark):
    xs = [RNG.normal(0.1, 0.2, n).astype(np.float32) for n in (64, 41, 7, 90, 64)]
    df, x = arrays(spark, xs), F.col("samples")
    params = SilenceParams(sample_rate=8, chunk_ms=1000, threshold_db=-14)
    pairs = [
        (signal.fit_center(x, 41), lambda v: dsp.fit_center(v, 41)),
        (signal.fit_head(x, 41), lambda v: dsp.fit_head(v, 41)),
        (signal.normalize_rms(x), lambda v: dsp.normalize_rms(v.astype(float))),
        (signal.normalize_dc_rms_clip(x), lambda v: dsp.normalize_dc_rms_clip(v.astype(float))),
        (signal.downmix(x, 2), lambda v: dsp.to_mono(v.astype(float), 2)),
        (signal.minmax01(x), lambda v: (v - v.min()) / (v.max() - v.min())),
    ]
    for expr, kernel in pairs:
        for got, v in zip(column(df, expr), xs, strict=True):
            assert got == pytest.approx(list(kernel(v)), abs=1e-6)
    got = column(df, signal.silence_ratio(x, params))
    assert got == pytest.approx([dsp.silence_ratio(v, params) for v in xs])


def test_levels_and_limits(spark):
    quiet, loud = np.zeros(8), np.r_[np.full(999, 0.001), 1.0]
    df, x = arrays(spark, [quiet, loud]), F.col("samples")
    assert column(df, signal.normalize_rms(x))[0] == [0.0] * 8
    clipped = column(df, signal.normalize_dc_rms_clip(x))
    assert clipped[0] == [0.0] * 8 and max(clipped[1]) == 1.0
    unclipped = np.array(column(df, signal.normalize_rms(x))[1])
    assert np.sqrt(np.mean(unclipped**2)) == pytest.approx(0.1) and unclipped.max() > 1
    pcm = column(arrays(spark, [[1.5, -1.5, 0.5, -0.00004]]), signal.pcm16(x))[0]
    assert pcm == [32767, -32767, 16383, -1]


def test_model_lengths():
    n = np.arange(48_000.0)
    assert dsp.fit_center(n, 40_000)[[0, -1]].tolist() == [4000, 43_999]
    assert dsp.fit_head(n, 40_000)[[0, -1]].tolist() == [0, 39_999]
    x = RNG.normal(0, 0.1, (2, 40_000))
    assert dsp.mel_power(x, CNN_MEL).shape == (2, 60, 251)
    features = dsp.cnn_features(x)
    assert features.shape == (2, 60, 79) and features.min() == 0 and features.max() <= 1
    assert dsp.lfcc(x).shape == (2, 79, 20)


def test_mel_against_a_plain_transform():
    p = MelParams(n_fft=64, hop=16, win=48, n_mels=8, fmin=100, fmax=7000)
    x = RNG.normal(0, 1, 200)
    hann = np.zeros(64)
    hann[8:56] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(48) / 48)
    padded = np.r_[np.zeros(32), x, np.zeros(32)]
    bank = dsp.mel_bank(p)
    k, n = np.arange(33)[:, None], np.arange(64)[None, :]
    basis = np.exp(-2j * np.pi * k * n / 64)
    want = [bank @ np.abs(basis @ (padded[s : s + 64] * hann)) ** 2 for s in range(0, len(padded) - 63, 16)]
    assert dsp.mel_power(x[None], p)[0] == pytest.approx(np.array(want).T)


def plain_mel(x, p):
    """Mel spectrogram by transform matrix, column by column."""
    hann = np.zeros(p.n_fft)
    start = (p.n_fft - p.win) // 2
    hann[start : start + p.win] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.win) / p.win)
    k, n = np.arange(p.n_fft // 2 + 1)[:, None], np.arange(p.n_fft)[None, :]
    basis = np.exp(-2j * np.pi * (k * n % p.n_fft) / p.n_fft) * hann
    padded = np.pad(x, p.n_fft // 2)
    columns = [padded[s : s + p.n_fft] for s in range(0, len(padded) - p.n_fft + 1, p.hop)]
    return dsp.mel_bank(p) @ np.abs(basis @ np.array(columns).T) ** 2


def test_full_features_against_a_plain_transform(spark):
    t = np.arange(40_000) / 16_000
    x = 0.2 * np.sin(2 * np.pi * 700 * t) + RNG.normal(0.01, 0.05, 40_000)
    df = spark.createDataFrame([("h", 0, 16_000, [float(v) for v in x])], "host_id string, frame_seq int, sample_rate int, samples array<float>")
    keys = ("host_id", "frame_seq")

    clean = np.clip((x - x.mean()) * 0.1 / np.sqrt(np.mean((x - x.mean()) ** 2)), -1, 1)
    power = plain_mel(clean, CNN_MEL)
    db = 10 * np.log10(np.maximum(power, 1e-10) / power.max())
    db = np.maximum(db, -80)[:, 86:165]
    want = (db - db.min()) / (db.max() - db.min())
    got = np.array(features.cnn_features(df, keys).first().mel).reshape(60, 79)
    assert got == pytest.approx(want, abs=2e-4)

    log_mel = np.log(plain_mel(x * 0.1 / np.sqrt(np.mean(x**2)), GMM_MEL) + 1e-9)
    k, i = np.arange(20)[:, None], np.arange(128)[None, :]
    dct = np.sqrt(2 / 128) * np.cos(np.pi * k * (2 * i + 1) / 256)
    dct[0] /= np.sqrt(2)
    got = np.array(features.lfcc(df, keys).first().lfcc)
    assert got == pytest.approx((dct @ log_mel).T, abs=2e-3)


def test_mel_filters_have_equal_area():
    for p in (CNN_MEL, GMM_MEL):
        areas = dsp.mel_bank(p).sum(axis=1) * p.sample_rate / p.n_fft
        wide = areas[len(areas) // 2 :]  # the low filters are narrower than a few bins
        assert wide == pytest.approx(np.ones(len(wide)), abs=0.12)


def test_dct_rows_are_orthonormal():
    rows = dsp.dct_rows(128, 128)
    assert rows @ rows.T == pytest.approx(np.eye(128), abs=1e-9)


def test_decibels():
    power = np.array([[[1.0, 0.1, 1e-12]]])
    assert dsp.power_to_db(power)[0, 0] == pytest.approx([0, -10, -80])
    assert dsp.power_to_db(np.zeros((1, 2, 2))) == pytest.approx(np.zeros((1, 2, 2)))
    short = dsp.fit_columns(np.array([[[3.0, 4.0], [5.0, 2.0]]]), 5)
    assert short[0].tolist() == [[2, 3, 4, 2, 2], [2, 5, 2, 2, 2]]


@pytest.mark.parametrize("rate", [48_000, 44_100, 32_000, 8_000])
def test_resampler_keeps_a_tone(rate):
    n = rate * 2
    tone = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    got = dsp.resample(tone, rate)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(got)) / 16_000)
    assert len(got) == 32_000
    error = (got - want)[800:-800]
    assert 10 * np.log10(np.mean(want**2) / np.mean(error**2)) > 90


def test_resampler_blocks_what_would_fold():
    tone = np.sin(2 * np.pi * 11_000 * np.arange(48_000) / 48_000)
    assert np.abs(dsp.resample(tone, 48_000)[500:-500]).max() < 1e-4


def test_feature_operators(spark):
    t = np.arange(144_000) / 48_000
    rows = [("h", i, 48_000, [float(v) for v in 0.3 * np.sin(2 * np.pi * f * t)]) for i, f in enumerate((300, 2500))]
    df = spark.createDataFrame(rows, "host_id string, frame_seq int, sample_rate int, samples array<float>")
    keys = ("host_id", "frame_seq")
    mel = {r.frame_seq: np.array(r.mel).reshape(60, 79) for r in features.cnn_features(df, keys).collect()}
    assert mel[0].mean(axis=1).argmax() < mel[1].mean(axis=1).argmax()
    cepstra = features.lfcc(df, keys).collect()
    assert all(np.array(r.lfcc).shape == (79, 20) for r in cepstra)
    low = features.resample(df, 16_000, keys).select("sample_rate", F.size("samples")).distinct()
    assert [tuple(r) for r in low.collect()] == [(16_000, 48_000)]


@pytest.mark.parametrize("pcm", [False, True])
@pytest.mark.parametrize("width", [None, 2])
def test_frames_over_chunk_borders(spark, width, pcm):
    from voxward.operators.timeline import Timeline

    sizes, rows, at = [5, 3, 11, 1, 8], [], 0
    stream = [float(v) for v in range(sum(sizes))]
    for i, size in enumerate(sizes):
        rows.append(("h", i, size and stream[at : at + size]))
        at += size
    chunks = spark.createDataFrame(rows, "host_id string, chunk_seq int, samples array<float>").selectExpr(
        "*", "timestamp_seconds(1000) AS captured_at", "10 AS sample_rate"
    )
    if pcm:  # the same samples as 16-bit bytes
        pair = F.udf(lambda x: np.asarray(x, "<i2").tobytes(), "binary")
        chunks = chunks.withColumn("samples", pair(F.coalesce("samples", F.array().cast("array<float>"))))
    line = Timeline(("host_id",), ("chunk_seq",), width)
    placed = framing.with_positions(chunks, "host_id", "chunk_seq", line)
    got = framing.to_frames(placed, n=4).orderBy("frame_seq").collect()
    frames = [np.frombuffer(r.samples, "<i2").tolist() if pcm else r.samples for r in got]
    assert frames == [stream[i : i + 4] for i in range(0, 28, 4)]
    tail = framing.to_frames(placed, n=6)
    assert tail.count() == 4


@pytest.mark.parametrize("width", [None, 5])
def test_frames_from_single_samples(spark, width):
    from voxward.operators.timeline import Timeline

    rows = [("a", i, float(i)) for i in range(19)] + [("b", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    line = Timeline(("k",), ("t",), width)
    got = framing.frames_from_samples(df, 4, "k", ("t",), "v", line).orderBy("frame_seq").collect()
    assert [r.samples for r in got] == [[float(4 * f + j) for j in range(4)] for f in range(4)]


def test_bytes_give_the_features_of_their_samples(spark):
    pcm = RNG.normal(0, 3000, 40_000).astype("<i2")
    rows = [("h", 0, 16_000, pcm.tobytes())]
    df = spark.createDataFrame(rows, "host_id string, frame_seq int, sample_rate int, samples binary")
    keys = ("host_id", "frame_seq")
    got = np.array(features.lfcc(df, keys).first().lfcc)
    assert got == pytest.approx(dsp.lfcc(pcm.astype(np.float32)[None] / 32768)[0], abs=1e-4)
    peak = quality.frame_quality(df, audio=True).first().max_amplitude
    assert peak == pytest.approx(np.abs(pcm / 32768).max())


def test_latest_n(spark):
    df = spark.range(100).selectExpr("'h' AS host_id", "id AS frame_seq")
    got = sorted(r.frame_seq for r in framing.latest_n(df).collect())
    assert got == list(range(80, 100))


@pytest.mark.parametrize("rate", [44_100, 11_025, 48_000])
def test_both_ways_to_resample_agree(rate, monkeypatch):
    x = RNG.normal(size=rate // 2)
    by_block = dsp.resample(x, rate)
    monkeypatch.setattr(dsp, "_MATRIX_CELLS", 0)
    assert dsp.resample(x, rate) == pytest.approx(by_block, abs=1e-12)


def test_odd_rates_need_little_memory():
    import tracemalloc

    tone = np.sin(2 * np.pi * 440 * np.arange(47_999) / 47_999)
    tracemalloc.start()
    got = dsp.resample(tone, 47_999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    assert got[500:-500] == pytest.approx(np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16_000)[500:-500], abs=1e-3)


def test_lfcc_frames_returns_every_cell(spark):
    from voxward.plans import adapters, catalog

    sf = "/root/testdata/sf0.001"
    want = {r.vec_id: np.array(r.lfcc) for r in features.lfcc(adapters.pcm_tones(spark, sf), ("vec_id", "label")).collect()}
    got = {r.vec_id: r for r in catalog.lfcc_frames(spark, sf).collect()}
    assert set(got) == set(want)
    for i, cells in want.items():
        assert np.array(got[i].cells) == pytest.approx(cells.ravel(), abs=1e-4)


def test_numbers_of_arrays_never_become_objects(spark):
    """Arrays go to Spark as NumPy has them, and NaN becomes NULL as in columns from pandas."""
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import types as T

    doubles = T.ArrayType(T.DoubleType())
    flat = [np.array([1.5, np.nan]), np.array([]), np.array([2.0])]
    want = pa.Array.from_pandas(pd.Series([list(v) for v in flat]), type=pa.list_(pa.float64()))
    assert features.arrow_column(flat, doubles).to_pylist() == want.to_pylist() == [[1.5, None], [], [2.0]]
    nested = [[np.array([1.0]), np.array([2.0, 3.0])], []]
    assert features.arrow_column(nested, T.ArrayType(doubles)).to_pylist() == [[[1.0], [2.0, 3.0]], []]
    assert features.arrow_column([], doubles).to_pylist() == []

    frames = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4], 32_000), (2, [], 32_000)], "k int, samples array<float>, sample_rate int")
    low = features.resample(frames, 16_000, ("k",)).orderBy("k")
    assert "MapInArrow" in low._jdf.queryExecution().toString()
    assert [len(r.samples) for r in low.collect()] == [2, 0]
