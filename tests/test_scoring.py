import numpy as np
import pytest
from pyspark.sql import functions as F

from voxward.functions import dsp, labels
from voxward.operators import scoring
from voxward.params import SilenceParams
from voxward.schemas import GMM_MODEL

RNG = np.random.default_rng(3)


def test_one_component_is_the_gaussian_density():
    a = RNG.normal(size=(3, 3))
    cov, mean, x = a @ a.T + np.eye(3), RNG.normal(size=3), RNG.normal(size=(5, 3))
    got = dsp.mixture_loglik(x, np.array([1.0]), mean[None], cov[None])
    d = x - mean
    exponent = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    want = -0.5 * (exponent + np.log(np.linalg.det(cov)) + 3 * np.log(2 * np.pi))
    assert got == pytest.approx(want)


def test_mixture_is_the_weighted_sum():
    x, weights = RNG.normal(size=(4, 2)), np.array([0.3, 0.7])
    means, covs = RNG.normal(size=(2, 2)), np.array([np.eye(2), 2 * np.eye(2)])
    parts = [np.exp(dsp.mixture_loglik(x, np.array([1.0]), means[i : i + 1], covs[i : i + 1])) for i in (0, 1)]
    want = np.log(0.3 * parts[0] + 0.7 * parts[1])
    assert dsp.mixture_loglik(x, weights, means, covs) == pytest.approx(want)


def test_confidence_golden(spark):
    rows = spark.createDataFrame([(0.0,), (2.0,), (-2.0,), (-2000.0,)], "d double")
    pct = labels.gmm_confidence(F.col("d"), F.lit(0.0))
    got = rows.select(pct, labels.model_label(pct)).collect()
    assert [r[0] for r in got] == pytest.approx([50.0, 73.105857863, 26.894142137, 0.0])
    assert [r[1] for r in got] == ["SUSPICIOUS", "AI", "HUMAN", "HUMAN"]


def test_fitted_pair_tells_two_groups_apart(spark):
    rows = [(i, bool(i % 2), RNG.normal(4.0 * (i % 2), 1, (6, 3)).tolist()) for i in range(80)]
    data = spark.createDataFrame(rows, "i int, is_ai boolean, lfcc array<array<double>>")
    mixtures = scoring.load_mixtures(scoring.fit_gmm_pair(data, "lfcc", F.col("is_ai")))
    assert all(m.weights.sum() == pytest.approx(1) for m in mixtures.values())
    logs = scoring.gmm_loglik(data, mixtures, ("i",)).collect()
    assert all((r.ll_ai > r.ll_human) == bool(r.i % 2) for r in logs)


def test_em_steps_from_a_start(spark):
    rows = [(i, None if i > 77 else bool(i % 2), RNG.normal(100 + 4.0 * (i % 4), 1, (6, 3)).tolist()) for i in range(80)] + [(99, True, [])]
    data = spark.createDataFrame(rows, "i int, is_ai boolean, lfcc array<array<double>>")
    begin = scoring.Mixture(np.array([0.3, 0.7]), np.array([[100.0] * 3, [107.0] * 3]), np.array([np.eye(3), 2 * np.eye(3)]))
    far = scoring.Mixture(np.array([0.5, 0.5]), np.array([[104.0] * 3, [1e6] * 3]), np.array([np.eye(3)] * 2))
    got = scoring.load_mixtures(scoring.fit_gmm_pair(data, "lfcc", F.col("is_ai"), max_iter=2, start={"human": begin, "ai": far}))
    want = begin
    x = np.vstack([r[2] for r in rows[:78] if not r[1]])
    for _ in range(2):
        density = np.stack([
            w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c))
            for w, m, c in zip(want.weights, want.means, want.covs, strict=True)
        ])
        share = density / density.sum(axis=0)
        means = [s @ x / s.sum() for s in share]
        covs = [((x - m) * s[:, None]).T @ (x - m) / s.sum() for s, m in zip(share, means, strict=True)]
        want = scoring.Mixture(share.sum(axis=1) / len(x), np.array(means), np.array(covs))
    for name in ("weights", "means", "covs"):
        assert getattr(got["human"], name) == pytest.approx(getattr(want, name), abs=1e-9)
    # A component far from all rows keeps its place and loses its weight.
    assert got["ai"].weights == pytest.approx([1, 0]) and got["ai"].means[1] == pytest.approx([1e6] * 3)


def test_trained_scorer(spark):
    rows = [(i, i % 2, RNG.normal(3.0 * (i % 2), 1, 4).tolist()) for i in range(100)]
    data = spark.createDataFrame(rows, "i int, y int, x array<float>")
    scorer = scoring.fit_logistic(data, "x", "y")
    got = scoring.score_features(data, scorer, ("i", "y"), "x").collect()
    right = sum((r.confidence_pct > 50) == bool(r.y) for r in got)
    assert right > 90 and all(r.inference_ms >= 0 for r in got)


def test_frames_get_a_result_per_model(spark):
    t = np.arange(48_000) / 16_000
    rows = [("h", i, 16_000, [float(v) for v in 0.2 * np.sin(2 * np.pi * 400 * (i + 1) * t)]) for i in range(3)]
    frames = spark.createDataFrame(rows, "host_id string, frame_seq int, sample_rate int, samples array<float>")
    mixture = scoring.Mixture(np.array([1.0]), np.zeros((1, 20)), np.eye(20)[None] * 9)
    other = scoring.Mixture(np.array([1.0]), np.ones((1, 20)), np.eye(20)[None] * 9)
    keys, middle = ("host_id", "frame_seq"), lambda x: x.reshape(len(x), -1).mean(axis=1)
    got = scoring.score_frames(frames, middle, {"human": mixture, "ai": other}, keys).collect()
    assert {(r.frame_seq, r.model) for r in got} == {(i, m) for i in range(3) for m in ("cnn", "gmm")}
    for r in got:
        x = dsp.fit_center(np.asarray(rows[r.frame_seq][3], np.float32))[None]
        if r.model == "cnn":
            assert r.confidence_pct == pytest.approx(100 * middle(dsp.cnn_features(x))[0], abs=1e-3)
        assert r.label == ("HUMAN" if r.confidence_pct < 50 else "SUSPICIOUS" if r.confidence_pct < 70 else "AI")
    quiet = spark.createDataFrame([("h", 9, 16_000, [0.0] * 48_000)], frames.schema)
    measured = scoring.measure_frames(frames.union(quiet), middle, None, keys, SilenceParams(sample_rate=16_000))
    seen = {r.frame_seq: (r.is_silent, r.cnn_pct is None) for r in measured.collect()}
    assert seen == {0: (False, False), 1: (False, False), 2: (False, False), 9: (True, True)}
    assert scoring.model_results(measured, keys, ("cnn",)).count() == 3
    only = scoring.score_frames(frames, middle, None, keys)
    assert {r.model for r in only.collect()} == {"cnn"}
    with pytest.raises(ValueError):
        scoring.score_frames(frames)


def test_latency_quantiles(spark):
    times = [("cnn", v / 100) for v in range(1, 1001)] + [("gmm", 5.0), ("gmm", None)]
    df = spark.createDataFrame(times, "model string, inference_ms double")
    got = {r.model: r for r in scoring.latency_stats(df).collect()}
    assert (got["cnn"].n, round(got["cnn"].p50_ms, 2), round(got["cnn"].p95_ms, 2)) == (1000, 5.0, 9.5)
    assert got["cnn"].avg_ms == pytest.approx(5.005)
    assert (got["gmm"].n, got["gmm"].p95_ms) == (1, 5.0)
