"""Frames scored from what was measured of them, without reading their audio again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxward.operators import scoring
from voxward.plans import batch


def test_audio_is_read_once_for_fit_and_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    loud = [(i, i % 2, 16_000, rng.normal(0, 0.2, 48_000).astype(np.float32).tolist()) for i in range(12)]
    quiet = [(12, 0, 16_000, [0.0] * 48_000), (13, 1, 16_000, [0.0] * 48_000)]
    frames = spark.createDataFrame(loud + quiet, "i int, side int, sample_rate int, samples array<float>")
    middle = scoring.LogisticScorer(np.full(60 * 79, 1 / (60 * 79)), -0.5)
    batch.measure(frames, middle, ("i", "side")).write.parquet(str(tmp_path / "measured"))
    measured = spark.read.parquet(str(tmp_path / "measured"))
    # Silent frames are in the fit, as they were, but get no scores.
    assert measured.filter(F.size("lfcc") == 79).count() == 14
    mixtures = scoring.load_mixtures(scoring.fit_gmm_pair(measured, "lfcc", F.col("side") == 1, max_iter=2))
    got = scoring.score_measured(measured, mixtures, ("i",))
    want = batch.batch_predict(frames, middle, mixtures, ("i",))
    assert got.columns == want.columns
    rows = [sorted((r.i, r.model, r.label, r.confidence_pct) for r in df.collect()) for df in (got, want)]
    assert [r[:3] for r in rows[0]] == [r[:3] for r in rows[1]] and len(rows[0]) == 24
    assert [r[3] for r in rows[0]] == pytest.approx([r[3] for r in rows[1]], abs=1e-9)
    assert got.filter("inference_ms IS NULL").count() == 0
