"""The registered queries: each operator over the whole of its mapped tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.functions import signal
from voxward.operators import (
    caller,
    calls,
    decision,
    detection,
    features,
    framing,
    quality,
    rollup,
    scoring,
)
from voxward.operators.timeline import Timeline
from voxward.params import AI, APP_PROFILE
from voxward.plans import adapters as A
from voxward.plans import batch
from voxward.session import closed, delete_at_end, drain, materialize, rocksdb, shared_folder
from voxward.sources.alerts import AlertSink
from voxward.sources.blocklist import Blocklist
from voxward.sources.warnings import WarningLog
from voxward.sources.wav import read_frames, write_wav_frames
from voxward.streaming.alerts import voice_alert_stream
from voxward.streaming.align import align_stream
from voxward.streaming.blocklist import blocklist_stream
from voxward.streaming.caller import caller_id_stream, caller_warning_stream
from voxward.streaming.decisions import decision_history, decision_stream, running_state
from voxward.streaming.frames import frames_in_calls_stream
from voxward.streaming.monitor import call_monitor_stream, monitor_history
from voxward.streaming.recent import latest_n_stream, newest_frames
from voxward.streaming.rollup import rollup_stream

ORDER = ("ts", "event_id")
POLL_ORDER = ("poll_ts", "event_id")
DIGITS = 9
#: The live queries run over whole tables at once, where the state of each key by itself costs more than its rows.
BUCKETS = 2048


def r(col: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def _score_line(df: DataFrame) -> Timeline:
    return Timeline.chunked(df, ("call_id",), ORDER)


def _poll_line(df: DataFrame) -> Timeline:
    return Timeline.chunked(df, ("host_id",), POLL_ORDER)


# Detection


def voip_source_filter(spark: SparkSession, sf: str) -> DataFrame:
    return detection.voip_output_pids(A.part_sessions(spark, sf), A.PART_KEYWORDS)


def voip_mic_pids(spark: SparkSession, sf: str) -> DataFrame:
    return detection.voip_mic_pids(A.part_sessions(spark, sf), A.PART_KEYWORDS)


def voip_two_method_union(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.detect_voip_sources(
        A.part_sessions(spark, sf),
        A.part_processes(spark, sf),
        A.part_mic(spark, sf),
        A.PART_KEYWORDS,
        root="apps",
    )
    return found.withColumn("chain", F.concat_ws(">", "chain"))


def mic_usage_tree(spark: SparkSession, sf: str) -> DataFrame:
    return detection.mic_in_use(A.part_mic(spark, sf), A.part_processes(spark, sf), root="apps")


def poll_status(spark: SparkSession, sf: str) -> DataFrame:
    status = detection.poll_status(
        A.part_sessions(spark, sf),
        A.part_processes(spark, sf),
        A.part_mic(spark, sf),
        A.PART_KEYWORDS,
        root="apps",
    )
    loose = detection.is_call_active(status)
    strict = detection.is_call_active_strict(loose.withColumnRenamed("call_active", "active_loose"))
    return strict.withColumnRenamed("call_active", "active_strict")


def mic_in_use_by_voip(spark: SparkSession, sf: str) -> DataFrame:
    return detection.mic_in_use_by_voip(A.part_sessions(spark, sf), A.PART_KEYWORDS)


def _latched(spark: SparkSession, sf: str, require_mic: bool = True) -> tuple[DataFrame, Timeline]:
    polls = A.polls(spark, sf)
    line = _poll_line(polls)
    return calls.latch(polls, require_mic, line), line


def hysteresis_latch(spark: SparkSession, sf: str) -> DataFrame:
    latched, _ = _latched(spark, sf)
    return latched.select("host_id", "event_id", "active")


def loose_latch(spark: SparkSession, sf: str) -> DataFrame:
    latched, _ = _latched(spark, sf, require_mic=False)
    return latched.select("host_id", "event_id", "active", "was_active")


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    latched, _ = _latched(spark, sf)
    edges = calls.call_edges(latched).filter(F.col("edge").isNotNull())
    return edges.select("host_id", "event_id", "poll_ts", "edge")


def _sessions(spark: SparkSession, sf: str) -> tuple[DataFrame, Timeline]:
    latched, line = _latched(spark, sf)
    return calls.call_sessions(calls.call_edges(latched), line), line


def call_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = _sessions(spark, sf)
    return found.withColumn("duration_s", r("duration_s", 3))


def frames_in_calls(spark: SparkSession, sf: str) -> DataFrame:
    found, line = _sessions(spark, sf)
    captured = A.polls(spark, sf).select("host_id", F.col("poll_ts").alias("captured_at"), "event_id")
    return calls.assign_calls(captured, found, tie=("event_id",), width=line.width)


# Caller identity and blocklist


def first_caller_id(spark: SparkSession, sf: str) -> DataFrame:
    return caller.first_caller_id(A.ui_text(spark, sf))


def caller_hash(spark: SparkSession, sf: str) -> DataFrame:
    return caller.caller_hashes(first_caller_id(spark, sf))


def blocklist_lookup(spark: SparkSession, sf: str) -> DataFrame:
    looked = caller.lookup_blocklist(A.order_calls(spark, sf), A.blocklist(spark, sf))
    return looked.select("call_id", "caller_hash", "is_caller_flagged")


def blocklist_upsert(spark: SparkSession, sf: str) -> DataFrame:
    flags = caller.calls_to_flag(A.order_calls(spark, sf))
    merged = caller.upsert_flags(A.blocklist(spark, sf), flags)
    return merged.withColumn("strike_count", F.col("strike_count").cast("double"))


# Frames and signal features


def fixed_frames(spark: SparkSession, sf: str) -> DataFrame:
    events = A.table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), *ORDER, "value"
    )
    cut = framing.frames_from_samples(events, 8, "call_id", ORDER, "value", _score_line(events))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return cut.select(
        "call_id",
        "frame_seq",
        F.size("samples").cast("bigint").alias("n"),
        r(total, 6).alias("total"),
        F.array_min("samples").alias("low"),
        F.array_max("samples").alias("high"),
        F.element_at("samples", 1).alias("first"),
    )


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.frame_quality(A.vectors(spark, sf), A.VECTOR_SILENCE)


def silence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("vec_id", "silence_ratio", "is_silent")


def max_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("vec_id", F.col("max_amplitude").cast("double"))


def drop_silent(spark: SparkSession, sf: str) -> DataFrame:
    kept = quality.drop_silent(A.vectors(spark, sf), A.VECTOR_SILENCE)
    return kept.select("vec_id", "label", "silence_ratio")


def _shape(x: Column, name: str) -> list[Column]:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return [
        F.size(x).cast("bigint").alias(f"{name}_n"),
        r(total, 6).alias(f"{name}_sum"),
        r(F.element_at(x, 1).cast("double"), 6).alias(f"{name}_first"),
        r(F.element_at(x, -1).cast("double"), 6).alias(f"{name}_last"),
    ]


def fit_center(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("samples")
    cut, padded = signal.fit_center(x, 41), signal.fit_center(x, 81)
    inner = F.slice(padded, 9, 64)
    return A.vectors(spark, sf).select(
        "vec_id", *_shape(cut, "cut"), *_shape(padded, "pad"), *_shape(inner, "inner")
    )


def fit_head(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("samples")
    cut, padded = signal.fit_head(x, 41), signal.fit_head(x, 81)
    inner = F.slice(padded, 1, 64)
    return A.vectors(spark, sf).select(
        "vec_id", *_shape(cut, "cut"), *_shape(padded, "pad"), *_shape(inner, "inner")
    )


def rms_normalize(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("samples")
    return A.vectors(spark, sf).select(
        "vec_id",
        *_shape(signal.normalize_rms(x), "rms"),
        *_shape(signal.normalize_dc_rms_clip(x), "dc"),
        *_shape(signal.minmax01(x), "unit"),
    )


def downmix(spark: SparkSession, sf: str) -> DataFrame:
    return A.vectors(spark, sf).select("vec_id", *_shape(signal.downmix(F.col("samples"), 2), "mono"))


def pcm16(spark: SparkSession, sf: str) -> DataFrame:
    return A.vectors(spark, sf).select(
        "vec_id", F.concat_ws(",", signal.pcm16(F.col("samples")).cast("array<string>")).alias("pcm")
    )


def wav_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as numbered WAV files, two rates and two recordings a host, and read back as frames.

    Files hold 64 samples, frames take 4 ms: one or two to a file.
    """
    at = F.col("vec_id") * 7919 % 86_400_000
    made = A.table(spark, sf, "embeddings").select(
        F.concat(F.lit("rec"), "label", F.lit("-"), F.col("vec_id") % 2).alias("call_id"),
        F.col("vec_id").cast("int").alias("frame_seq"),
        F.timestamp_millis(at).alias("captured_at"),
        F.when(F.col("vec_id") % 4 < 2, 8_000).otherwise(16_000).alias("sample_rate"),
        F.col("embedding").alias("samples"),
    )
    folder = f"{shared_folder(spark)}/wav-{uuid.uuid4().hex}"
    write_wav_frames(made, folder)
    delete_at_end(spark, folder)
    frames = read_frames(spark, f"{folder}/*", frame_s=0.004, pcm=False)
    pcm = F.transform("samples", lambda v: F.round(v * 32_768).cast("bigint"))
    return frames.select(
        F.col("host_id").alias("call_id"),
        F.element_at(F.split("recording", "/"), -1).alias("recording"),
        "frame_seq",
        "sample_rate",
        F.date_format("captured_at", "HH:mm:ss.SSSSSS").alias("taken"),
        F.aggregate(pcm, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
        F.concat_ws(",", pcm.cast("array<string>")).alias("pcm"),
    )


def audio_silence(spark: SparkSession, sf: str) -> DataFrame:
    """The Arrow form on three-second frames at 48 kHz."""
    checked = quality.frame_quality(A.tones(spark, sf), audio=True)
    return checked.select("vec_id", r("silence_ratio").alias("silence_ratio"), "is_silent")


def pcm_silence(spark: SparkSession, sf: str) -> DataFrame:
    """The same frames as 16-bit PCM bytes, with their loudest sample."""
    checked = quality.frame_quality(A.pcm_tones(spark, sf), audio=True)
    peak = r(F.col("max_amplitude").cast("double"))
    return checked.select("vec_id", r("silence_ratio").alias("silence_ratio"), "is_silent", peak.alias("peak"))


def _cells(df: DataFrame, name: str, outer: str, inner: str) -> DataFrame:
    """One row per cell of an array of arrays."""
    rows = df.select("vec_id", F.posexplode(name).alias(outer, "_row"))
    return rows.select("vec_id", outer, F.posexplode("_row").alias(inner, "value"))


def mel_power(spark: SparkSession, sf: str) -> DataFrame:
    mel = features.mel_spectrogram(A.rated_vectors(spark, sf, 16_000), A.VECTOR_MEL, ("vec_id",))
    cells = _cells(mel, "mel", "band", "col")
    return cells.select("vec_id", "band", "col", r(F.col("value") * 1000).alias("power"))


def mel_decibels(spark: SparkSession, sf: str) -> DataFrame:
    """Decibels below the maximum and the same rescaled to [0, 1]."""
    mel = features.mel_spectrogram(A.rated_vectors(spark, sf, 16_000), A.VECTOR_MEL, ("vec_id",), db=True)
    flat = mel.select("vec_id", "mel", signal.minmax01(F.flatten("mel")).alias("_unit"))
    cells = flat.select("vec_id", "_unit", F.posexplode("mel").alias("band", "_row"))
    cells = cells.select("vec_id", "_unit", "band", F.posexplode("_row").alias("col", "db"))
    unit = F.get("_unit", F.col("band") * 5 + F.col("col"))
    return cells.select("vec_id", "band", "col", r("db", 6).alias("db"), r(unit, 6).alias("unit"))


def cepstra(spark: SparkSession, sf: str) -> DataFrame:
    made = features.cepstra(A.rated_vectors(spark, sf, 16_000), A.VECTOR_MEL, 4, ("vec_id",))
    cells = _cells(made, "cepstra", "col", "k")
    return cells.select("vec_id", "col", "k", r("value", 6).alias("value"))


def resample(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors taken as 48 kHz samples, at a third of that rate."""
    exact = F.col("samples").cast("array<double>")
    vectors = A.rated_vectors(spark, sf, 48_000).withColumn("samples", exact)
    low = features.resample(vectors, 16_000, ("vec_id",))
    cells = low.select("vec_id", F.posexplode("samples").alias("i", "value"))
    return cells.select("vec_id", "i", r("value").alias("value"))


def resample_tones(spark: SparkSession, sf: str) -> DataFrame:
    low = features.resample(A.pcm_tones(spark, sf), 16_000, ("vec_id", "label"))
    return low.select(
        "vec_id",
        "sample_rate",
        F.size("samples").alias("n"),
        r(F.array_min("samples").cast("double"), 4).alias("low"),
        r(F.array_max("samples").cast("double"), 4).alias("high"),
    )


def mel_frames(spark: SparkSession, sf: str) -> DataFrame:
    mel = features.cnn_features(A.pcm_tones(spark, sf), ("vec_id", "label"))
    return mel.select("vec_id", "label", *_shape(F.col("mel"), "mel"))


def lfcc_frames(spark: SparkSession, sf: str) -> DataFrame:
    cepstra = features.lfcc(A.pcm_tones(spark, sf), ("vec_id", "label"))
    return cepstra.select(
        "vec_id", "label", F.size("lfcc").alias("columns"), *_shape(F.element_at("lfcc", 40), "mid"),
        F.transform(F.flatten("lfcc"), lambda v: r(v, 4)).alias("cells"),
    )


# Scoring

# Two components of four dimensions per mixture, for the checked query.
HUMAN_MIX = scoring.Mixture(
    np.array([0.6, 0.4]),
    np.array([[0.05, -0.05, 0.0, 0.1], [-0.1, 0.1, 0.05, 0.0]]),
    np.array([np.diag([0.02, 0.03, 0.025, 0.02]), np.diag([0.015, 0.02, 0.03, 0.025])]),
)
AI_MIX = scoring.Mixture(
    np.array([0.5, 0.5]),
    np.array([[0.0, 0.05, -0.05, 0.0], [0.1, 0.0, 0.1, -0.1]]),
    np.array([np.diag([0.01, 0.02, 0.015, 0.03]), np.diag([0.03, 0.01, 0.02, 0.02])]),
)


def _in_fours(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(x, i * 4 + 1, F.lit(4)))


def gmm_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as sixteen rows of four features under the two mixtures."""
    rows = A.vectors(spark, sf).select("vec_id", _in_fours(F.col("samples")).alias("lfcc"))
    logs = scoring.gmm_loglik(rows, {"human": HUMAN_MIX, "ai": AI_MIX}, ("vec_id",))
    pct = scoring.gmm_confidence(F.col("ll_ai"), F.col("ll_human"))
    return logs.select(
        "vec_id",
        r("ll_human", 6).alias("ll_human"),
        r("ll_ai", 6).alias("ll_ai"),
        r(pct, 6).alias("confidence_pct"),
        scoring.model_label(pct).alias("label"),
    )


def fit_gmm_pair(spark: SparkSession, sf: str) -> DataFrame:
    """What any fit to the vectors' rows of four must keep; label below 5 stands for AI.

    However many components there are, their weights add up to one, and as a
    whole they have the rows' mean and variance.
    """
    rows = A.vectors(spark, sf).select("label", _in_fours(F.col("samples")).alias("lfcc"))
    rows = materialize(rows, "fours")
    found = []
    for k in (2, 3):
        fitted = scoring.fit_gmm_pair(rows, "lfcc", F.col("label") < 5, k=k)
        cells = fitted.select("model", "weight", "cov", F.posexplode("mean").alias("i", "mean"))
        own = F.get(F.get("cov", F.col("i")), F.col("i")) + F.col("mean") * F.col("mean")
        mean = F.sum(F.col("weight") * F.col("mean"))
        found.append(
            cells.groupBy("model", F.lit(k).alias("k"), "i").agg(
                r(F.sum("weight"), 6).alias("weight"),
                r(mean, 6).alias("mean"),
                r(F.sum(F.col("weight") * own) - mean * mean, 6).alias("variance"),
            )
        )
    return found[0].union(found[1])


def refit_gmm_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The two given mixtures after one step over the vectors' rows of four, cell by cell."""
    rows = A.vectors(spark, sf).select("label", _in_fours(F.col("samples")).alias("lfcc"))
    fitted = scoring.fit_gmm_pair(rows, "lfcc", F.col("label") < 5, max_iter=1, start={"human": HUMAN_MIX, "ai": AI_MIX})
    by_row = fitted.select("model", "component", "weight", "mean", F.posexplode("cov").alias("i", "cov_row"))
    cells = by_row.select("*", F.posexplode("cov_row").alias("j", "cov_cell"))
    mean = F.get("mean", F.col("i"))
    return cells.select(
        "model", "component", "i", "j", r("weight", 6).alias("weight"), r(mean, 6).alias("mean"), r("cov_cell", 6).alias("cov")
    )


PENALTY = 0.01


def train_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """The classifier trained on all vectors, checked by its optimum; label below 5 stands for AI.

    At the optimum the scores' moment with each feature (-1: with one) is that of the labels, less the pull of the
    penalty. Where both agree to 0.0001 the labels' moment is given, else the scores', which no other weights bring near.
    """
    truth = (F.col("label") < 5).cast("int")
    data = materialize(A.vectors(spark, sf).select("vec_id", truth.alias("y"), "samples", F.col("samples").alias("x")), "labelled")
    fitted = scoring.fit_logistic(data, "samples", "y", max_iter=500, penalty=PENALTY, tol=1e-12)
    scored = scoring.score_features(data, fitted, ("vec_id", "y", "x"), "samples")
    ones = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("v")))
    each = F.transform("x", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v")))
    cells = scored.select("y", (F.col("confidence_pct") / 100).alias("p"), F.inline(F.concat(ones, each)))
    weights = F.element_at(F.array(F.lit(0.0), *[F.lit(float(w)) for w in fitted.weights]), F.col("i") + 2)
    sums = cells.groupBy("i").agg(
        F.avg(F.col("p") * F.col("v")).alias("scores"),
        F.avg(F.col("y") * F.col("v")).alias("labels"),
        F.var_samp("v").alias("variance"),
    )
    model = F.col("scores") + F.lit(PENALTY) * F.col("variance") * weights
    return sums.select("i", r(F.when(F.abs(model - F.col("labels")) < 1e-4, F.col("labels")).otherwise(model), 6).alias("moment"))


# Fixed weights of the stand-in classifier over 64 samples.
VECTOR_SCORER = scoring.LogisticScorer(np.array([(i % 7 - 3) / 10 for i in range(64)]), 0.1)


def score_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier with given weights, applied to all vectors."""
    scored = scoring.score_features(A.vectors(spark, sf), VECTOR_SCORER, ("vec_id",), "samples")
    return scored.select("vec_id", r("confidence_pct", 4).alias("confidence_pct"), "label")


def batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Audio frames to results of both models in one pass."""
    tones = A.pcm_tones(spark, sf)
    middle = scoring.LogisticScorer(np.full(60 * 79, 1 / (60 * 79)), -0.5)
    # The fits read the cepstra many times, and the scores once more, so they are written once; the audio is in one pass.
    measured = materialize(batch.measure(tones, middle, ("vec_id", "label")), "measured")
    mixtures = scoring.load_mixtures(
        scoring.fit_gmm_pair(measured, "lfcc", F.col("label") < 5, max_iter=5)
    )
    scored = scoring.score_measured(measured, mixtures, ("vec_id",))
    return scored.select("vec_id", "model", r("confidence_pct", 4).alias("confidence_pct"), "label")


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    times = A.table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("value").alias("inference_ms")
    )
    stats = scoring.latency_stats(times)
    return stats.select(
        "model",
        "n",
        r("avg_ms", 6).alias("avg_ms"),
        r("p50_ms", 2).alias("p50_ms"),
        r("p95_ms", 2).alias("p95_ms"),
    )


def latest_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    return decision.latest_per_tick(A.results(spark, sf), tie=("event_id",))


def latest_n(spark: SparkSession, sf: str) -> DataFrame:
    """The newest twenty frames per recorder, the recorder's capacity."""
    newest = framing.latest_n(A.frames(spark, sf), key="call_id", order=ORDER)
    return newest.select("call_id", "event_id")


# Decisions


def _aligned(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    found = A.results(spark, sf)
    line = Timeline.chunked(found, ("call_id",), ("tick",))
    updates = decision.align_scores(found, mode, line=line)
    return updates.select("call_id", "tick", "result_ts", r("cnn").alias("cnn"), r("gmm").alias("gmm"))


def align_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf, "per_result")


def align_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf, "per_frame")


def ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    scores = A.scores(spark, sf)
    return scores.select(
        "event_id",
        r(decision.ensemble("cnn", "gmm")).alias("default_score"),
        r(decision.ensemble("cnn", "gmm", APP_PROFILE)).alias("app_score"),
    )


def _decided(spark: SparkSession, sf: str, with_scores: bool = False) -> DataFrame:
    scores = A.scores(spark, sf)
    line = _score_line(scores)
    if with_scores:
        return decision.buffer_scores(scores, APP_PROFILE, line=line)
    return decision.decision_engine(scores, APP_PROFILE, line=line)


def decision_engine(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select(
        "call_id",
        "event_id",
        r("ensemble_score").alias("ensemble_score"),
        r("average_score").alias("average_score"),
        "label",
        "should_notify",
        "buffer_full",
        "frames_buffered",
    )


def buffer_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf, with_scores=True).select(
        "event_id",
        F.size("buffer_scores").cast("bigint").alias("n"),
        r(F.element_at("buffer_scores", 1)).alias("oldest"),
        r(F.element_at("buffer_scores", -1)).alias("newest"),
        F.concat_ws("|", "buffer_labels").alias("labels"),
    )


def current_state(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a call; those without events never got an update."""
    everyone = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"))
    state = decision.current_state(_decided(spark, sf), everyone, order=ORDER)
    return state.withColumn("average_score", r("average_score"))


# Roll-up, alerts and the whole


def _heard(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions over the frames that are not silent."""
    heard = A.scores(spark, sf).filter(~F.col("is_silent"))
    return decision.decision_engine(heard, APP_PROFILE, line=_score_line(heard))


def call_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = rollup.call_rollup(_heard(spark, sf), A.frames(spark, sf), order=ORDER)
    return rolled.withColumn("last_confidence", r("last_confidence", 6))


def call_summary(spark: SparkSession, sf: str) -> DataFrame:
    everyone = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"))
    rolled = rollup.call_rollup(_heard(spark, sf), A.frames(spark, sf), order=ORDER)
    return rollup.call_summary(rollup.complete_calls(everyone, rolled)).select(
        "call_id", "frames_processed", "summary", "frames_text"
    )


def _calls(spark: SparkSession, sf: str, decided: DataFrame) -> DataFrame:
    """Users as calls from first to last event, with roll-up and blocklist check."""
    spans = A.frames(spark, sf).groupBy("call_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    rolled = rollup.call_rollup(decided, A.frames(spark, sf), order=ORDER)
    full = rollup.complete_calls(spans, rolled)
    full = full.withColumn("caller_hash", A.customer_hash("call_id"))
    return caller.lookup_blocklist(full, A.blocklist(spark, sf))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    decided = _heard(spark, sf)
    return rollup.alerts(_calls(spark, sf, decided), decided, ts="ts")


def caller_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.caller_warnings(_calls(spark, sf, _heard(spark, sf)))


def detail_text(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.display_columns(_decided(spark, sf)).select(
        "event_id", "display_label", "severity", "detail_text"
    )


def call_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: decisions rolled up per call and checked against the blocklist."""
    found = _calls(spark, sf, _heard(spark, sf))
    return found.select(
        "call_id",
        "start_ts",
        "end_ts",
        "is_caller_flagged",
        "call_was_ai",
        "frames_processed",
        "last_label",
        r("last_confidence", 6).alias("last_confidence"),
    )


# Streams over the events, closed so that nothing stays behind the watermark.


def live_decisions(spark: SparkSession, sf: str) -> DataFrame:
    scores = closed(A.scores(spark, sf, A.live), "ts", "call_id")
    stream = decision_stream(scores, APP_PROFILE, ts="ts", tie="event_id", delay="1 hour", idle_s=None, buckets=BUCKETS)
    return drain(stream, "decisions").select(
        "call_id",
        F.col("tie").alias("event_id"),
        "update_seq",
        r("average_score").alias("average_score"),
        "label",
        "should_notify",
        "frames_buffered",
        "call_was_ai",
    )


def live_calls(spark: SparkSession, sf: str) -> DataFrame:
    stream = call_monitor_stream(closed(A.polls(spark, sf, A.live), "poll_ts", "host_id"), delay="1 hour", tie="event_id", buckets=BUCKETS)
    found = drain(stream, "calls")
    start, end = F.unix_micros("start_ts"), F.unix_micros("end_ts").cast("double")
    return found.select("call_id", "host_id", "edge", start.alias("start_us"), end.alias("end_us"))


def _as_given(ts: str) -> Column:
    """A time of a stream in the type the tables have."""
    return F.col(ts).cast("timestamp_ntz").alias(ts)


def _streamed(df: DataFrame, name: str, ts: str, key: str) -> DataFrame:
    """A table, written once, as a closed stream of its files."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    delete_at_end(df.sparkSession, folder)
    return closed(df.sparkSession.readStream.schema(df.schema).parquet(folder), ts, key)


def live_frames_in_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Frames assigned to the calls whose edges another job wrote, both as streams."""
    polls = closed(A.polls(spark, sf, A.live), "poll_ts", "host_id")
    edges = drain(call_monitor_stream(polls, delay="1 hour", tie="event_id", buckets=BUCKETS), "edges")
    captured = A.polls(spark, sf, A.live).select("host_id", F.col("poll_ts").alias("captured_at"), "event_id")
    stream = frames_in_calls_stream(
        closed(captured, "captured_at", "host_id"), _streamed(edges, "edges", "start_ts", "host_id"), tie="event_id", delay="1 hour",
        buckets=BUCKETS,
    )
    found = drain(stream, "frames-in-calls")
    return found.select("call_id", "host_id", _as_given("captured_at"), "event_id")


def _rolled(spark: SparkSession, sf: str, ends: DataFrame) -> DataFrame:
    frames = closed(A.scores(spark, sf, A.live), "ts", "call_id")
    stream = rollup_stream(frames, _streamed(ends, "ends", "end_ts", "call_id"), APP_PROFILE, tie="event_id", delay="1 hour", buckets=BUCKETS)
    return drain(stream, "rollups")


def live_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Users as calls that end with their last event."""
    ends = A.frames(spark, sf).groupBy("call_id").agg(F.max("ts").alias("end_ts"))
    rolled = _rolled(spark, sf, ends)
    return rolled.drop("end_ts").withColumn("last_confidence", r("last_confidence", 6))


def live_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as calls that end when the last event of all has come."""
    over = A.frames(spark, sf).agg(F.max("ts")).first()[0]
    everyone = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"), F.lit(over).alias("end_ts"))
    rolled = _rolled(spark, sf, everyone)
    return rollup.call_summary(rolled).select("call_id", "frames_processed", "summary", "frames_text")


def live_align(spark: SparkSession, sf: str) -> DataFrame:
    """Score updates per hour from raw results."""
    found = closed(A.results(spark, sf, A.live).drop("tick"), "result_ts", "call_id")
    stream = align_stream(found, 3_600_000, tie="event_id", delay="1 hour", idle_s=None)
    at = _as_given("result_ts")
    hour = F.unix_date(F.to_date(at)).cast("bigint") * 24 + F.hour(at)
    return drain(stream, "updates").select("call_id", hour.alias("tick"), at, r("cnn").alias("cnn"), r("gmm").alias("gmm"))


def live_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """All alerts as two jobs deliver them to one sink: about callers and ended calls, and about voices."""
    folder = f"{shared_folder(spark)}/live-alerts-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    spans = A.frames(spark, sf).groupBy("call_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    spans = materialize(spans, "spans")
    rolled = _rolled(spark, sf, spans.select("call_id", "end_ts")).drop("end_ts")
    ended = spans.join(rolled, "call_id").withColumn("caller_hash", A.customer_hash("call_id"))
    begun = ended.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("call_id", "start_ts", "caller_hash") else f.name for f in ended.schema])
    calls_folder = f"{folder}/calls"
    begun.union(ended).write.parquet(calls_folder)
    store, sink = Blocklist(f"{folder}/list"), AlertSink(f"{folder}/alerts")
    store.create(A.blocklist(spark, sf).withColumn("last_flagged_at", F.col("last_flagged_at").cast("timestamp")))
    events = spark.readStream.schema(ended.schema).parquet(calls_folder)
    heard = A.scores(spark, sf, A.live).filter(~F.col("is_silent"))
    with rocksdb(spark):
        blocklist_stream(events, store, sink.path, f"{folder}/calls-checkpoint", "calls").awaitTermination()
        decisions = decision_stream(closed(heard, "ts", "call_id"), APP_PROFILE, ts="ts", tie="event_id", delay="1 hour", idle_s=None, buckets=BUCKETS)
        voice_alert_stream(decisions, sink, f"{folder}/voices-checkpoint", "voices").awaitTermination()
    return sink.read(spark).select("call_id", _as_given("ts"), "kind", "title", "message")


def live_caller_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Callers found in the windows of users' calls, and the warnings from start to end of the listed ones."""
    folder = f"{shared_folder(spark)}/live-warnings-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    spans = A.frames(spark, sf).groupBy("call_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    spans = materialize(spans, "spans")
    started = spans.select("call_id", F.lit("start").alias("edge"), "start_ts", F.lit(None).cast("timestamp_ntz").alias("end_ts"))
    edges = _streamed(started.unionByName(spans.withColumn("edge", F.lit("end"))), "edges", "start_ts", "call_id")
    texts = A.walks(closed(A.scores(spark, sf, A.live).select("call_id", "ts"), "ts", "call_id"), "ts")
    store, log = Blocklist(f"{folder}/list"), WarningLog(f"{folder}/warnings")
    listed = A.blocklist(spark, sf, A.phone_hash)
    store.create(listed.withColumn("last_flagged_at", F.col("last_flagged_at").cast("timestamp")))
    with rocksdb(spark):
        found = caller_id_stream(texts, edges, delay="1 hour")
        caller_warning_stream(found, store, log, f"{folder}/checkpoint", "warnings").awaitTermination()
    return log.read(spark).select("call_id", _as_given("shown_from"), _as_given("shown_to"))


def live_current_state(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a call, from the state that a decision job left."""
    scores = closed(A.scores(spark, sf, A.live), "ts", "call_id")
    stream = decision_stream(scores, APP_PROFILE, ts="ts", tie="event_id", delay="1 hour", idle_s=None, buckets=BUCKETS)
    _, checkpoint = drain(stream, "decisions", keep_state=True)
    everyone = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"))
    return running_state(spark, checkpoint, APP_PROFILE, everyone, bucketed="bigint").withColumn("average_score", r("average_score"))


def live_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    """The newest twenty frames per recorder, from the state of the job that keeps them."""
    frames = A.scores(spark, sf, A.live).select("call_id", "ts", "event_id")
    _, checkpoint = drain(latest_n_stream(frames, key="call_id", ts="ts", tie="event_id"), "rings", keep_state=True)
    return newest_frames(spark, checkpoint, key="call_id", ts="ts", tie="event_id").select("call_id", "event_id")


def _half_time(spark: SparkSession, sf: str) -> Column:
    """The middle between the first and the last event."""
    first, last = A.table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    return F.lit(first + (last - first) / 2)


def live_decisions_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions in batch over the earlier half of the events, and by a job that goes on from there over the later one."""
    half = _half_time(spark, sf)
    past = A.scores(spark, sf).filter(F.col("ts") < half)
    line = _score_line(past)
    decided = materialize(decision.buffer_scores(past, APP_PROFILE, line=line), "decided")
    coming = closed(A.scores(spark, sf, A.live).filter(F.col("ts") >= half), "ts", "call_id")
    stream = decision_stream(
        coming, APP_PROFILE, ts="ts", tie="event_id", delay="1 hour", idle_s=None, history=decision_history(decided, ORDER),
        buckets=BUCKETS,
    )
    later = drain(stream, "decisions")
    numbered = line.number(decided, "update_seq")
    numbered = line.running_count(numbered, "ai_so_far", F.col("label") == AI)
    columns = ["call_id", "event_id", "update_seq", "average_score", "label", "should_notify", "frames_buffered", "call_was_ai"]
    earlier = numbered.withColumn("call_was_ai", F.col("ai_so_far") > 0).select(columns)
    both = earlier.unionByName(later.withColumnRenamed("tie", "event_id").select(columns))
    return both.withColumn("average_score", r("average_score"))


def live_calls_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Starts and ends of calls, found in batch over the earlier half of the polls and by a job that goes on from there."""
    half = _half_time(spark, sf)
    past = A.polls(spark, sf).filter(F.col("poll_ts") < half)
    line = _poll_line(past)
    edges = materialize(calls.call_edges(calls.latch(past, line=line)), "edges")
    coming = closed(A.polls(spark, sf, A.live).filter(F.col("poll_ts") >= half), "poll_ts", "host_id")
    later = drain(call_monitor_stream(coming, delay="1 hour", tie="event_id", history=monitor_history(edges, POLL_ORDER), buckets=BUCKETS), "calls")
    found = calls.call_sessions(edges, line).select("call_id", "host_id", "start_ts", "end_ts")
    started = found.select("call_id", "host_id", F.lit("start").alias("edge"), "start_ts", F.lit(None).cast("timestamp_ntz").alias("end_ts"))
    ended = found.filter(F.col("end_ts").isNotNull()).withColumn("edge", F.lit("end"))
    both = started.unionByName(ended).withColumns({c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")}).unionByName(later)
    start, end = F.unix_micros("start_ts"), F.unix_micros("end_ts").cast("double")
    return both.select("call_id", "host_id", "edge", start.alias("start_us"), end.alias("end_us"))


QUERIES = {
    f.__name__: f
    for f in (
        voip_source_filter,
        voip_mic_pids,
        voip_two_method_union,
        mic_usage_tree,
        poll_status,
        mic_in_use_by_voip,
        hysteresis_latch,
        loose_latch,
        call_edges,
        call_sessions,
        frames_in_calls,
        first_caller_id,
        caller_hash,
        blocklist_lookup,
        blocklist_upsert,
        fixed_frames,
        silence_ratio,
        max_amplitude,
        drop_silent,
        fit_center,
        fit_head,
        rms_normalize,
        downmix,
        pcm16,
        wav_round_trip,
        audio_silence,
        pcm_silence,
        resample,
        mel_power,
        mel_decibels,
        cepstra,
        resample_tones,
        mel_frames,
        lfcc_frames,
        gmm_confidence,
        fit_gmm_pair,
        refit_gmm_pair,
        train_scorer,
        score_frames,
        batch_predict,
        latency_stats,
        latest_per_tick,
        latest_n,
        align_scores,
        align_per_frame,
        ensemble_score,
        decision_engine,
        buffer_scores,
        current_state,
        call_rollup,
        call_summary,
        alerts,
        caller_warnings,
        detail_text,
        call_report,
        live_decisions,
        live_calls,
        live_frames_in_calls,
        live_rollup,
        live_summary,
        live_align,
        live_alerts,
        live_caller_warnings,
        live_current_state,
        live_latest_n,
        live_decisions_resumed,
        live_calls_resumed,
    )
}
