"""The whole chain over stored telemetry and audio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.operators import caller, calls, decision, detection, rollup, scoring
from voxward.operators.timeline import Timeline
from voxward.params import APP_PROFILE, MIC_CONSENT_ROOT, TICK_MS, DecisionParams, SilenceParams
from voxward.sources.alerts import write_alerts
from voxward.sources.blocklist import Blocklist

FRAME = ("host_id", "frame_seq", "captured_at")


@dataclass(frozen=True)
class BatchInputs:
    """Tables to run over; ``frames`` has audio, ``ui_text`` the texts of call windows."""

    sessions: DataFrame
    processes: DataFrame
    mic: DataFrame
    frames: DataFrame
    ui_text: DataFrame
    blocklist: Blocklist
    scorer: scoring.Scorer | None = None
    mixtures: dict[str, scoring.Mixture] | None = None


def batch_predict(
    frames: DataFrame,
    scorer: scoring.Scorer | None,
    mixtures: dict[str, scoring.Mixture] | None,
    keys: tuple[str, ...] = FRAME,
    silence: SilenceParams = SilenceParams(),
) -> DataFrame:
    """Results of both models for stored frames; silent ones are passed over before scoring."""
    return scoring.score_frames(frames, scorer, mixtures, keys, silence=silence)


def measure(
    frames: DataFrame, scorer: scoring.Scorer, keys: tuple[str, ...] = FRAME, silence: SilenceParams = SilenceParams()
) -> DataFrame:
    """First half of ``batch_predict`` where the mixtures are still to be fitted on these frames; ``score_measured`` is the other."""
    return scoring.measure_frames(frames, scorer, None, keys, silence, cepstra=True)


def run_batch(
    inputs: BatchInputs,
    out: str,
    run: int,
    job: str = "batch",
    params: DecisionParams = APP_PROFILE,
    silence: SilenceParams = SilenceParams(),
    mode: str = "per_result",
    mic_root: str | None = MIC_CONSENT_ROOT,
) -> dict[str, DataFrame]:
    """Telemetry and audio to calls, decisions, alerts and strikes, as tables below ``out``.

    Each stage writes its table and the next reads it, so lost executors cost
    no more than the stage at hand. Audio is read once, by the measuring stage,
    and is in no shuffle; frames are given to calls by what was measured. A
    ``job`` numbers its runs: the same ``run`` again gives the same tables and no
    second strike, the next data needs the next number. Frames may come from
    several recordings in a call; ``per_frame`` takes them by their times.
    """
    spark = inputs.sessions.sparkSession

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    status = detection.poll_status(inputs.sessions, inputs.processes, inputs.mic, root=mic_root)
    status = store(status, "poll_status")
    polls = Timeline.chunked(status, ("host_id",), ("poll_ts",))
    latched = calls.latch(status, require_mic=True, line=polls)
    sessions = store(calls.call_sessions(calls.call_edges(latched), polls), "call_session")

    measured = scoring.measure_frames(inputs.frames, inputs.scorer, inputs.mixtures, FRAME, silence)
    measured = store(measured, "frame_measure")
    models = scoring.models_of(inputs.scorer, inputs.mixtures)
    results = scoring.model_results(measured, FRAME, models)
    results = results.withColumn("result_ts", F.col("captured_at"))

    frame_keys = measured.select(*FRAME)
    width = Timeline.chunked(frame_keys, ("host_id",), ("captured_at",)).width
    in_calls = calls.assign_calls(frame_keys, sessions, width=width)
    scored = calls.assign_calls(results, sessions, tie=("model",), width=width)
    slot = "tick" if mode == "per_result" else "captured_at"
    scored = scored.withColumn("tick", decision.tick_of(F.col("result_ts"), TICK_MS))
    scored = store(scored, "model_result")
    line = Timeline.chunked(scored, ("call_id",), (slot,))
    updates = decision.align_scores(scored, mode, slot=slot, line=line)
    updates = line.number(updates, "update_seq").withColumnRenamed("result_ts", "update_ts")
    decided = store(decision.decision_engine(updates, params, line=line), "decision")

    rolled = rollup.call_rollup(decided, in_calls)
    full = rollup.complete_calls(sessions, rolled)
    texts = inputs.ui_text
    if "call_id" not in texts.columns:
        texts = calls.assign_calls(texts, sessions, tie=("walk_ordinal",), width=width)
    known = caller.caller_hashes(caller.first_caller_id(texts))
    # The lookup reads the calls twice, once to find frequent callers.
    full = store(full.join(known, "call_id", "left"), "call_rollup")
    listed = inputs.blocklist.read(spark, job, run)
    full = store(caller.lookup_blocklist(full, listed), "call")

    write_alerts(rollup.alerts(full, decided), f"{out}/alert", run)
    inputs.blocklist.add(caller.calls_to_flag(full), job, run)
    return {
        "poll_status": status,
        "model_result": scored,
        "decision": decided,
        "call": full,
        "alert": spark.read.parquet(f"{out}/alert").where(F.col("epoch") == run).drop("epoch"),
    }
