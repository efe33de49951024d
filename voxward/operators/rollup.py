"""Per-call roll-up, summaries, alerts and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.functions.labels import (
    ai_text,
    detail_text,
    display_label,
    ended_text,
    frames_text,
    from_code,
    label_code,
    severity,
)
from voxward.operators.timeline import Timeline
from voxward.params import AI, AI_TITLE, ENDED_TITLE, FLAGGED_MESSAGE, FLAGGED_TITLE

ALERT_COLUMNS = ("call_id", "ts", "kind", "title", "message")


def call_rollup(
    decisions: DataFrame,
    frames: DataFrame | None = None,
    key: str = "call_id",
    order: tuple[str, ...] = ("update_seq",),
    require_full: bool = False,
) -> DataFrame:
    """Per call: was it ever AI, frames seen, last label and confidence.

    Frames (silent ones too) and decisions meet in one grouped aggregate.
    ``require_full`` counts an AI label only once the buffer has filled.
    """
    ai = F.col("label") == AI
    if require_full:
        ai = ai & F.col("buffer_full")
    updates = decisions.select(
        key,
        ai.alias("_ai"),
        Timeline((key,), order).at.alias("_at"),
        label_code(F.col("label")).alias("_label"),
        (F.col("average_score") * 100).alias("_pct"),
        F.lit(0).cast("bigint").alias("_frame"),
    )
    if frames is not None:
        kinds = updates.schema
        updates = updates.unionByName(
            frames.select(
                key,
                F.lit(False).alias("_ai"),
                F.lit(None).cast(kinds["_at"].dataType).alias("_at"),
                F.lit(None).cast("int").alias("_label"),
                F.lit(None).cast("double").alias("_pct"),
                F.lit(1).cast("bigint").alias("_frame"),
            )
        )
    # Without a frame table every update stands for a frame.
    counted = F.sum("_frame") if frames is not None else F.count(F.lit(1))
    out = updates.groupBy(key).agg(
        F.bool_or("_ai").alias("call_was_ai"),
        counted.alias("frames_processed"),
        F.max_by("_label", "_at").alias("_label"),
        F.max_by("_pct", "_at").alias("last_confidence"),
    )
    return out.select(
        key,
        "call_was_ai",
        "frames_processed",
        display_label(from_code(F.col("_label"))).alias("last_label"),
        "last_confidence",
    )


def complete_calls(calls: DataFrame, rollup: DataFrame, key: str = "call_id") -> DataFrame:
    """Calls with their roll-up; a call without frames counts 0. Both sides have one row per call."""
    out = calls.join(rollup, key, "left")
    return out.withColumns(
        {
            "call_was_ai": F.coalesce("call_was_ai", F.lit(False)),
            "frames_processed": F.coalesce("frames_processed", F.lit(0).cast("bigint")),
        }
    )


def call_summary(calls: DataFrame) -> DataFrame:
    """Add the text shown when a call has ended and the frame counter."""
    frames = F.col("frames_processed")
    return calls.withColumns(
        {
            "summary": ended_text(frames, F.col("last_label"), F.col("last_confidence")),
            "frames_text": frames_text(frames),
        }
    )


def display_columns(decisions: DataFrame) -> DataFrame:
    """Add the display label, its severity and the text with both models' confidences."""
    return decisions.withColumns(
        {
            "display_label": display_label(F.col("label")),
            "severity": severity(F.col("label")),
            "detail_text": detail_text(F.col("cnn") * 100, F.col("gmm") * 100),
        }
    )


def caller_warnings(calls: DataFrame) -> DataFrame:
    """When the warning about a flagged caller shows: from call start to its end."""
    return calls.filter("is_caller_flagged").select(
        "call_id", F.col("start_ts").alias("shown_from"), F.col("end_ts").alias("shown_to")
    )


def flagged_alerts(calls: DataFrame) -> DataFrame:
    """A warning at the start of each call whose caller is listed."""
    return calls.filter("is_caller_flagged").select(
        "call_id",
        F.col("start_ts").alias("ts"),
        F.lit("flagged_caller").alias("kind"),
        F.lit(FLAGGED_TITLE).alias("title"),
        F.lit(FLAGGED_MESSAGE).alias("message"),
    )


def voice_alerts(decisions: DataFrame, ts: str = "update_ts", seq: str | None = None) -> DataFrame:
    """An alert for each update that notifies; works on decision streams too. ``seq`` adds the number of the update."""
    detail = detail_text(F.col("cnn") * 100, F.col("gmm") * 100)
    return decisions.filter("should_notify").select(
        "call_id",
        F.col(ts).alias("ts"),
        F.lit("ai_voice").alias("kind"),
        F.lit(AI_TITLE).alias("title"),
        ai_text(F.col("average_score"), detail).alias("message"),
        *([] if seq is None else [F.col(seq).alias("update_seq")]),
    )


def ended_alerts(calls: DataFrame) -> DataFrame:
    """A summary at the end of each closed call."""
    text = ended_text(F.col("frames_processed"), F.col("last_label"), F.col("last_confidence"))
    return calls.filter(F.col("end_ts").isNotNull()).select(
        "call_id",
        F.col("end_ts").alias("ts"),
        F.lit("call_ended").alias("kind"),
        F.lit(ENDED_TITLE).alias("title"),
        text.alias("message"),
    )


def alerts(calls: DataFrame, decisions: DataFrame, ts: str = "update_ts") -> DataFrame:
    """All three kinds of notification."""
    started = flagged_alerts(calls).unionByName(voice_alerts(decisions, ts))
    return started.unionByName(ended_alerts(calls))
