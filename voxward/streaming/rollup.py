"""Roll-ups of calls on streams, given out when a call ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.functions.labels import display_label
from voxward.params import AI, DecisionParams
from voxward.streaming.decisions import DecisionState
from voxward.streaming.ordered import merged, run_ordered

#: An end comes after the frames of its time.
_END_TIE = 1 << 62


class CallRollup(DecisionState):
    """Frames, decisions so far and the last label of one call; its end gives them out and clears them."""

    fields = ("cnn", "gmm", "is_silent", "ended")
    memory = T.StructType(
        [
            T.StructField("frames", T.LongType()),
            T.StructField("was_ai", T.BooleanType()),
            T.StructField("label", T.StringType()),
            T.StructField("average", T.DoubleType()),
            T.StructField("decided", DecisionState.memory),
        ]
    )

    def __init__(self, key: str, tie: str, params: DecisionParams, fill: bool, require_full: bool, idle_s: int | None):
        super().__init__(key, tie, params, fill, idle_s)
        self.require_full = require_full

    def _heard(self, key, memory, rows):
        """What is remembered after a run of rows of one call."""
        frames, was_ai, label, average, decided = memory or (0, False, None, None, None)
        spoken = [(us, tie, cnn, gmm) for us, tie, cnn, gmm, silent, _ in rows if silent is False]
        if spoken:
            decided, updates = super().step(key, decided, spoken)
            average, label = updates[-1][7:9]
            was_ai = was_ai or any(u[8] == AI and (u[10] or not self.require_full) for u in updates)
        return frames + len(rows), was_ai, label, average, decided

    def step(self, key, memory, rows):
        made, first = [], 0
        for i, row in enumerate(rows):
            if row[5]:
                frames, was_ai, label, average, _ = self._heard(key, memory, rows[first:i])
                made.append((key, row[0], was_ai, frames, label, average))
                memory, first = None, i + 1
        if first < len(rows):
            memory = self._heard(key, memory, rows[first:])
        return memory, made


def rollup_stream(
    frames: DataFrame,
    ends: DataFrame,
    params: DecisionParams = DecisionParams(),
    ts: str = "ts",
    tie: str = "frame_seq",
    fill: bool = False,
    require_full: bool = False,
    delay: str | None = "1 minute",
    idle_s: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``call_rollup`` on streams: one row per call, when the watermarks of both streams have passed its end.

    ``frames`` has a row per frame (``call_id``, ``cnn``, ``gmm``, ``is_silent``), silent ones too, which count but are not
    scored; ``ends`` has ``call_id`` and ``end_ts``, as the end events of ``call_monitor_stream`` do. Rolling scores, labels
    and counts of a call live in its state from its first frame to its end and go with the end; the end of a call
    without frames gives a count of 0. ``idle_s`` forgets calls that never end. Frames of the end's time belong to the call,
    later ones would begin it anew. ``buckets`` keeps the state of many calls together.
    """
    kind = frames.schema["call_id"].dataType.simpleString()
    rows = frames.select("call_id", ts, F.col(tie).cast("bigint").alias("frame_tie"), "cnn", "gmm", "is_silent")
    last = ends.select("call_id", F.col("end_ts").alias(ts), F.lit(_END_TIE).alias("frame_tie"), F.lit(True).alias("ended"))
    made = run_ordered(
        merged(rows, last, ts, delay),
        CallRollup("call_id", "frame_tie", params, fill, require_full, idle_s),
        ts,
        None,
        f"call_id {kind}, end_us bigint, call_was_ai boolean, frames_processed bigint, label string, average double",
        buckets=buckets,
    )
    return made.select(
        "call_id",
        F.timestamp_micros("end_us").alias("end_ts"),
        "call_was_ai",
        "frames_processed",
        display_label(F.col("label")).alias("last_label"),
        (F.col("average") * 100).alias("last_confidence"),
    )
