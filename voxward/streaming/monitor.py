"""Calls from a stream of poll status rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.operators.detection import poll_status
from voxward.operators.timeline import Timeline
from voxward.params import MIC_CONSENT_ROOT, VOIP_KEYWORDS
from voxward.streaming.ordered import OrderedProcessor, run_ordered


class CallMonitor(OrderedProcessor):
    """Latch, edges and call numbers of one host."""

    fields = ("has_voip_audio", "mic_active")
    memory = T.StructType(
        [
            T.StructField("active", T.BooleanType()),
            T.StructField("ordinal", T.LongType()),
            T.StructField("start_us", T.LongType()),
        ]
    )

    def __init__(self, key: str, tie: str, require_mic: bool = True):
        super().__init__(key, tie)
        self.require_mic = require_mic

    def step(self, key, memory, rows):
        active, ordinal, start = memory or (False, 0, None)
        made = []
        for us, _, audio, mic in rows:
            # Audio alone keeps the state, unless the mic does not matter; unknown audio keeps it too.
            now = active if audio is None else bool(audio and (active or mic or not self.require_mic))
            if now and not active:
                ordinal, start = ordinal + 1, us
                made.append((key, ordinal, us, None))
            elif active and not now:
                made.append((key, ordinal, start, us))
            active = now
        return (active, ordinal, start), made


def poll_status_stream(
    sessions: DataFrame,
    processes: DataFrame,
    mic: DataFrame,
    delay: str = "1 minute",
    keywords: Iterable[str] = VOIP_KEYWORDS,
    root: str | None = MIC_CONSENT_ROOT,
) -> DataFrame:
    """Poll status from the three telemetry streams; a poll comes out once the watermark has passed it.

    The watermark is the slowest table's, so each has to get rows from time to
    time. Give the result to ``call_monitor_stream`` with ``delay=None``.
    """
    timed = [df.withWatermark("poll_ts", delay) for df in (sessions, processes, mic)]
    return poll_status(*timed, keywords, root)


def call_monitor_stream(
    status: DataFrame,
    require_mic: bool = True,
    delay: str | None = "1 minute",
    tie: str | None = None,
    history: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Start and end events of calls; an end carries both times.

    ``tie`` orders polls with equal time; polls of one host normally have none. ``history`` (see ``monitor_history``)
    lets a new job go on where a batch run over the polls before it has ended: calls that were on stay on and numbers go on.
    ``buckets`` keeps the state of many hosts together (see ``run_ordered``).
    """
    if tie is None:
        status, tie = status.withColumn("poll_tie", F.lit(0).cast("bigint")), "poll_tie"
    kind = status.schema["host_id"].dataType.simpleString()
    events = run_ordered(
        status,
        CallMonitor("host_id", tie, require_mic),
        "poll_ts",
        delay,
        f"host_id {kind}, call_ordinal bigint, start_us bigint, end_us bigint",
        history,
        buckets,
    )
    return events.select(
        F.concat_ws("#", F.col("host_id").cast("string"), F.col("call_ordinal").cast("string")).alias("call_id"),
        "host_id",
        F.when(F.col("end_us").isNull(), "start").otherwise("end").alias("edge"),
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
    )


def monitor_history(edges: DataFrame, order: tuple[str, ...] = ("poll_ts",)) -> DataFrame:
    """What a monitor job has to remember of each host, from the output of ``call_edges`` over all its polls so far."""
    us = F.unix_micros(F.col(order[0]).cast("timestamp"))
    start = F.when(F.col("edge") == "start", us)
    return edges.filter(F.col("host_id").isNotNull()).groupBy("host_id").agg(
        F.max_by("active", Timeline(("host_id",), order).at).alias("active"),
        F.count(start).alias("ordinal"),
        F.max(start).alias("start_us"),
        F.max(us).alias("seen"),
    )
