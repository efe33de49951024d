"""Frames and the calls they belong to, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.streaming.ordered import OrderedProcessor, merged, run_ordered

#: Edges come before frames of their time, so their ties are far below those of frames.
_EDGES_FROM = -(1 << 62)


class OpenCall(OrderedProcessor):
    """The call that is on at one host; a host without one has no state."""

    memory = T.StructType([T.StructField("call_id", T.StringType())])

    def __init__(self, key: str, tie: str, carried: tuple[T.StructField, ...]):
        super().__init__(key, tie)
        self.fields = ("edge", "edge_call", *[c.name for c in carried])

    def step(self, key, memory, rows):
        call, made = (memory or (None,))[0], []
        for us, tie, edge, edge_call, *carried in rows:
            if edge == "start":
                call = edge_call
            elif edge == "end":
                call = None if call == edge_call else call
            elif call is not None:
                made.append((call, key, us, tie, *carried))
        return None if call is None else (call,), made


def frames_in_calls_stream(
    frames: DataFrame,
    edges: DataFrame,
    ts: str = "captured_at",
    tie: str | None = None,
    delay: str | None = "1 minute",
    buckets: int | None = None,
) -> DataFrame:
    """``assign_calls`` on streams: the frames captured while a call was on at their host, with its ``call_id``.

    ``edges`` are the events of ``call_monitor_stream``. Frames and edges meet in event-time order once the
    watermarks of both have passed them; of equal times an edge comes first, so a frame at the start is in the call and
    one at the end is not. What waits per host is bounded by its frame rate times the delay: give frames with the place
    of their audio rather than with samples. ``tie`` orders frames of equal time; ``delay=None`` keeps the
    streams' own watermarks. Frames without host or time belong to no call. ``buckets`` keeps the state of many hosts together.
    """
    if tie is None:
        frames, tie = frames.withColumn("frame_seq_tie", F.lit(0).cast("bigint")), "frame_seq_tie"
    # The closing row of a finite stream has no ordinal; it is no edge.
    ordinal = F.substring_index("call_id", "#", -1).cast("bigint")
    events = edges.select(
        "host_id",
        F.when(F.col("edge") == "end", F.col("end_ts")).otherwise(F.col("start_ts")).alias(ts),
        (F.lit(_EDGES_FROM) + 2 * ordinal + (F.col("edge") == "end").cast("bigint")).alias(tie),
        "edge",
        F.col("call_id").alias("edge_call"),
    )
    carried = tuple(f for f in frames.schema if f.name not in ("host_id", "call_id", ts, tie))
    rows = frames.drop("call_id").withColumn(tie, F.col(tie).cast("bigint"))
    both = merged(rows, events, ts, delay)
    host = frames.schema["host_id"].dataType.simpleString()
    output = ["call_id string", f"host_id {host}", "event_us bigint", "frame_tie bigint"]
    output += [f"`{f.name}` {f.dataType.simpleString()}" for f in carried]
    found = run_ordered(both, OpenCall("host_id", tie, carried), ts, None, ", ".join(output), buckets=buckets)
    at = F.timestamp_micros("event_us").alias(ts)
    names = [F.col("frame_tie").alias(tie)] if tie in frames.columns and tie != "frame_seq_tie" else []
    return found.select("call_id", "host_id", at, *names, *[f"`{f.name}`" for f in carried])
