"""From polls to calls: latch, edges, sessions, and the frames inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxward.operators.timeline import Timeline
from voxward.session import materialize

HOST_POLLS = Timeline(("host_id",), ("poll_ts",))


def latch(
    polls: DataFrame,
    require_mic: bool = True,
    line: Timeline = HOST_POLLS,
    audio: str = "has_voip_audio",
    mic: str = "mic_active",
) -> DataFrame:
    """Add ``active`` and ``was_active``, the call state after and before each poll.

    Audio with mic sets the state, no audio releases it, audio alone keeps it.
    Without ``require_mic`` audio alone is the state.
    """
    told = F.col(audio)
    if require_mic:
        told = F.when(F.col(audio) & F.col(mic), True).when(~F.col(audio), False)
    df = line.cut(polls).withColumn("_told", told)
    upto = line.rows.rowsBetween(Window.unboundedPreceding, 0)
    earlier = line.rows.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "active": F.last("_told", ignorenulls=True).over(upto),
            "was_active": F.last("_told", ignorenulls=True).over(earlier),
        }
    )
    told_at = F.when(F.col("_told").isNotNull(), line.at)
    before = F.lit(False)
    if line.width:
        cut = line.cut(polls).withColumn("_told", told)
        heads = line.summarize(cut, _end=F.max_by("_told", told_at))
        fold = {
            "_carried": lambda w: F.last("_end", ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1)
            )
        }
        df = line.carry(df, heads, fold, {})
        before = F.coalesce("_carried", F.lit(False))
    df = df.withColumns(
        {"active": F.coalesce("active", before), "was_active": F.coalesce("was_active", before)}
    )
    return df.drop("_told", "_carried")


def call_edges(latched: DataFrame) -> DataFrame:
    """Add ``edge``: ``start`` or ``end`` where the state changes, else NULL."""
    started = F.col("active") & ~F.col("was_active")
    ended = ~F.col("active") & F.col("was_active")
    return latched.withColumn("edge", F.when(started, "start").when(ended, "end"))


def call_sessions(edges: DataFrame, line: Timeline = HOST_POLLS) -> DataFrame:
    """One row per call; a call still open has a NULL end.

    Only edge rows go on from here. Start and end of a call share the number
    of starts so far, so the last shuffle is spread over calls, not hosts.
    """
    host, ts = line.keys[0], line.order[0]
    rows = edges.filter(F.col("edge").isNotNull()).select(*line.group, *line.order, "edge")
    if line.width:
        # Numbering chunks reads the edges twice; the latch before them runs once.
        rows = materialize(rows, "call-edges")
    rows = line.running_count(rows, "call_ordinal", F.col("edge") == "start")
    calls = rows.groupBy(host, "call_ordinal").agg(
        F.min(F.when(F.col("edge") == "start", F.col(ts))).alias("start_ts"),
        F.max(F.when(F.col("edge") == "end", F.col(ts))).alias("end_ts"),
    )
    length = F.col("end_ts").cast("timestamp").cast("double") - F.col("start_ts").cast(
        "timestamp"
    ).cast("double")
    return calls.select(
        F.concat_ws("#", F.col(host).cast("string"), F.col("call_ordinal").cast("string")).alias("call_id"),
        host,
        "call_ordinal",
        "start_ts",
        "end_ts",
        length.alias("duration_s"),
    )


def assign_calls(
    frames: DataFrame,
    calls: DataFrame,
    host: str = "host_id",
    ts: str = "captured_at",
    tie: tuple[str, ...] = (),
    width: int | None = None,
) -> DataFrame:
    """Add ``call_id`` to the frames captured while a call was on; other frames drop out.

    A host has one call at a time, so the call of a frame is the last one that
    started by then, if it is still on. Calls and frames are merged on one
    timeline and the last start is carried forward: linear work, no pairs, and
    a hot host is spread over chunks.
    """
    line = Timeline((host,), (ts, "_kind", *tie), width)
    columns = [c for c in frames.columns if c != "call_id"]
    call = F.struct("call_id", "end_ts")
    kinds = dict(frames.select(*columns).dtypes)
    starts = calls.select(
        F.lit(0).alias("_kind"),
        call.alias("_call"),
        *[
            F.col(host) if c == host
            else F.col("start_ts").alias(ts) if c == ts
            else F.lit(None).cast(kinds[c]).alias(c)
            for c in columns
        ],
    )
    merged = frames.select(
        F.lit(1).alias("_kind"),
        F.lit(None).cast(starts.schema["_call"].dataType).alias("_call"),
        *columns,
    ).unionByName(starts)
    known = line.last_known(merged, _now="_call").filter("_kind = 1")
    on = F.col("_now").isNotNull() & (
        F.col("_now.end_ts").isNull() | (F.col(ts) < F.col("_now.end_ts"))
    )
    return known.filter(on).select(F.col("_now.call_id").alias("call_id"), *columns)
