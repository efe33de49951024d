"""Who is calling, from texts of call windows as a stream, and the warning while a listed caller is on."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxward.functions.identity import hash_number, validate_number
from voxward.operators.caller import lookup_blocklist
from voxward.params import CALL_WINDOWS, MAX_UI_DEPTH
from voxward.sources.blocklist import Blocklist
from voxward.sources.warnings import WarningLog
from voxward.streaming.ordered import OrderedProcessor, merged, run_ordered

#: A start comes before the texts of its time; the time limit and the end come after them.
_START_TIE, _LIMIT_TIE, _END_TIE = -(1 << 62), (1 << 62) - 1, 1 << 62


class CallerAtStart(OrderedProcessor):
    """The first valid number shown after the start of a call, until the time limit; the end clears it."""

    fields = ("edge", "window_rank", "shown_hash")
    memory = T.StructType(
        [
            T.StructField("start_us", T.LongType()),
            T.StructField("caller_hash", T.StringType()),
            T.StructField("told", T.BooleanType()),
        ]
    )

    def __init__(self, key: str, tie: str, wait_s: float):
        super().__init__(key, tie)
        self.wait_us = round(wait_s * 1_000_000)

    def follow_up(self, row):
        return (row[0] + self.wait_us, _LIMIT_TIE, "limit", None, None) if row[2] == "start" else None

    def step(self, key, memory, rows):
        start, found, told = memory or (None, None, False)
        made = []
        # Texts of one time are one walk over the windows.
        for us, now in groupby(rows, key=lambda r: r[0]):
            now = list(now)
            edges = {r[2] for r in now}
            if "start" in edges and start is None:
                start, found, told = us, None, False
            if start is None:
                continue
            if not told:
                texts = [(rank, tie, number) for _, tie, _, rank, number in now if rank is not None]
                first = min((t[0] for t in texts), default=None)
                valid = [(tie, number) for rank, tie, number in texts if rank == first and number is not None]
                found = min(valid)[1] if valid else None
                if found is not None or edges & {"limit", "end"}:
                    made.append((key, start, None, found))
                    told = True
            if "end" in edges:
                made.append((key, start, us, found))
                start, found, told = None, None, False
        return None if start is None else (start, found, told), made


def caller_id_stream(
    ui_text: DataFrame,
    edges: DataFrame,
    wait_s: float = 30.0,
    max_depth: int = MAX_UI_DEPTH,
    windows: tuple[str, ...] = CALL_WINDOWS,
    ts: str = "seen_ts",
    delay: str | None = "1 minute",
) -> DataFrame:
    """Calls at their start and at their end with the hash of the caller's number, as ``blocklist_stream`` takes them.

    ``ui_text`` has the texts of call windows (``call_id``, ``window_name``, ``walk_ordinal``, ``depth``, ``text``) with the
    time of their walk, ``edges`` the events of ``call_monitor_stream``. Each walk is searched as ``first_caller_id`` does;
    the first one from the start of the call on that shows a valid number tells the caller. A call whose number has not
    been seen ``wait_s`` after its start, or at its end, has no identity, and its row comes out all the same. Numbers are
    hashed before they reach state or checkpoint. Texts before the start, after the end or without call or time don't count;
    an end without its start gives nothing. A call on leaves one row of state, an ended one none.
    """
    kind = edges.schema["call_id"].dataType.simpleString()
    rank = F.array_position(F.array(*map(F.lit, windows)), F.col("window_name"))
    shown = (F.col("depth") <= max_depth) & (F.coalesce("text", F.lit("")) != "")
    # Texts without a window go along, as the closing row of a finite stream is one.
    texts = ui_text.filter(F.col("window_name").isNull() | (rank > 0)).select(
        F.col("call_id").cast(kind).alias("call_id"),
        ts,
        F.col("walk_ordinal").cast("bigint").alias("walk_tie"),
        F.when(F.col("window_name").isNotNull(), rank).alias("window_rank"),
        F.when(shown, hash_number(validate_number(F.col("text")))).alias("shown_hash"),
    )
    ended = F.col("edge") == "end"
    events = edges.select(
        "call_id",
        F.when(ended, F.col("end_ts")).otherwise(F.col("start_ts")).alias(ts),
        F.when(ended, F.lit(_END_TIE)).otherwise(F.lit(_START_TIE)).alias("walk_tie"),
        "edge",
    )
    made = run_ordered(
        merged(texts, events, ts, delay),
        CallerAtStart("call_id", "walk_tie", wait_s),
        ts,
        None,
        f"call_id {kind}, start_us bigint, end_us bigint, caller_hash string",
    )
    return made.select(
        "call_id",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("end_us").alias("end_ts"),
        "caller_hash",
    )


def caller_warning_stream(
    calls: DataFrame, blocklist: Blocklist, log: WarningLog, checkpoint: str, job: str, **trigger
) -> StreamingQuery:
    """Start the job that shows the warning about a listed caller at call start and takes it away at call end.

    ``calls`` come from ``caller_id_stream``. Each micro-batch looks its callers up in the blocklist as it is then; a batch
    that runs again replaces what it wrote.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        # Kept, as the stateful step behind the rows must run once.
        rows.persist()
        try:
            started = rows.filter(F.col("end_ts").isNull() & F.col("caller_hash").isNotNull())
            checked = lookup_blocklist(started, blocklist.read(rows.sparkSession))
            log.record(checked, rows.filter(F.col("end_ts").isNotNull()), job, epoch)
        finally:
            rows.unpersist()

    writer = calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
