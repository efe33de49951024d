"""Blocklist checks and strikes on a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxward.operators.caller import calls_to_flag, lookup_blocklist
from voxward.operators.rollup import ended_alerts, flagged_alerts
from voxward.sources.alerts import AlertSink
from voxward.sources.blocklist import Blocklist


def apply_calls(
    calls: DataFrame, blocklist: Blocklist, alerts_path: str, job: str, epoch: int
) -> None:
    """One micro-batch: warn about flagged callers, then add strikes for AI calls that ended.

    Rows with their roll-up also give the summaries of ended calls. Both writes go under the epoch, so a batch that runs again changes nothing.
    """
    started = calls.filter(F.col("end_ts").isNull())
    flagged = lookup_blocklist(started, blocklist.read(calls.sparkSession, job, epoch))
    alerts = flagged_alerts(flagged)
    if "frames_processed" in calls.columns:
        alerts = alerts.unionByName(ended_alerts(calls))
    AlertSink(alerts_path).deliver(alerts, job, epoch)
    blocklist.add(calls_to_flag(calls), job, epoch)


def blocklist_stream(
    calls: DataFrame, blocklist: Blocklist, alerts_path: str, checkpoint: str, job: str, **trigger
) -> StreamingQuery:
    """Start the job; a new checkpoint needs a new ``job`` name. Rows are calls at their start (no ``end_ts``) and at their end."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.persist()
        try:
            apply_calls(rows, blocklist, alerts_path, job, epoch)
        finally:
            rows.unpersist()

    writer = calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
