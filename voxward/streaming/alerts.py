"""Alerts about voices, from a stream of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from voxward.operators.rollup import voice_alerts
from voxward.sources.alerts import AlertSink


def voice_alert_stream(
    decisions: DataFrame, sink: AlertSink, checkpoint: str, job: str, ts: str = "update_ts", **trigger
) -> StreamingQuery:
    """Start the job that delivers an alert whenever a call turns to AI; ``decisions`` come from ``decision_stream``.

    An alert is known by its call and number of update, so a job that starts over with a new checkpoint, or a second job
    over the same calls, delivers nothing twice.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        run = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        # Kept, as the sink reads the alerts more than once and the stateful step behind them must run once.
        alerts = voice_alerts(rows, ts, seq="update_seq").persist()
        try:
            if not alerts.isEmpty():
                sink.deliver(alerts, job, epoch, run)
        finally:
            alerts.unpersist()

    writer = decisions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
