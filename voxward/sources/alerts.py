"""Writing alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes two alerts the same; ``update_seq`` is 0 for kinds that a call has once.
ALERT_KEY = ("call_id", "kind", "update_seq")
#: Files that a micro-batch writes for a day at most.
DAY_FILES = 8


def write_alerts(alerts: DataFrame, path: str, epoch: int) -> None:
    """Store the alerts of one run; repeating it replaces, never doubles. Jobs that share a folder use ``AlertSink``."""
    alerts.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


@dataclass(frozen=True)
class AlertSink:
    """Delivered alerts below ``path``, each once, whichever job, run or restart delivers it.

    A micro-batch writes below its own job, run and epoch, by the day of its alerts, so repeating it replaces its rows and
    no job touches another's. Alerts that are there already, from other batches, are left out; only the days of
    the batch are looked through. Two jobs that deliver one alert in the same moment may both store it: ``read`` gives it once.
    """

    path: str

    def deliver(self, alerts: DataFrame, job: str, epoch: int, run: str = "0") -> None:
        """Store the alerts (``call_id``, ``kind``, ``ts``, and ``update_seq`` for kinds that come more than once) of one micro-batch.

        ``run`` tells apart checkpoints of one job, whose epochs start over.
        """
        spark = alerts.sparkSession
        seq = F.coalesce("update_seq", F.lit(0)) if "update_seq" in alerts.columns else F.lit(0)
        new = alerts.withColumns({"update_seq": seq.cast("bigint"), "day": F.to_date("ts")}).dropDuplicates(ALERT_KEY)
        own = (F.col("job") == job) & (F.col("run") == run) & (F.col("epoch") == epoch)
        known = self._stored(spark)
        if known is not None:
            # The set of days also prunes the folders that are read.
            known = known.where(~own).select("day", *[F.col(c).alias(f"_{c}") for c in ALERT_KEY])
            days = [r.day for r in new.select("day").distinct().collect()]
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ALERT_KEY]
            new = new.join(known.where(F.col("day").isin(days)).drop("day"), same, "left_anti")
        folder = f"{self.path}/job={job}/run={run}/epoch={epoch}"
        # Else every task writes a file for each day, and readers list and open them all.
        dealt = new.repartition("day", F.pmod(F.xxhash64(*ALERT_KEY), F.lit(DAY_FILES)))
        dealt.write.mode("overwrite").partitionBy("day").parquet(folder)

    def read(self, spark: SparkSession) -> DataFrame:
        """All delivered alerts, each once."""
        stored = self._stored(spark)
        if stored is None:
            raise ValueError(f"{self.path}: no alerts were ever delivered here")
        return stored.drop("day", "job", "run", "epoch").dropDuplicates(ALERT_KEY)

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        try:
            found = spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException as missing:  # nothing written yet, or only empty batches
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return found.withColumns({"job": F.col("job").cast("string"), "run": F.col("run").cast("string"), "day": F.col("day").cast("date")})
