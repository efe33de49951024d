"""Stored warnings about listed callers: when each was shown and taken away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WarningLog:
    """Warnings below ``path``, by job and epoch; an epoch that runs again replaces its folders.

    Starts and ends of calls come in different epochs and meet when the log is
    read. Ends of calls whose caller is unknown can't have a warning and are not kept.
    """

    path: str

    def record(self, checked: DataFrame, ended: DataFrame, job: str, epoch: int) -> None:
        """Store one epoch: calls that began, with ``is_caller_flagged``, and calls that ended, with ``caller_hash``."""
        shown = checked.filter("is_caller_flagged").select("call_id", F.col("start_ts").alias("shown_from"))
        hidden = ended.filter(F.col("caller_hash").isNotNull()).select("call_id", F.col("end_ts").alias("shown_to"))
        for name, rows in (("shown", shown), ("hidden", hidden)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/job={job}/epoch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """A row per warning; one that is still up has no ``shown_to``. Two jobs that saw one call give it once."""
        shown = spark.read.parquet(f"{self.path}/shown").groupBy("call_id").agg(F.min("shown_from").alias("shown_from"))
        hidden = spark.read.parquet(f"{self.path}/hidden").groupBy("call_id").agg(F.max("shown_to").alias("shown_to"))
        return shown.join(hidden, "call_id", "left")
