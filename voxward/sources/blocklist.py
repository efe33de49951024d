"""The stored blocklist: a base table, strikes added since, and a log of base versions."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.operators.caller import add_strikes, strikes
from voxward.schemas import FLAGGED_NUMBERS
from voxward.sources.commits import CommitLog

_STRIKES = "phone_hash string, strikes bigint, flagged_at timestamp, job string, epoch bigint"
#: Compactions that may be overtaken by others before one gives up.
_TRIES = 50


@dataclass(frozen=True)
class Blocklist:
    """A blocklist below ``path``.

    Every micro-batch or run writes only its own strikes, under its job and
    epoch. One that runs again replaces its folder, so each call counts exactly
    once; a stream that starts from a new checkpoint needs a new job name, as
    its epochs start over. ``compact`` folds strikes into a new base version,
    in a folder of its own, and logs it under the next number, which only one
    compactor gets; one that was overtaken starts again from the version that
    won. Readers take the newest logged version and the strikes after it.
    Nothing that is being read is ever overwritten, and what a compactor left
    that was lost or overtaken is in no log entry, until ``clean`` removes it.

    A list may begin with its first strikes or with ``create``. A folder with
    neither is no blocklist, and reading it fails, as it does where a logged
    base version is gone: a lost or mistyped list does not pass for an empty one.
    """

    path: str

    def create(self, flagged: DataFrame) -> None:
        """Store a first base version; fails where there is one."""
        if not self._commit(flagged, 1, {}):
            raise ValueError(f"{self.path}: there is a blocklist already")

    def read(self, spark: SparkSession, job: str | None = None, before: int | None = None) -> DataFrame:
        """The list as of now, or as ``job`` saw it before one of its epochs."""
        base, done = self._newest(spark)[1:]
        added = self._after(self._strikes(spark), done)
        if job is not None and before is not None:
            added = added.filter((F.col("job") != job) | (F.col("epoch") < before))
        return add_strikes(self._base(spark, base), added)

    def add(self, flags: DataFrame, job: str, epoch: int) -> None:
        """Store the strikes of one epoch; ``flags`` has ``phone_hash`` and ``end_ts``."""
        rows = strikes(flags).withColumn("flagged_at", F.col("flagged_at").cast("timestamp"))
        rows.write.mode("overwrite").parquet(f"{self.path}/strikes/job={job}/epoch={epoch}")

    def compact(self, spark: SparkSession, job: str, through: int) -> None:
        """Fold the strikes of a job's epochs up to ``through`` into a new base version.

        Only epochs that have ended for good may be folded. Any number of
        compactors may run at once.
        """
        for _ in range(_TRIES):
            version, base, done = self._newest(spark)
            if done.get(job, -1) >= through:
                return
            new = self._after(self._strikes(spark), done)
            new = new.filter((F.col("job") == job) & (F.col("epoch") <= through))
            if self._commit(add_strikes(self._base(spark, base), new), version + 1, {**done, job: through}):
                return
        raise RuntimeError(f"{self.path}: overtaken {_TRIES} times")

    def clean(self, spark: SparkSession, older_s: float = 86_400) -> int:
        """Remove base folders of that age which no log entry names; gives their number."""
        kept = {entry["base"] for entry in self._log.entries(spark).values()}
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/base")
        files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(folder):
            return 0
        before = (time.time() - older_s) * 1000
        lost = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in kept and s.getModificationTime() <= before]
        for path in lost:
            files.delete(path, True)
        return len(lost)

    @staticmethod
    def _after(rows: DataFrame, done: dict[str, int]) -> DataFrame:
        """Strikes that no base version holds yet; prunes the folders of the others."""
        for job, epoch in done.items():
            rows = rows.filter((F.col("job") != job) | (F.col("epoch") > epoch))
        return rows

    @property
    def _log(self) -> CommitLog:
        return CommitLog(f"{self.path}/commits")

    def _commit(self, flagged: DataFrame, version: int, done: dict[str, int]) -> bool:
        """Write a base version and log it; False where another has its number."""
        base = f"{version:08d}-{uuid.uuid4().hex}"
        # Sorted files let a lookup skip what lies outside their range of hashes.
        rows = flagged.repartitionByRange("phone_hash").sortWithinPartitions("phone_hash")
        rows.write.parquet(f"{self.path}/base/{base}")
        return self._log.put(flagged.sparkSession, version, {"base": base, "done": done})

    def _newest(self, spark: SparkSession) -> tuple[int, str | None, dict[str, int]]:
        """Number and folder of the newest base version and, per job, the last epoch in it."""
        version, entry = self._log.newest(spark)
        if entry is None:
            if self._written(spark, "strikes", _STRIKES).isEmpty():
                raise ValueError(f"{self.path}: no blocklist here")
            return 0, None, {}
        return version, entry["base"], entry["done"]

    def _base(self, spark: SparkSession, base: str | None) -> DataFrame:
        if base is None:
            return spark.createDataFrame([], FLAGGED_NUMBERS)
        return spark.read.schema(FLAGGED_NUMBERS).parquet(f"{self.path}/base/{base}")

    def _strikes(self, spark: SparkSession) -> DataFrame:
        return self._written(spark, "strikes", _STRIKES)

    def _written(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as missing:  # not written yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
