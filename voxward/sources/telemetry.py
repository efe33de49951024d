"""Reading polled telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxward.schemas import TELEMETRY


def read_telemetry(
    spark: SparkSession,
    table: str,
    path: str,
    fmt: str = "parquet",
    streaming: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One of the telemetry tables, in batch or as a stream, with its declared schema."""
    if table not in TELEMETRY:
        raise ValueError(f"unknown table {table}; known: {', '.join(TELEMETRY)}")
    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(TELEMETRY[table])
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
