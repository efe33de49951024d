"""Reading the synthetic tables, and small joins whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.session import materialize, ship_package

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A side of narrow rows is broadcast up to this many rows (a few dozen MB), else both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, so that lost executors cost no repeated work.

    Its shuffle files go as soon as it is written.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return materialize(df, f"llm-{name}")
    finally:
        conf.set(_CLEAN, before)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, with a broadcast hint only if it is proven small."""
    return F.broadcast(df) if df.count() <= limit else df


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name from ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name
