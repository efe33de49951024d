"""Joins whose left side may have many rows without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join to a table with one row per ``key``.

    Rows with a NULL key match nothing and are spread by ``row_id``, so they
    never share a task. Very frequent keys are left to the adaptive skew join,
    which splits the left side of this join by itself.
    """
    spread = F.when(F.col(key).isNull(), F.xxhash64(row_id)).otherwise(F.lit(0))
    salted = left.withColumn("_salt", spread)
    return salted.join(right.withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left").drop("_salt")
