"""Caller identity and the blocklist of hashed numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxward.functions.identity import hash_number, validate_number
from voxward.operators.skew import lookup
from voxward.params import CALL_WINDOWS, MAX_UI_DEPTH


def first_caller_id(
    ui_text: DataFrame, max_depth: int = MAX_UI_DEPTH, windows: tuple[str, ...] = CALL_WINDOWS
) -> DataFrame:
    """The caller's number per call, NULL where none is shown.

    The first of ``windows`` that exists is searched and no other; in it the
    first valid number in walk order wins. One grouped aggregate does both.
    """
    shown = (F.col("depth") <= max_depth) & (F.coalesce("text", F.lit("")) != "")
    texts = ui_text.filter(F.col("window_name").isin(*windows)).select(
        "call_id",
        "window_name",
        "walk_ordinal",
        F.when(shown, validate_number(F.col("text"))).alias("number"),
    )
    aggs = []
    for i, window in enumerate(windows):
        here = F.col("window_name") == window
        valid = F.when(here & F.col("number").isNotNull(), F.col("walk_ordinal"))
        aggs += [F.bool_or(here).alias(f"_has{i}"), F.min_by("number", valid).alias(f"_num{i}")]
    found = texts.groupBy("call_id").agg(*aggs)
    number = F.lit(None).cast("string")
    for i in reversed(range(len(windows))):
        number = F.when(F.col(f"_has{i}"), F.col(f"_num{i}")).otherwise(number)
    return found.select("call_id", number.alias("caller_number"))


def caller_hashes(numbers: DataFrame) -> DataFrame:
    """Hash the numbers and drop them; calls without a number have no identity."""
    known = numbers.filter(F.col("caller_number").isNotNull())
    return known.withColumn("caller_hash", hash_number(F.col("caller_number"))).drop("caller_number")


def lookup_blocklist(calls: DataFrame, flagged: DataFrame, row_id: str = "call_id") -> DataFrame:
    """Add ``is_caller_flagged``: the hash is listed with at least one strike.

    The list is filtered and pruned in its scan and is never broadcast as a
    whole, as it grows without bound.
    """
    listed = flagged.filter(F.col("strike_count") > 0).select(
        F.col("phone_hash").alias("caller_hash"), F.lit(True).alias("_listed")
    )
    out = lookup(calls, listed, "caller_hash", row_id)
    return out.withColumn("is_caller_flagged", F.coalesce("_listed", F.lit(False))).drop("_listed")


def calls_to_flag(calls: DataFrame) -> DataFrame:
    """Closed calls that were AI and whose caller is known."""
    closed = calls.filter(
        F.col("end_ts").isNotNull() & F.col("call_was_ai") & F.col("caller_hash").isNotNull()
    )
    return closed.select(F.col("caller_hash").alias("phone_hash"), "end_ts")


def strikes(flags: DataFrame) -> DataFrame:
    """Flags as additive increments per hash."""
    return flags.groupBy("phone_hash").agg(
        F.count(F.lit(1)).alias("strikes"), F.max("end_ts").alias("flagged_at")
    )


def add_strikes(flagged: DataFrame, added: DataFrame) -> DataFrame:
    """The blocklist with increments (``phone_hash``, ``strikes``, ``flagged_at``) applied.

    Listed and new hashes meet in a grouped aggregate, which combines before
    the shuffle: a hash with very many strikes costs no more than any other. A
    listed NULL count becomes a number only when its hash gets a strike.
    """
    old = flagged.select(
        "phone_hash",
        F.col("strike_count").cast("bigint").alias("old"),
        F.col("last_flagged_at").alias("old_at"),
        F.lit(0).cast("bigint").alias("added"),
        F.lit(None).cast(added.schema["flagged_at"].dataType).alias("added_at"),
    )
    new = added.select(
        "phone_hash",
        F.lit(None).cast("bigint").alias("old"),
        F.lit(None).cast(flagged.schema["last_flagged_at"].dataType).alias("old_at"),
        F.col("strikes").cast("bigint").alias("added"),
        F.col("flagged_at").alias("added_at"),
    )
    merged = old.unionByName(new).groupBy("phone_hash").agg(
        F.max("old").alias("old"),
        F.max("old_at").alias("old_at"),
        F.sum("added").alias("added"),
        F.max("added_at").alias("added_at"),
    )
    hit = F.col("added") > 0
    return merged.select(
        "phone_hash",
        F.when(hit, F.coalesce("old", F.lit(0)) + F.col("added"))
        .otherwise(F.col("old"))
        .cast("int")
        .alias("strike_count"),
        F.when(hit, F.col("added_at")).otherwise(F.col("old_at")).alias("last_flagged_at"),
    )


def upsert_flags(flagged: DataFrame, flags: DataFrame) -> DataFrame:
    """The blocklist after one more strike per flagged call."""
    each = flags.select("phone_hash", F.lit(1).alias("strikes"), F.col("end_ts").alias("flagged_at"))
    return add_strikes(flagged, each)
