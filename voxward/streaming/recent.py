"""The newest frames of each recorder, kept in the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxward.params import RECORDER_FRAMES
from voxward.streaming.ordered import Packing, cells, plain_columns

#: Frames without time or tie are older than all others.
_OLDEST = -(1 << 63)


class Ring(StatefulProcessor):
    """The newest ``n`` frames of a key, oldest first; what is pushed out is given out.

    However many frames a key has, its state holds ``n``. Frames may come in any order: the ring is by time and tie, not by
    arrival.
    """

    def __init__(self, carried: tuple[T.StructField, ...], n: int, packing: Packing):
        self.carried, self.n, self.packing = carried, n, packing

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = [T.StructField("frame_us", T.LongType()), T.StructField("frame_tie", T.LongType())]
        self._ring = handle.getListState("ring", T.StructType([*place, *self.carried]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = [tuple(r) for r in self._ring.get()] if self._ring.exists() else []
        dropped: list[tuple] = []
        for batch in rows:
            columns = plain_columns(batch, len(self.carried))
            held += zip(batch["frame_us"].tolist(), batch["frame_tie"].tolist(), *columns, strict=True)
            held.sort(key=lambda r: r[:2])
            dropped += held[: -self.n]
            held = held[-self.n :]
        self._ring.put(held)
        made = [(key[0], *r) for r in dropped]
        return self.packing.frame(made)


def latest_n_stream(
    frames: DataFrame, n: int = RECORDER_FRAMES, key: str = "host_id", ts: str = "captured_at", tie: str = "frame_seq"
) -> DataFrame:
    """``latest_n`` on a stream: rows are the frames that newer ones have pushed out, the newest ``n`` are in the state.

    ``newest_frames`` reads them from there. Give frames with the place of their audio rather than with samples. Frames
    without a key are left out.
    """
    kinds = frames.schema
    carried = tuple(f for f in kinds if f.name not in (key, ts, tie))
    names = [f.name for f in carried]
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(_OLDEST)).alias("frame_us")
    place = F.coalesce(F.col(tie).cast("bigint"), F.lit(_OLDEST)).alias("frame_tie")
    rows = frames.filter(F.col(key).isNotNull()).select(F.col(key).alias("ring_key"), us, place, *cells(frames, names))
    output = [f"ring_key {kinds[key].dataType.simpleString()}", "frame_us bigint", "frame_tie bigint"]
    output += [f"`{f.name}` {f.dataType.simpleString()}" for f in carried]
    packing = Packing(", ".join(output))
    dropped = rows.groupBy("ring_key").transformWithStateInPandas(
        Ring(carried, n, packing), outputStructType=packing.schema, outputMode="Append", timeMode="None"
    )
    return _frames(packing.unpacked(dropped), [F.col(c) for c in ("ring_key", "frame_us", "frame_tie", *names)], key, ts, tie, names)


def newest_frames(
    spark: SparkSession, checkpoint: str, key: str = "host_id", ts: str = "captured_at", tie: str = "frame_seq"
) -> DataFrame:
    """The newest frames per recorder, read from the state of a ``latest_n_stream`` job; the job may go on running."""
    held = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    names = [f for f in held.schema["list_element"].dataType.names if f not in ("frame_us", "frame_tie")]
    columns = [F.col("key.ring_key"), *[F.col(f"list_element.`{c}`") for c in ("frame_us", "frame_tie", *names)]]
    return _frames(held, columns, key, ts, tie, names)


def _frames(rows: DataFrame, columns: list, key: str, ts: str, tie: str, names: list[str]) -> DataFrame:
    ring_key, us, place, *rest = columns

    def known(c):
        return F.when(c != _OLDEST, c)

    return rows.select(
        ring_key.alias(key), F.timestamp_micros(known(us)).alias(ts), known(place).alias(tie),
        *[c.alias(n) for c, n in zip(rest, names, strict=True)],
    )
