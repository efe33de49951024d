"""Score updates from a stream of model results."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxward.operators.decision import tick_of
from voxward.params import TICK_MS
from voxward.streaming.ordered import PICKLE, Packing

_MODELS = ("cnn", "gmm")


class TickSlots(StatefulProcessor):
    """The newest result of each model in every tick that is still open, and the values carried from the ticks before.

    A tick is given out once the watermark has reached its end, ticks in order. The open ticks of a key are one value in
    the store, read and written once per micro-batch however many results or ticks it brings; their number is bounded by
    the delay. One timer per key waits for the first of them.
    """

    def __init__(self, key: str, tick_ms: int, carry: bool, idle_s: int | None, packing: Packing):
        self.key, self.tick_ms, self.carry, self.idle_s, self.packing = key, tick_ms, carry, idle_s, packing

    def init(self, handle: StatefulProcessorHandle) -> None:
        carried = [T.StructField("seen", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in _MODELS]]
        # By tick: the last time, and time, tie and value of each model. One pickle, as only this class reads it.
        places = [T.StructField("first", T.LongType()), T.StructField("places", T.BinaryType())]
        self._handle = handle
        self._slots = handle.getValueState("slots", T.StructType(places))
        self._held = handle.getValueState("carried", T.StructType(carried))

    def _open(self) -> tuple[int | None, dict[int, list]]:
        held = self._slots.get()
        return (None, {}) if held is None else (held[0], pickle.loads(held[1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        wake, places = self._open()
        for batch in rows:
            for slot, us, tie, (at, value) in zip(*[batch[c].tolist() for c in ("slot", "event_us", "tie")], _shown(batch), strict=True):
                place = places.get(slot)
                if place is None:
                    place = places[slot] = [us, *[None] * 6]
                elif us > place[0]:
                    place[0] = us
                # Of equal times and ties the one that was there first stays.
                if at and (place[at] is None or (us, tie) > (place[at], place[at + 1])):
                    place[at : at + 3] = us, tie, value
        if places:
            first = min(places)
            self._slots.update((first, pickle.dumps(places, PICKLE)))
            if wake is None or first < wake:
                self._handle.registerTimer((first + 1) * self.tick_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        wake, places = self._open()
        due = [] if wake is None else sorted(s for s in places if (s + 1) * self.tick_ms <= mark)
        if not due:
            # A timer of ticks that have gone by: only an idle key is left to forget.
            if wake is None and self.idle_s is not None:
                held = self._held.get()
                if held is not None and held[0] is not None and mark >= held[0] + 1000 * self.idle_s:
                    self._held.clear()
            return iter(())
        seen, *values = self._held.get() or (None, None, None)
        made = []
        for slot in due:
            place = places.pop(slot)
            news = [place[3], place[6]]
            if self.idle_s is not None and seen is not None and place[0] // 1000 >= seen + 1000 * self.idle_s:
                values = [None, None]
            values = [old if new is None else new for old, new in zip(values, news, strict=True)]
            seen = place[0] // 1000
            shown = [None if v is None else v / 100.0 for v in (values if self.carry else news)]
            made.append((key[0], slot, place[0], *shown))
        if places:
            first = min(places)
            self._slots.update((first, pickle.dumps(places, PICKLE)))
            self._handle.registerTimer((first + 1) * self.tick_ms)
        else:
            self._slots.clear()
        if self.carry or places:
            self._held.update((seen, *values))
            if self.idle_s is not None:
                self._handle.registerTimer(seen + 1000 * self.idle_s)
        else:
            self._held.clear()
        return self.packing.frame(made)


def _shown(batch: pd.DataFrame) -> Iterator[tuple[int, float | None]]:
    """Of each result the place of its model in a slot, 0 for other models, and its value."""
    for place, value in zip(batch["place"].tolist(), batch["value"].tolist(), strict=True):
        # Negative places stand for results without a value, as pandas has NaN for NULL.
        yield (place, value) if place >= 0 else (-place, None)


def align_stream(
    results: DataFrame,
    tick_ms: int = TICK_MS,
    mode: str = "per_result",
    ts: str = "result_ts",
    tie: str | None = None,
    delay: str | None = "1 minute",
    idle_s: int | None = 86_400,
) -> DataFrame:
    """``align_scores`` on a stream of raw results (``call_id``, ``model``, ``confidence_pct``): an update per tick with news.

    In a tick the newest result of a model wins, of equal times the one with the larger ``tie``. ``per_result`` carries each
    model's latest value forward, ``per_frame`` shows what the tick brought. An update comes out once the watermark
    has reached the end of its tick, so no result that is in time is lost. ``idle_s`` forgets what a call carries after so long
    without results, None never does. Results without time or call go nowhere.
    """
    if mode not in ("per_result", "per_frame"):
        raise ValueError("mode is per_result or per_frame")
    kind = results.schema["call_id"].dataType.simpleString()
    timed = results.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark(ts, delay)
    place = F.lit(0)
    for i, model in enumerate(_MODELS):
        place = F.when(F.col("model") == model, 1 + 3 * i).otherwise(place)
    rows = timed.where(F.col(ts).isNotNull() & F.col("call_id").isNotNull()).select(
        "call_id",
        ts,
        tick_of(F.col(ts), tick_ms).alias("slot"),
        F.unix_micros(ts).alias("event_us"),
        (F.lit(0) if tie is None else F.coalesce(F.col(tie), F.lit(-1))).cast("bigint").alias("tie"),
        F.when(F.col("confidence_pct").isNull(), -place).otherwise(place).cast("int").alias("place"),
        F.col("confidence_pct").cast("double").alias("value"),
    )
    packing = Packing(f"call_id {kind}, tick bigint, last_us bigint, cnn double, gmm double")
    made = packing.unpacked(
        rows.groupBy("call_id").transformWithStateInPandas(
            TickSlots("call_id", tick_ms, mode == "per_result", idle_s, packing),
            outputStructType=packing.schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return made.select("call_id", "tick", F.timestamp_micros("last_us").alias(ts), "cnn", "gmm")
