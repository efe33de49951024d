"""A stateful step over a key's rows in event-time order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed, so that a checkpoint outlives a change of the Python version.
PICKLE = 5


def _plain(value):
    """A NumPy value as the Python one that state takes."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def plain_columns(batch: pd.DataFrame, count: int) -> list[list]:
    """The ``count`` columns of ``cells`` as Python values; pandas has NaN for NULL doubles, so NULLs come by their flags."""
    flags, out = batch["nulls"].tolist(), []
    some = any("1" in f for f in flags)
    for i in range(count):
        column = batch[f"v{i}"]
        values = column.tolist()
        if column.dtype.kind not in "ifb":
            values = [_plain(v) for v in values]
        out.append([None if f[i] == "1" else v for v, f in zip(values, flags, strict=True)] if some else values)
    return out


def cells(df: DataFrame, fields: tuple[str, ...]) -> list[Column]:
    """The columns that ``plain_columns`` reads: the fields by number, and one text with a flag for each.

    pandas would make doubles of whole numbers with a NULL among them, which state doesn't take back and which are not
    exact, so their NULLs travel as zeros. Every column costs a fixed time per key in Python, so there are few.
    """
    found = []
    for i, f in enumerate(fields):
        kind = df.schema[f].dataType
        value = F.coalesce(f"`{f}`", F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(f"`{f}`")
        found.append(value.alias(f"v{i}"))
    return [*found, F.concat(F.lit(""), *[F.when(F.isnull(f"`{f}`"), "1").otherwise("0") for f in fields]).alias("nulls")]


@F.arrow_udf(T.BinaryType())
def packed_row(row: pa.Array) -> pa.Array:
    """Each struct as a pickled tuple: a column costs a fixed time per key in Python, so a row travels to the state as one."""
    return pa.array([pickle.dumps(r, PICKLE) for r in zip(*[c.to_pylist() for c in row.flatten()], strict=True)], pa.binary())


class Packing:
    """Rows given out as pickles of many, for a frame costs Python a fixed time per key and column; Arrow batches unpack them.

    ``output`` is the DDL of the rows.
    """

    schema = "rows binary"
    size = 10_000  # rows of a pickle and of an unpacked batch

    def __init__(self, output: str):
        self.output = T.StructType.fromDDL(output)

    def frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if not rows:
            return iter(())
        made = [pickle.dumps(rows[i : i + self.size], PICKLE) for i in range(0, len(rows), self.size)]
        return iter([pd.DataFrame({"rows": made})])

    def unpacked(self, df: DataFrame, loads: Callable[[bytes], list[tuple]] = pickle.loads) -> DataFrame:
        size, shape = self.size, to_arrow_schema(self.output)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), shape, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for batch in batches:
                for data in batch.column(0):
                    rows += loads(data.as_py())
                    if len(rows) >= size:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

        return df.mapInArrow(run, self.output)


class OrderedProcessor(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then applies ``step`` in order.

    Rows of a micro-batch come in any order and may be late up to the
    watermark's delay. Subclasses say what a key remembers (``memory``) and
    what a run of ordered rows does with it (``step``). What is held per key is
    bounded by its rate times the delay. ``idle_s`` clears the memory of a key
    that has been quiet for so long between two runs of due rows. Without it, a
    key whose step returns no memory leaves no state.
    """

    fields: tuple[str, ...]  # columns the step reads, after the microsecond clock and the tie
    memory: T.StructType
    packing: Packing  # how rows are given out, set by ``run_ordered``

    def __init__(self, key: str, tie: str, idle_s: int | None = None):
        self.key, self.tie, self.idle_s = key, tie, idle_s

    def step(self, key, memory: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def follow_up(self, row: tuple) -> tuple | None:
        """A row that is to come by itself some time after this one, as a time limit; it doesn't move the watermark."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # One value per key: what waits, what is remembered, and the last time a row was due. Waiting rows are one pickle,
        # as only this class reads them and every nested value would be converted twice on its way to the store and back.
        self._state = handle.getValueState(
            "state",
            T.StructType(
                [
                    T.StructField("waiting", T.BinaryType()),
                    T.StructField("memory", self.memory),
                    T.StructField("seen", T.LongType()),
                ]
            ),
        )

    def _read(self) -> tuple[list[tuple], tuple | None, int | None]:
        held = self._state.get()
        if held is None:
            return [], None, None
        waiting, memory, seen = held
        return pickle.loads(waiting) if waiting else [], None if memory is None else tuple(memory), seen

    def _write(self, waiting: list[tuple], memory: tuple | None, seen: int | None) -> None:
        self._state.update((pickle.dumps(waiting, PICKLE) if waiting else None, memory, seen))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Begin with what a key remembers from its history (see ``run_ordered``)."""
        seen, *memory = pickle.loads(initialState["row"].iloc[0])
        memory = tuple(memory)
        self._write([], memory, seen)
        if self.idle_s is not None:
            self._handle.registerTimer(seen // 1000 + 1000 * self.idle_s + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        waiting, memory, seen = self._read()
        oldest = min((r[0] for r in waiting), default=None)
        for batch in rows:
            made = [pickle.loads(data) for data in batch["row"].tolist()]
            waiting += made
            waiting += [later for row in made if (later := self.follow_up(row)) is not None]
        first = min((r[0] for r in waiting), default=None)
        self._write(waiting, memory, seen)
        if first is not None and first != oldest:
            self._wake_after(first)
        return iter(())

    def _wake_after(self, us: int) -> None:
        """Call back as soon as the watermark has passed this time."""
        self._handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, memory, seen = self._read()
        due = sorted((r for r in waiting if r[0] < mark), key=lambda r: r[:2])
        idle = None if self.idle_s is None else self.idle_s * 1_000_000
        if not due:
            # Other timers fire as well, so only the last row's age tells whether the key is idle.
            if idle is not None and not waiting and seen is not None and mark >= seen + idle:
                self._state.clear()
            return iter(())
        rest = [r for r in waiting if r[0] >= mark]
        if idle is not None and seen is not None and due[0][0] >= seen + idle:
            memory = None
        memory, made = self.step(key[0], memory, due)
        if rest or memory is not None or idle is not None:
            self._write(rest, memory, due[-1][0])
        else:
            self._state.clear()
        if rest:
            self._wake_after(min(r[0] for r in rest))
        if idle is not None:
            self._handle.registerTimer((due[-1][0] + idle) // 1000 + 1)
        return self.packing.frame(made)


class Buckets(StatefulProcessor):
    """An ``OrderedProcessor`` for many keys at a time: what the state costs per key and micro-batch is paid per bucket.

    A bucket reads and writes the waiting rows of all its keys in every micro-batch that brings it a row, and their memories
    when rows get due, so both are bounded by the keys of a bucket. Meant for jobs with large micro-batches.
    """

    def __init__(self, inner: OrderedProcessor):
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # By key the rows that wait, and by key what is remembered and the last time a row was due.
        self._waiting = handle.getValueState("waiting", T.StructType([T.StructField("rows", T.BinaryType())]))
        self._memories = handle.getValueState("memories", T.StructType([T.StructField("by_key", T.BinaryType())]))

    @staticmethod
    def _read(state) -> dict:
        held = state.get()
        return pickle.loads(held[0]) if held else {}

    @staticmethod
    def _write(state, held: dict) -> None:
        if held:
            state.update((pickle.dumps(held, PICKLE),))
        else:
            state.clear()

    def _forget_later(self, memories: dict) -> None:
        if self.inner.idle_s is not None and memories:
            self._handle.registerTimer(min(seen for _, seen in memories.values()) // 1000 + 1000 * self.inner.idle_s + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        memories = self._read(self._memories)
        for name, seen, *memory in map(pickle.loads, initialState["row"].tolist()):
            memories[name] = tuple(memory), seen
        self._write(self._memories, memories)
        self._forget_later(memories)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        waiting = self._read(self._waiting)
        oldest = _first(waiting)
        for batch in rows:
            for name, *row in map(pickle.loads, batch["row"].tolist()):
                held = waiting.setdefault(name, [])
                held.append(row := tuple(row))
                if (later := self.inner.follow_up(row)) is not None:
                    held.append(later)
        self._write(self._waiting, waiting)
        if (first := _first(waiting)) != oldest:
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        idle = None if self.inner.idle_s is None else self.inner.idle_s * 1_000_000
        waiting, memories, made = self._read(self._waiting), self._read(self._memories), []
        before = len(memories)
        due = {name: found for name, rows in waiting.items() if (found := sorted((r for r in rows if r[0] < mark), key=lambda r: r[:2]))}
        for name, rows in due.items():
            memory, seen = memories.pop(name, (None, None))
            if idle is not None and seen is not None and rows[0][0] >= seen + idle:
                memory = None
            memory, out = self.inner.step(name, memory, rows)
            made += out
            if memory is not None:
                memories[name] = memory, rows[-1][0]
            waiting[name] = [r for r in waiting[name] if r[0] >= mark]
            if not waiting[name]:
                del waiting[name]
        if idle is not None:
            memories = {name: held for name, held in memories.items() if name in waiting or mark < held[1] + idle}
        if due or len(memories) != before:
            self._write(self._memories, memories)
            self._forget_later(memories)
        if due:
            self._write(self._waiting, waiting)
            if waiting:
                self._handle.registerTimer(_first(waiting) // 1000 + 1)
        return self.inner.packing.frame(made)


def _first(waiting: dict) -> int | None:
    return min((r[0] for rows in waiting.values() for r in rows), default=None)


def memories_of(spark: SparkSession, checkpoint: str, key: str, kind: str, processor: type[OrderedProcessor]) -> DataFrame:
    """What a job with ``buckets`` remembers, a row per key as of its last finished micro-batch; ``kind`` is the key's type."""
    names = processor.memory.names
    packing = Packing(f"`{key}` {kind}, memory {processor.memory.simpleString()}")
    held = spark.read.format("statestore").option("stateVarName", "memories").load(checkpoint).select("value.by_key")
    return packing.unpacked(held, lambda data: [(name, dict(zip(names, memory, strict=True))) for name, (memory, _) in pickle.loads(data).items()])


def merged(left: DataFrame, right: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Both streams as one, whose watermark is the slower one's; columns that only one has are NULL in the other."""
    sides = (left, right)
    if delay is not None:
        sides = [df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) for df in sides]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def _numbered(*columns: Column) -> Column:
    """The columns as a struct, whatever their names are."""
    return F.struct(*[c.alias(f"v{i}") for i, c in enumerate(columns)])


def run_ordered(
    stream: DataFrame,
    processor: OrderedProcessor,
    ts: str,
    delay: str | None,
    output: str,
    history: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Apply a processor to a stream, per key. ``delay`` sets the watermark; None keeps the stream's own.

    ``history`` has a row per key with the fields of the processor's memory and ``seen``, the time of its last row in
    microseconds. It is read by the first micro-batch of a new checkpoint only, shuffled like the stream and never collected.
    With ``buckets`` the state is kept in so many buckets of keys (see ``Buckets``); a checkpoint keeps their number.
    """
    timed = stream
    if delay is not None:
        timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    kind = timed.schema[processor.key].dataType

    def keyed(name: Column, *columns: Column) -> list[Column]:
        """The key of the state and the packed row; in a bucket the row begins with its own key."""
        if buckets is None:
            return [name.alias(processor.key), packed_row(_numbered(*columns)).alias("row")]
        return [F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket"), packed_row(_numbered(name, *columns)).alias("row")]

    # A row without time is never due.
    # Rows without a tie, like the closing one, come before others of their time.
    tie = F.coalesce(F.col(processor.tie).cast("bigint"), F.lit(-1))
    fields = [F.col(f"`{f}`") for f in processor.fields]
    held, row = keyed(F.col(processor.key), F.unix_micros(ts), tie, *fields)
    timed = timed.filter(F.col(ts).isNotNull()).select(held, ts, row)
    by, begun = timed.columns[0], None
    if history is not None:
        memory = [F.col(f.name).cast(f.dataType) for f in processor.memory]
        begun = history.select(*keyed(F.col(processor.key).cast(kind), F.col("seen").cast("bigint"), *memory)).groupBy(by)
    processor.packing = Packing(output)
    made = timed.groupBy(by).transformWithStateInPandas(
        processor if buckets is None else Buckets(processor),
        outputStructType=processor.packing.schema,
        outputMode="Append",
        timeMode="EventTime",
        initialState=begun,
    )
    return processor.packing.unpacked(made)
