"""Cutting audio into fixed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxward.operators.timeline import Timeline
from voxward.params import FRAME_SECONDS, RECORDER_FRAMES


def with_positions(chunks: DataFrame, key: str, seq: str, line: Timeline | None = None) -> DataFrame:
    """Add ``first_sample``, the place of a chunk's first sample in its recording.

    Works on sizes alone; the readers here already deliver the column, so audio
    need not be shuffled for it.
    """
    line = line or Timeline((key,), (seq,))
    sizes = chunks.select(key, seq, _count(_is_pcm(chunks)).cast("bigint").alias("_size"))
    sizes = line.cut(sizes)
    before = line.rows.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("first_sample", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if line.width:
        heads = line.summarize(sizes, _n=F.sum("_size"))
        fold = {"_b": lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))}
        out = line.carry(out, heads, fold, {})
        out = out.withColumn("first_sample", F.col("first_sample") + F.coalesce("_b", F.lit(0)))
    return chunks.join(out.select(key, seq, "first_sample"), [key, seq])


def _is_pcm(df: DataFrame) -> bool:
    return isinstance(df.schema["samples"].dataType, T.BinaryType)


def _count(pcm: bool) -> Column:
    """Number of samples, of an array or of 16-bit PCM bytes."""
    return (F.octet_length("samples") / 2).cast("int") if pcm else F.size("samples")


def _part(pcm: bool, first: Column, length: Column) -> Column:
    """``length`` samples from place ``first``, counted from 0."""
    if pcm:
        return F.substring("samples", (first * 2 + 1).cast("int"), (length * 2).cast("int"))
    return F.slice("samples", (first + 1).cast("int"), length.cast("int"))


def _recording(chunks: DataFrame, key: str | None) -> tuple[str, list[str]]:
    """The column that tells recordings apart, and those to carry along with it."""
    key = key or ("recording" if "recording" in chunks.columns else "host_id")
    return key, [c for c in ("host_id",) if c in chunks.columns and c != key]


def _frame_size(frame_s: float, n: int | None) -> Column:
    """Samples of a frame: ``n``, else by the row's own rate."""
    return F.lit(n) if n else F.floor(F.col("sample_rate") * F.lit(frame_s)).cast("int")


def _pieces(chunks: DataFrame, columns: list[str], n: Column) -> DataFrame:
    """Each chunk cut where frames begin."""
    pcm = _is_pcm(chunks)
    start = F.col("first_sample")
    end = start + _count(pcm)
    first, last = F.floor(start / n), F.floor((end - 1) / n)

    def piece(f: Column) -> Column:
        begin = F.greatest(f * n, start)
        length = F.least((f + 1) * n, end) - begin
        cut = _part(pcm, begin - start, length)
        return F.struct(f.cast("int").alias("frame_seq"), begin.alias("_at"), cut.alias("samples"))

    has = _count(pcm) > 0
    pieces = chunks.filter(has).select(
        *columns,
        F.col("captured_at"),
        F.inline(F.transform(F.sequence(first, last), piece)),
        F.col("sample_rate"),
        start.alias("_start"),
    )
    # A frame is stamped when its first sample was taken.
    stamp = F.timestamp_micros(
        F.unix_micros("captured_at")
        + F.floor((F.col("_at") - F.col("_start")) * 1_000_000 / F.col("sample_rate"))
    )
    return pieces.withColumn("captured_at", stamp).drop("_start")


def whole_frames(
    chunks: DataFrame,
    key: str | None = None,
    frame_s: float = FRAME_SECONDS,
    n: int | None = None,
) -> DataFrame:
    """The frames that lie inside one chunk: all of them, where chunks end at frame borders.

    Needs no state, so it works on streams as it is.
    """
    key, carried = _recording(chunks, key)
    size = _frame_size(frame_s, n)
    pieces = _pieces(chunks, [key, *carried], size)
    columns = [key, *carried, "frame_seq", "captured_at", "sample_rate", "samples"]
    return pieces.filter(_count(_is_pcm(pieces)) == size).select(*columns)


def to_frames(
    chunks: DataFrame,
    key: str | None = None,
    frame_s: float = FRAME_SECONDS,
    n: int | None = None,
) -> DataFrame:
    """Frames of ``frame_s`` seconds at each row's own rate, or of ``n`` samples, without overlap.

    For chunks that end anywhere; ``read_frames`` reads files in a single pass.
    Expects mono chunks with ``first_sample``; samples are arrays or PCM bytes.
    Frames never mix recordings: ``key`` tells them apart, by default
    ``recording``, or ``host_id`` where there is no such column. An incomplete
    tail is left out. Whole frames leave at once; only the pieces of frames
    that span chunks are brought together, one frame's samples per group.
    """
    key, carried = _recording(chunks, key)
    size = _frame_size(frame_s, n)
    whole, pieces = whole_frames(chunks, key, frame_s, n), _pieces(chunks, [key, *carried], size)
    pcm = _is_pcm(chunks)
    joined = F.flatten(F.col("_parts.samples"))
    if pcm:
        empty = F.lit(b"")
        joined = F.aggregate(F.col("_parts.samples"), empty, lambda a, b: F.concat(a, b))
    parts = (
        pieces.filter(_count(pcm) < size)
        .groupBy(key, *carried, "frame_seq", "sample_rate")
        .agg(
            F.min("captured_at").alias("captured_at"),
            F.array_sort(F.collect_list(F.struct("_at", "samples"))).alias("_parts"),
        )
        .withColumn("samples", joined)
        .filter(_count(pcm) == size)
    )
    return whole.unionByName(parts.select(*whole.columns))


def frames_from_samples(
    samples: DataFrame,
    n: int,
    key: str,
    order: tuple[str, ...],
    value: str,
    line: Timeline | None = None,
) -> DataFrame:
    """Frames from a table that holds one sample per row."""
    line = line or Timeline((key,), order)
    rows = line.number(samples.select(key, *order, value), "_pos")
    rows = rows.withColumn("frame_seq", F.floor((F.col("_pos") - 1) / n).cast("int"))
    frames = rows.groupBy(key, "frame_seq").agg(
        F.array_sort(F.collect_list(F.struct("_pos", value))).alias("_rows")
    )
    frames = frames.filter(F.size("_rows") == n)
    return frames.select(key, "frame_seq", F.col(f"_rows.{value}").alias("samples"))


def latest_n(
    frames: DataFrame, n: int = RECORDER_FRAMES, key: str = "host_id", order: tuple[str, ...] = ("frame_seq",)
) -> DataFrame:
    """The newest ``n`` frames per recorder.

    A ranked filter, which Spark applies per task before the shuffle, so a hot
    recorder sends at most ``n`` rows per task.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = frames.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
