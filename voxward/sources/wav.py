"""Reading and writing PCM16 WAV files."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxward.functions.dsp import to_mono
from voxward.operators.framing import whole_frames
from voxward.params import CAPTURE_RATE, FRAME_SECONDS, PCM16_SCALE

SPLIT_BYTES = 64 * 1024 * 1024
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_HEADERS = (
    "path string, modificationTime timestamp, length bigint, sample_rate int, channels int, data_at bigint, n_samples bigint, reason string"
)
_CHUNKS = (
    "path string, recording string, host_id string, chunk_seq bigint, captured_at timestamp, sample_rate int,"
    " channels int, first_sample bigint, samples array<float>"
)
_ROWS_OUT = 32
# File names that ``write_wav_frames`` gives: number from 1, time of day.
_FRAME_FILE = r"frame_(\d+)_(\d{2})(\d{2})(\d{2})_(\d{3})\.wav$"


def _header(path: str, length: int) -> tuple:
    """``sample_rate, channels, data_at, n_samples, reason`` of a file; a reason tells why it can't be read."""
    try:
        fs, name = FileSystem.from_uri(path)
        with fs.open_input_file(name) as file:
            riff, _, kind = struct.unpack("<4sI4s", file.read(12).ljust(12, b"\0"))
            if (riff, kind) != (b"RIFF", b"WAVE"):
                return None, None, None, None, "no WAVE header"
            rate = channels = width = None
            while len(head := file.read(8)) == 8:
                chunk, size = struct.unpack("<4sI", head)
                if chunk == b"fmt ":
                    _, channels, rate, _, _, width = struct.unpack("<HHIIHH", file.read(16).ljust(16, b"\0"))
                    file.seek(file.tell() + size + size % 2 - 16)
                elif chunk == b"data":
                    if width != 16 or not channels or not rate:
                        return None, None, None, None, f"{width}-bit samples, expected 16-bit"
                    there = length - file.tell()
                    # A recorder that was cut off leaves no size, or one too large.
                    size = min(size, there) if size else there
                    return rate, channels, file.tell(), size // (2 * channels), None
                else:
                    file.seek(file.tell() + size + size % 2)
    except (OSError, struct.error) as error:
        return None, None, None, None, f"unreadable: {error}"[:200]
    return None, None, None, None, "no samples"


def wav_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The files with what their headers say; ``reason`` is NULL for those that can be read.

    Files that can't stay as rows with a reason, so that they can be counted and
    kept: ``wav_files(...).where("reason IS NOT NULL")``. Files without a single
    byte are not listed by Spark's file source.
    """
    reader = spark.readStream if streaming else spark.read
    listed = reader.format("binaryFile").schema(_FILES).load(path).select("path", "modificationTime", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [_header(p, n) for p, n in zip(batch["path"], batch["length"], strict=True)]
            columns = ["sample_rate", "channels", "data_at", "n_samples", "reason"]
            found = pd.DataFrame(heads, columns=columns, index=batch.index)
            found = found.astype({c: "Int64" for c in columns[:-1]})
            yield pd.concat([batch, found], axis=1)

    return listed.mapInPandas(run, _HEADERS)


def _started() -> Column:
    """When a file's first sample was taken: by its name, else its last change less its length."""
    hour, minute, second, milli = (F.regexp_extract("path", _FRAME_FILE, i).cast("bigint") for i in (2, 3, 4, 5))
    midnight = F.unix_micros(F.date_trunc("day", "modificationTime"))
    named = midnight + (((hour * 60 + minute) * 60 + second) * 1000 + milli) * 1000
    # A frame is older than its file: one stamped later in the day is yesterday's.
    named = F.when(named > F.unix_micros("modificationTime") + 1_000_000, named - 86_400_000_000).otherwise(named)
    length = F.floor(F.col("n_samples") * 1_000_000 / F.col("sample_rate"))
    plain = F.unix_micros("modificationTime") - length
    return F.timestamp_micros(F.when(F.col("path").rlike(_FRAME_FILE), named).otherwise(plain))


def _chunks_of(row, split_bytes: int, seconds: float, as_bytes: bool) -> Iterator[tuple]:
    """Mono chunks of one file whose first byte lies in the given split."""
    fs, name = FileSystem.from_uri(row.path)
    n, size = int(row.sample_rate * seconds), 2 * row.channels
    first, stop = (-(-s * split_bytes // (n * size)) for s in (row.split, row.split + 1))
    with fs.open_input_file(name) as file:
        for seq in range(first, min(stop, -(-row.n_samples // n))):
            data = file.read_at(min(n, row.n_samples - seq * n) * size, row.data_at + seq * n * size)
            if row.channels > 1 or not as_bytes:
                mono = to_mono(np.frombuffer(data, "<i2").astype(np.float32), row.channels)
                data = np.rint(mono).astype("<i2").tobytes() if as_bytes else mono / 32768
            yield seq, seq * n, data


def read_wav(
    spark: SparkSession,
    path: str,
    host: Column | None = None,
    started: Column | None = None,
    chunk_s: float = FRAME_SECONDS,
    split_bytes: int = SPLIT_BYTES,
    streaming: bool = False,
    pcm: bool = False,
) -> DataFrame:
    """WAV files as mono ``audio_chunk`` rows with their place in the recording.

    Spark lists the files and spreads byte ranges of them over one task per
    ``split_bytes``; each opens its ranges itself, so no file is held as a whole. Chunks are as long as a frame. Files that ``wav_files`` gives a
    reason for are passed over; look there for them.

    A recording is a file, or the folder of files ``frame_NNNN_HHMMSS_mmm.wav``,
    whose numbers and times are read back. With ``pcm`` samples stay 16-bit
    bytes (the mean of channels is rounded), the compact form for large
    volumes. ``host`` and ``started`` are expressions over ``path`` and
    ``modificationTime``; by default the folder's name, and the time in the
    file's name or that of its last change less its length.
    """
    files = wav_files(spark, path, streaming).where("reason IS NULL AND n_samples > 0")
    numbered = F.regexp_extract("path", _FRAME_FILE, 1)
    frame = F.col("path").rlike(_FRAME_FILE)
    data = F.col("n_samples") * F.col("channels") * 2
    ranges = files.select(
        "path",
        F.when(frame, F.regexp_extract("path", "^(.*)/[^/]+$", 1)).otherwise(F.col("path")).alias("recording"),
        (host if host is not None else F.regexp_extract("path", "([^/]+)/[^/]+$", 1)).alias("host_id"),
        (started if started is not None else _started()).alias("started"),
        "sample_rate", "channels", "data_at", "n_samples",
        # The place of a numbered frame in its recording.
        F.when(frame, (numbered.cast("bigint") - 1) * F.floor(F.col("sample_rate") * FRAME_SECONDS)).otherwise(0).alias("base"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((data - 1) / split_bytes))).alias("split"),
    )
    if streaming:
        ranges = ranges.repartition("path", "split")
    else:
        # By bytes: what the adaptive planner sees here are short rows, not the audio behind them.
        sizes = spark.read.format("binaryFile").schema(_FILES).load(path).select("length")
        total, count = sizes.agg(F.sum("length"), F.count("length")).first()
        tasks = max(-(-(total or 0) // split_bytes), min(count, spark.sparkContext.defaultParallelism), 1)
        ranges = ranges.repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = []
                for seq, at, samples in _chunks_of(row, split_bytes, chunk_s, pcm):
                    taken = row.started + pd.Timedelta(microseconds=at * 1_000_000 // row.sample_rate)
                    rows.append((row.path, row.recording, row.host_id, seq, taken, row.sample_rate, 1, row.base + at, samples))
                    if len(rows) == _ROWS_OUT:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in _CHUNKS.split(", ")]
    return ranges.mapInPandas(run, _CHUNKS.replace("array<float>", "binary") if pcm else _CHUNKS)


def read_frames(spark: SparkSession, path: str, frame_s: float = FRAME_SECONDS, **options) -> DataFrame:
    """The whole frames of WAV files, in one pass over the audio and without a shuffle of it.

    The reader's chunks end at frame borders, so a chunk of full length is a
    frame; incomplete tails are left out. Options as in ``read_wav``.
    """
    return whole_frames(read_wav(spark, path, chunk_s=frame_s, **options), frame_s=frame_s)


def frame_name(frame_seq: Column, captured_at: Column) -> Column:
    """File name of a frame; frames are numbered from 1, milliseconds are cut."""
    stamp = F.date_format(captured_at, "HHmmss_SSS")
    return F.format_string("frame_%04d_%s.wav", frame_seq + 1, stamp)


def wav_bytes(samples: np.ndarray | bytes, rate: int) -> bytes:
    pcm = samples
    if not isinstance(samples, bytes):
        scaled = np.clip(samples, -1.0, 1.0) * np.float64(PCM16_SCALE)
        pcm = np.trunc(scaled).astype("<i2").tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as wav:
        wav.setnchannels(1)
        wav.setsampwidth(2)
        wav.setframerate(rate)
        wav.writeframes(pcm)
    return out.getvalue()


def write_wav_frames(
    frames: DataFrame, folder: str, key: str = "call_id", rate: int = CAPTURE_RATE
) -> tuple[int, int]:
    """Write each frame as a file below ``folder``/call; returns file and byte counts.

    ``folder`` has to be reachable by all executors. A task that runs twice
    writes the same files again. A row's own ``sample_rate``, if there, goes
    before ``rate``.
    """
    own = F.col("sample_rate") if "sample_rate" in frames.columns else F.lit(rate)
    named = frames.select(
        F.concat_ws(
            "/", F.lit(folder), F.col(key), frame_name(F.col("frame_seq"), F.col("captured_at"))
        ).alias("path"),
        "samples",
        own.alias("rate"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path, samples, own_rate in zip(batch["path"], batch["samples"], batch["rate"], strict=True):
                fs, name = FileSystem.from_uri(path)
                fs.create_dir(name.rsplit("/", 1)[0])
                data = wav_bytes(samples, int(own_rate))
                with fs.open_output_stream(name) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"size": sizes})

    written = named.mapInPandas(run, "size bigint").agg(
        F.count("size").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
    row = written.first()
    return row["files"], row["bytes"]
