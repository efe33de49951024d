"""Model features of audio frames, computed in Arrow batches.

``samples`` is an array, or bytes of 16-bit PCM: half the size, and cheaper to
store and to hand to Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxward.functions import dsp
from voxward.params import MODEL_RATE, MelParams

KEYS = ("host_id", "frame_seq", "captured_at")


def model_audio(samples: pd.Series, rates: pd.Series, fit) -> np.ndarray:
    """Signals at the models' rate and length, stacked."""
    pairs = zip(samples, rates, strict=True)
    return np.stack([fit(dsp.resample(dsp.as_samples(x), r)) for x, r in pairs])


def arrow_column(values: Sequence, kind: T.DataType) -> pa.Array:
    """A column of numbers, or of arrays of any depth, whose numbers stay NumPy's and never become Python objects.

    NaN becomes NULL, as in columns from pandas.
    """
    if not isinstance(kind, T.ArrayType):
        return pa.array(np.asarray(values), to_arrow_type(kind), from_pandas=True)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    inner = kind.elementType
    if isinstance(inner, T.ArrayType):
        flat = arrow_column([row for rows in values for row in rows], inner)
    else:
        flat = arrow_column(np.concatenate(values) if len(values) else [], inner)
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def per_batch(frames: DataFrame, keys: tuple[str, ...], fields: list[T.StructField], fn) -> DataFrame:
    """Run ``fn`` over batches and put its columns beside ``keys``; the audio stays behind."""
    keys = tuple(keys)
    schema = T.StructType([frames.schema[k] for k in keys] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(*[batch.column(c).to_pandas() for c in ("samples", "sample_rate")])
                columns = [arrow_column(values, f.dataType) for values, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], schema.names)

    return frames.select(*keys, "samples", "sample_rate").mapInArrow(run, schema)


def resample(
    frames: DataFrame, rate: int = MODEL_RATE, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Frames at another sample rate, in the precision of their samples."""
    kind = frames.schema["samples"].dataType
    if not isinstance(kind, T.ArrayType):
        kind = T.ArrayType(T.FloatType())
    exact = np.float64 if kind.elementType == T.DoubleType() else np.float32

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        pairs = zip(samples, rates, strict=True)
        return [rate] * len(samples), [
            dsp.resample(dsp.as_samples(x, exact), r, rate) for x, r in pairs
        ]

    fields = [
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("samples", kind),
    ]
    return per_batch(frames, keys, fields, fn)


def mel_spectrogram(
    frames: DataFrame, params: MelParams, keys: tuple[str, ...] = KEYS, db: bool = False
) -> DataFrame:
    """Mel spectrogram per frame, band by band: power, or with ``db`` decibels below its maximum."""

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        mels = [dsp.mel_power(dsp.as_samples(x, np.float64)[None], params) for x in samples]
        mels = [dsp.power_to_db(m) for m in mels] if db else mels
        return ([list(m[0]) for m in mels],)

    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    return per_batch(frames, keys, [T.StructField("mel", kind)], fn)


def cepstra(
    frames: DataFrame, params: MelParams, keep: int, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Cepstral coefficients per frame and column, for any spectrogram shape."""

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        mels = [dsp.mel_power(dsp.as_samples(x, np.float64)[None], params) for x in samples]
        return ([list(dsp.cepstra(m, keep)[0]) for m in mels],)

    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    return per_batch(frames, keys, [T.StructField("cepstra", kind)], fn)


def cnn_features(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """60 × 79 spectrogram in [0, 1] per frame, row by row in one array."""

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        mel = dsp.cnn_features(model_audio(samples, rates, dsp.fit_center))
        return (list(mel.reshape(len(mel), -1)),)

    return per_batch(frames, keys, [T.StructField("mel", T.ArrayType(T.FloatType()))], fn)


def lfcc(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Cepstra per frame: an array of 20 values for each column."""

    def fn(samples: pd.Series, rates: pd.Series) -> tuple:
        cepstra = dsp.lfcc(model_audio(samples, rates, dsp.fit_head))
        return ([list(rows) for rows in cepstra],)

    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    return per_batch(frames, keys, [T.StructField("lfcc", kind)], fn)
