"""Frame quality: silence and loudness, before any model runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxward.functions import dsp, signal
from voxward.params import SilenceParams

DEFAULT = SilenceParams()


def measures_of_audio(samples: Column, params: SilenceParams = DEFAULT, rate: Column | None = None) -> Column:
    """Silence ratio and loudest sample of audio-sized arrays, in one Arrow pass; ``rate`` is each row's own."""

    def measure(batch: pd.Series, rates: pd.Series) -> pd.DataFrame:
        batch = [dsp.as_samples(x) for x in batch]
        ratios = [dsp.silence_ratio(x, params.at(r)) for x, r in zip(batch, rates, strict=True)]
        peaks = [np.abs(x).max() if len(x) else None for x in batch]
        return pd.DataFrame({"ratio": ratios, "peak": peaks})

    # Marked so that a filter on the result is not pushed below and the audio measured twice.
    once = F.pandas_udf(measure, "ratio double, peak float").asNondeterministic()
    return once(samples, rate if rate is not None else F.lit(params.sample_rate))


def frame_quality(
    frames: DataFrame, params: SilenceParams = DEFAULT, audio: bool = False
) -> DataFrame:
    """Add ``silence_ratio``, ``max_amplitude`` and ``is_silent``.

    ``audio`` picks the Arrow form, for long arrays and PCM bytes, with windows
    by the row's ``sample_rate`` if there; short arrays stay in the JVM.
    """
    x = F.col("samples")
    if audio:
        rate = F.col("sample_rate") if "sample_rate" in frames.columns else None
        out = frames.withColumn("_m", measures_of_audio(x, params, rate))
        ratio, peak = F.col("_m.ratio"), F.col("_m.peak")
        out = out.withColumns({"silence_ratio": ratio, "max_amplitude": peak}).drop("_m")
    else:
        ratio, peak = signal.silence_ratio(x, params), signal.max_amplitude(x)
        out = frames.withColumns({"silence_ratio": ratio, "max_amplitude": peak})
    # Exactly at the limit is not silent.
    return out.withColumn("is_silent", F.col("silence_ratio") > params.max_ratio)


def drop_silent(frames: DataFrame, params: SilenceParams = DEFAULT, audio: bool = False) -> DataFrame:
    """Frames worth scoring. Placed before the models, as Spark moves no filter below them."""
    return frame_quality(frames, params, audio).filter(~F.col("is_silent"))
