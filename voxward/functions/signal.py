"""Signal measures and shapes on sample arrays, as column expressions.

These serve short arrays and stay in the JVM; audio-sized arrays go through
``voxward.functions.dsp`` inside Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxward.params import PCM16_SCALE, TARGET_DB, SilenceParams

_TINY = 1e-12


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once. Used for scalars inside lambdas over samples,
    which would otherwise be computed again for every sample."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(x: Column, term) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + term(v.cast("double")))


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def _rms(x: Column) -> Column:
    return F.sqrt(_sum(x, lambda v: v * v) / F.size(x))


def silence_ratio(x: Column, params: SilenceParams = SilenceParams()) -> Column:
    """Share of full chunks whose level is below the threshold; 1.0 without a full chunk."""
    n = params.chunk_samples
    chunks = F.floor(F.size(x) / n).cast("int")

    def quiet(i: Column) -> Column:
        part = F.slice(x, i * n + 1, F.lit(n))
        level = F.sqrt(_sum(part, lambda v: v * v) / n + _TINY) + _TINY
        return F.when(F.log10(level) * 20 < params.threshold_db, 1.0).otherwise(0.0)

    total = F.aggregate(F.sequence(F.lit(0), chunks - 1), F.lit(0.0), lambda a, i: a + quiet(i))
    return F.when(x.isNull(), None).when(chunks > 0, total / chunks).otherwise(1.0)


def max_amplitude(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def _zeros(count: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), count.cast("int"))


def fit_center(x: Column, n: int) -> Column:
    """Exactly ``n`` samples: the middle of a longer array, a shorter one between zeros."""
    size = F.size(x)
    cut = F.slice(x, F.floor((size - n) / 2).cast("int") + 1, F.lit(n))
    left = F.floor((F.lit(n) - size) / 2)
    padded = F.concat(_zeros(left), x, _zeros(F.lit(n) - size - left))
    return F.when(size >= n, cut).otherwise(padded)


def fit_head(x: Column, n: int) -> Column:
    """Exactly ``n`` samples: the start of a longer array, a shorter one before zeros."""
    size = F.size(x)
    return F.when(size >= n, F.slice(x, 1, n)).otherwise(F.concat(x, _zeros(F.lit(n) - size)))


def normalize_rms(x: Column, target_db: float = TARGET_DB) -> Column:
    """Scale to the target level; all but silent arrays."""
    target, level = 10 ** (target_db / 20), _rms(x)
    gain = F.when(level < 1e-9, 1.0).otherwise(F.lit(target) / level)
    return _let(gain, lambda g: F.transform(x, lambda v: v.cast("double") * g))


def normalize_dc_rms_clip(x: Column, target_db: float = TARGET_DB) -> Column:
    """Remove the mean, scale to the target level, clip to ±1."""
    target = 10 ** (target_db / 20)
    mean = _sum(x, lambda v: v) / F.size(x)

    def scaled(y: Column) -> Column:
        level = _rms(y)
        gain = F.when(level > 0, F.lit(target) / level).otherwise(1.0)
        return _let(gain, lambda g: F.transform(y, lambda v: _clip(v * g)))

    centred = _let(mean, lambda m: F.transform(x, lambda v: v.cast("double") - m))
    return _let(centred, scaled)


def minmax01(x: Column) -> Column:
    """Rescale an array to [0, 1]."""
    ends = F.struct(
        F.array_min(x).cast("double").alias("low"), F.array_max(x).cast("double").alias("high")
    )

    def scaled(e: Column) -> Column:
        span = e["high"] - e["low"] + 1e-10
        return F.transform(x, lambda v: (v.cast("double") - e["low"]) / span)

    return _let(ends, scaled)


def downmix(x: Column, channels: int) -> Column:
    """Mean over the channels of interleaved samples."""
    if channels == 1:
        return x
    frames = F.floor(F.size(x) / channels).cast("int")
    mixed = F.transform(
        F.sequence(F.lit(0), frames - 1),
        lambda i: _sum(F.slice(x, i * channels + 1, F.lit(channels)), lambda v: v) / channels,
    )
    return F.when(frames > 0, mixed).otherwise(F.array().cast("array<double>"))


def pcm16(x: Column) -> Column:
    """16-bit samples: clip to ±1, scale, cut the fraction off."""
    return F.transform(x, lambda v: (_clip(v.cast("double")) * PCM16_SCALE).cast("smallint"))
