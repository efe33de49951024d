"""NumPy kernels used inside Arrow batches.

Features work on a stack of signals, one per row, in the precision they are
given; audio comes as float32.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

from voxward.params import (
    CNN_COLUMNS,
    CNN_MEL,
    GMM_MEL,
    MODEL_RATE,
    MODEL_SAMPLES,
    N_LFCC,
    TARGET_DB,
    MelParams,
    SilenceParams,
)


def as_samples(x, dtype=np.float32) -> np.ndarray:
    """Samples of a frame: an array as it is, bytes as 16-bit PCM."""
    if isinstance(x, (bytes, bytearray, memoryview)):
        return np.frombuffer(x, "<i2").astype(dtype) / dtype(32768)
    return np.asarray(x, dtype)


def to_mono(x: np.ndarray, channels: int) -> np.ndarray:
    """Mean over the channels of interleaved samples."""
    usable = len(x) // channels * channels
    return x[:usable].reshape(-1, channels).mean(axis=1)


def silence_ratio(x: np.ndarray, params: SilenceParams = SilenceParams()) -> float:
    n = params.chunk_samples
    chunks = len(x) // n
    if not chunks:
        return 1.0
    power = np.square(x[: chunks * n].astype(np.float64)).reshape(chunks, n).mean(axis=1)
    level = 20 * np.log10(np.sqrt(power + 1e-12) + 1e-12)
    return float(np.count_nonzero(level < params.threshold_db) / chunks)


@lru_cache(maxsize=8)
def _phases(up: int, down: int, lobes: int = 32) -> tuple[np.ndarray, int]:
    """Kaiser-windowed sinc, one row of taps per output phase."""
    cutoff = min(1.0, up / down) * 0.95
    reach = int(np.ceil(lobes / cutoff))
    offsets = np.arange(-reach, reach + 1)
    shift = np.arange(up)[:, None] / up - offsets[None, :]
    edge = np.clip(shift / (reach + 1), -1, 1)
    taps = cutoff * np.sinc(cutoff * shift) * np.i0(12.0 * np.sqrt(1 - edge**2)) / np.i0(12.0)
    return taps / taps.sum(axis=1, keepdims=True), reach


@lru_cache(maxsize=8)
def _block_filter(up: int, down: int) -> tuple[np.ndarray, int, int]:
    """The taps of a block of outputs as one matrix, with the block's step in the input."""
    taps, reach = _phases(up, down)
    turns = max(1, 64 // up)
    matrix = np.zeros((turns * down + taps.shape[1], turns * up))
    for i in range(turns * up):
        start = i * down // up
        matrix[start : start + taps.shape[1], i] = taps[i * down % up]
    return matrix, turns * down, reach


# Rates whose block of outputs would need a larger matrix go phase by phase.
_MATRIX_CELLS = 1_000_000
_OUTPUTS = 4096


def resample(x: np.ndarray, rate: int, target: int = MODEL_RATE) -> np.ndarray:
    """Band-limited change of the sample rate: a matrix product over blocks of outputs.

    Odd rates, whose pattern of phases repeats late, take each output's taps by
    its phase instead; memory is bounded by the target rate.
    """
    if rate == target:
        return x
    g = gcd(rate, target)
    up, down = target // g, rate // g
    wanted = -(-len(x) * up // down)
    if up * down > _MATRIX_CELLS:
        return _by_phase(x, up, down, wanted)
    matrix, step, reach = _block_filter(up, down)
    blocks = -(-wanted // matrix.shape[1])
    need = blocks * step + len(matrix)
    padded = np.pad(x, (reach, max(0, need - reach - len(x))))
    spans = np.lib.stride_tricks.sliding_window_view(padded, len(matrix))[::step][:blocks]
    return (spans @ matrix.astype(x.dtype)).reshape(-1)[:wanted]


def _by_phase(x: np.ndarray, up: int, down: int, wanted: int) -> np.ndarray:
    taps, reach = _phases(up, down)
    taps = taps.astype(x.dtype)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (reach, taps.shape[1])), taps.shape[1])
    out = np.empty(wanted, x.dtype)
    for first in range(0, wanted, _OUTPUTS):
        i = np.arange(first, min(first + _OUTPUTS, wanted))
        out[i] = np.einsum("ij,ij->i", windows[i * down // up], taps[i * down % up])
    return out


def fit_center(x: np.ndarray, n: int = MODEL_SAMPLES, fill: float = 0.0) -> np.ndarray:
    """Last axis cropped to, or padded around, its middle."""
    short = n - x.shape[-1]
    if short <= 0:
        start = -short // 2
        return x[..., start : start + n]
    pad = [(0, 0)] * (x.ndim - 1) + [(short // 2, short - short // 2)]
    return np.pad(x, pad, constant_values=fill)


def fit_head(x: np.ndarray, n: int = MODEL_SAMPLES) -> np.ndarray:
    return x[:n] if len(x) >= n else np.pad(x, (0, n - len(x)))


def normalize_rms(x: np.ndarray, target_db: float = TARGET_DB) -> np.ndarray:
    level = np.sqrt(np.square(x).mean(axis=-1, keepdims=True))
    gain = 10 ** (target_db / 20) / np.where(level < 1e-9, 1.0, level)
    return np.where(level < 1e-9, x, x * gain)


def normalize_dc_rms_clip(x: np.ndarray, target_db: float = TARGET_DB) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    level = np.sqrt(np.square(x).mean(axis=-1, keepdims=True))
    gain = np.where(level > 0, 10 ** (target_db / 20) / np.where(level > 0, level, 1.0), 1.0)
    return np.clip(x * gain, -1.0, 1.0)


def _mel_to_hz(mel: np.ndarray) -> np.ndarray:
    # Slaney scale: linear below 1 kHz (15 mel), logarithmic above.
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def _hz_to_mel(hz: float) -> float:
    return hz * 3 / 200 if hz < 1000 else 15 + np.log(hz / 1000) * 27 / np.log(6.4)


@lru_cache(maxsize=8)
def mel_bank(p: MelParams) -> np.ndarray:
    """Triangular filters of equal area over the bins of the transform."""
    edges = _mel_to_hz(np.linspace(_hz_to_mel(p.fmin), _hz_to_mel(p.fmax), p.n_mels + 2))
    bins = np.linspace(0, p.sample_rate / 2, p.n_fft // 2 + 1)
    low, mid, high = (edges[i : i + p.n_mels, None] for i in range(3))
    rising, falling = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (high - low))


@lru_cache(maxsize=8)
def _window(p: MelParams) -> np.ndarray:
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.win) / p.win)
    return fit_center(hann, p.n_fft)


def mel_power(x: np.ndarray, p: MelParams) -> np.ndarray:
    """Power mel spectrogram of a stack of signals, shape (rows, n_mels, columns).

    Frames are centred: the ends are padded with zeros by half a transform.
    """
    half = p.n_fft // 2
    padded = np.pad(x, ((0, 0), (half, half)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, p.n_fft, axis=1)[:, :: p.hop]
    spectrum = np.fft.rfft(frames * _window(p).astype(x.dtype), axis=-1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.swapaxes(power @ mel_bank(p).T.astype(x.dtype), 1, 2)


def power_to_db(power: np.ndarray, floor: float = 1e-10, top_db: float = 80.0) -> np.ndarray:
    """Decibels below each row's maximum, no lower than ``top_db`` under it."""
    peak = power.max(axis=(1, 2), keepdims=True)
    db = 10 * (np.log10(np.maximum(power, floor)) - np.log10(np.maximum(peak, floor)))
    return np.maximum(db, db.max(axis=(1, 2), keepdims=True) - top_db)


def fit_columns(mel: np.ndarray, n: int = CNN_COLUMNS) -> np.ndarray:
    """Middle ``n`` columns; fewer are padded with the row's own minimum."""
    if mel.shape[-1] >= n:
        return fit_center(mel, n)
    return np.stack([fit_center(m, n, fill=m.min()) for m in mel])


def minmax01(x: np.ndarray) -> np.ndarray:
    low, high = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    return (x - low) / (high - low + 1e-10)


@lru_cache(maxsize=8)
def dct_rows(n: int, keep: int) -> np.ndarray:
    """First ``keep`` rows of the orthonormal DCT-II."""
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    rows = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    rows[0] /= np.sqrt(2)
    return rows


def _in_blocks(fn, audio: np.ndarray, rows: int = 4) -> np.ndarray:
    """``fn`` over a few rows at a time, so that what it allocates stays in the cache."""
    return np.concatenate([fn(audio[i : i + rows]) for i in range(0, len(audio), rows)])


def cnn_features(audio: np.ndarray) -> np.ndarray:
    """(rows, 60, 79) features in [0, 1] of 16 kHz signals cut to the model's length."""

    def block(x: np.ndarray) -> np.ndarray:
        mel = power_to_db(mel_power(normalize_dc_rms_clip(x), CNN_MEL))
        return minmax01(fit_columns(mel)).astype(np.float32)

    return _in_blocks(block, audio)


def cepstra(mel: np.ndarray, keep: int) -> np.ndarray:
    """First coefficients of the log spectrum, (rows, columns, keep)."""
    log_mel = np.swapaxes(np.log(mel + 1e-9), 1, 2).astype(np.float64)
    return log_mel @ dct_rows(mel.shape[1], keep).T


def lfcc(audio: np.ndarray) -> np.ndarray:
    """(rows, columns, 20) cepstra of 16 kHz signals cut to the model's length."""
    return _in_blocks(lambda x: cepstra(mel_power(normalize_rms(x), GMM_MEL), N_LFCC), audio)


def mixture_loglik(
    x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray
) -> np.ndarray:
    """Log density of each row of ``x`` under a Gaussian mixture."""
    factors = np.linalg.cholesky(covs)
    logs = []
    for w, mean, factor in zip(weights, means, factors, strict=True):
        z = np.linalg.solve(factor, (x - mean).T)
        log_det = np.log(np.diag(factor)).sum()
        logs.append(np.log(w) - log_det - 0.5 * (np.square(z).sum(axis=0) + len(mean) * np.log(2 * np.pi)))
    logs = np.stack(logs)
    peak = logs.max(axis=0)
    return peak + np.log(np.exp(logs - peak).sum(axis=0))
