"""Audio rows: mono mix, resampling, energy and log-mel features over ARRAY<FLOAT> columns, in numpy batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE, N_FFT, HOP, MELS, FRAMES = 16_000, 400, 160, 80, 3_000


def to_mono(interleaved: np.ndarray, channels: int) -> np.ndarray:
    if channels <= 1:
        return interleaved
    whole = len(interleaved) // channels * channels
    return interleaved[:whole].reshape(-1, channels).mean(axis=1)


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation; the length is the rounded ratio of the rates."""
    if not len(x) or source == target:
        return x
    at = np.arange(int(np.floor(len(x) * target / source + 0.5))) * (source / target)
    return np.interp(at[at <= len(x) - 1 + 1e-12] if at[-1] > len(x) else at, np.arange(len(x)), x)


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0


def meter_level(r: float) -> float:
    """0 to 1: decibels from -50 to 0, curved."""
    if r <= 1e-4:
        return 0.0
    return float(np.clip((20 * np.log10(r + 1e-6) + 50) / 50, 0, 1) ** 1.4)


def is_silence(x: np.ndarray, threshold: float) -> bool:
    return rms(x) < threshold


def sine(hz: float, seconds: float, rate: int = RATE, volume: float = 1.0) -> np.ndarray:
    return np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * volume


@lru_cache(maxsize=1)
def mel_filters() -> np.ndarray:
    """(MELS, N_FFT / 2 + 1) triangles between points evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    top = 2595 * np.log10(1 + RATE / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = (N_FFT + 1) * hz / RATE
    k = np.arange(N_FFT // 2 + 1)[None, :]
    left, centre, right = bins[:-2, None], bins[1:-1, None], bins[2:, None]
    return np.clip(np.minimum((k - left) / (centre - left), (right - k) / (right - centre)), 0, None)


def log_mel(x: np.ndarray) -> np.ndarray:
    """(MELS, FRAMES): Hann-windowed power spectra of 30 seconds (padded or cut), mel bands, log10, clamped to 8 below the
    greatest, then (v + 4) / 4."""
    x = np.asarray(x, dtype=np.float64)[: RATE * 30]
    x = np.pad(x, (0, N_FFT + HOP * (FRAMES - 1) - len(x))) if len(x) < N_FFT + HOP * (FRAMES - 1) else x[: N_FFT + HOP * (FRAMES - 1)]
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP][:FRAMES]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    v = np.log10(np.maximum(mel_filters() @ power.T, 1e-10))
    return (np.maximum(v, v.max() - 8) + 4) / 4


def mono_column(samples: Column, channels: Column, rate: Column) -> Column:
    """Any channels and rate to 16 kHz mono."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series, c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else resampled(to_mono(np.asarray(x, dtype=np.float64), int(n)), int(q), RATE).astype(np.float32) for x, n, q in zip(s, c, r)])

    return run(samples, channels, rate)


def log_mel_column(samples: Column) -> Column:
    """80 x 3000 features, row by row in one array."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else log_mel(np.asarray(x)).astype(np.float32).ravel() for x in s])

    return run(samples)
