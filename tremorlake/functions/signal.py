"""Signal kernels on arrays of samples, Arrow batches in and out.

Spectra and recursive filters have no form within the JVM; everything else is in tremorlake.functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class SignalError(ValueError):
    """Samples or settings that can't be processed."""


def band_edges(low: float, high: float, bands: int) -> np.ndarray:
    return np.geomspace(low, high, bands + 1)


def band_shares(x: np.ndarray, fs: float, edges: np.ndarray) -> np.ndarray:
    """x: samples x channels.  Share of each band [low, high) in the channels' mean power, Hann-windowed."""
    x = np.nan_to_num(np.asarray(x, float))
    x = x[:, None] if x.ndim == 1 else x
    power = (np.abs(np.fft.rfft((x - x.mean(0)) * np.hanning(len(x))[:, None], axis=0)) ** 2).mean(1)
    at = np.searchsorted(edges, np.fft.rfftfreq(len(x), 1 / fs), side="right") - 1
    ok = (at >= 0) & (at < len(edges) - 1)
    sums = np.bincount(at[ok], power[ok], len(edges) - 1)
    return sums / sums.sum() if sums.sum() > 0 else np.full(len(sums), 1 / len(sums))


def band_fractions(samples: str, fs: float, edges: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def shares(column: pd.Series) -> pd.Series:
        return pd.Series([band_shares(np.asarray(a), fs, edges) if a is not None and len(a) else None for a in column])

    return shares(F.col(samples).cast("array<double>"))


def coherence(x: np.ndarray, least: int = 8) -> float:
    """How alike the channels are: the middle size of the cosines between those that vary, from their Gram matrix.

    0 for fewer than two of them or fewer samples than least."""
    x = np.atleast_2d(np.asarray(x, float))
    n, _ = x.shape
    unit = x - x.mean(0)
    length = np.linalg.norm(unit, axis=0)
    unit = unit[:, length > 1e-12 * np.sqrt(n)]
    k = unit.shape[1]
    if n < least or k < 2:
        return 0.0
    unit = unit / np.linalg.norm(unit, axis=0)
    gram = unit.T @ unit
    return float(np.median(np.abs(gram[~np.tri(k, dtype=bool)])))


def excess(x: np.ndarray) -> float:
    """Median over channels of the unbiased excess kurtosis, 0 where no channel has one."""
    x = np.asarray(x, float)
    n = len(x)
    moments = [((x - x.mean(0)) ** k).sum(0) / max(n, 1) for k in (2, 4)]
    ok = moments[0] > 0
    if n < 4 or not ok.any():
        return 0.0
    g = moments[1][ok] / moments[0][ok] ** 2 - 3
    return float(np.median(((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))))


#: Frames of an envelope, bands of a signature and their limits in hertz.
FRAMES, SIGNATURE_BANDS = 8, (20.0, 2000.0, 12)


def envelope(x: np.ndarray, frames: int = FRAMES) -> np.ndarray:
    """Of centred channels: the RMS over all of them in equal frames, as a unit vector."""
    width = len(x) // frames
    energy = (x[: width * frames] ** 2).mean(1).reshape(frames, width).mean(1) + 1e-20 if width else np.ones(frames)
    return np.sqrt(energy / energy.sum())


def periodogram_shares(trace: np.ndarray, fs: float, low: float, high: float, bands: int) -> np.ndarray:
    """Shares of log bands in the one-sided power spectrum of a trace."""
    n = len(trace)
    power = np.abs(np.fft.rfft(trace - trace.mean()) / n) ** 2
    power[1 : (n + 1) // 2] *= 2
    total = np.histogram(np.fft.rfftfreq(n, 1 / fs), band_edges(low, high, bands) * np.append(np.ones(bands), 1 - 1e-12), weights=power)[0]
    total = np.maximum(total, 1e-20)
    return total / total.sum()


def signature(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """What detections are compared by: the envelope of all channels and the spectrum of their median trace."""
    x = np.asarray(x, float) - np.median(x, 0)
    return envelope(x), periodogram_shares(np.median(x, 1), fs, *SIGNATURE_BANDS)


@lru_cache(maxsize=8)
def butterworth(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Band-pass sections (b0 b1 b2 1 a1 a2) from the analogue prototype by the bilinear transform."""
    if not 0 < low < high < fs / 2 or order < 1:
        raise SignalError(f"the band must lie within 0 < low < high < {fs / 2:g} Hz")
    warped = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, mid = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    scaled = prototype * width / 2
    root = np.sqrt(scaled * scaled - mid * mid)
    analogue = np.concatenate([scaled + root, scaled - root])
    poles = (2 * fs + analogue) / (2 * fs - analogue)
    upper = poles[poles.imag > 1e-14]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-14].real)
    sections = [[1, 0, -1, 1, -2 * p.real, abs(p) ** 2] for p in upper]
    sections += [[1, 0, -1, 1, -(a + b), a * b] for a, b in zip(real[::2], real[1::2], strict=True)]
    sos = np.array(sections, float)
    centre = np.exp(2j * np.arctan(mid / (2 * fs)))
    gain = np.prod([(s[0] + s[1] / centre + s[2] / centre**2) / (1 + s[4] / centre + s[5] / centre**2) for s in sos])
    sos[0, :3] /= np.abs(gain)
    return sos


def steady_state(section: np.ndarray) -> np.ndarray:
    """Delays of a section at rest under a constant input of 1."""
    b, a = section[:3], section[3:]
    y = b.sum() / a.sum()
    return np.array([y - b[0], b[2] - a[2] * y])


def run_sections(sos: np.ndarray, x: np.ndarray, start: bool) -> np.ndarray:
    """x: samples x channels through all sections; with start, from rest at the first sample."""
    y = x.copy()
    level = y[0].copy()
    for s in sos:
        z = steady_state(s)[:, None] * level if start else np.zeros((2, y.shape[1]))
        level = level * s[:3].sum() / s[3:].sum()
        z1, z2 = z[0].copy(), z[1].copy()
        for i in range(len(y)):
            v = y[i]
            out = s[0] * v + z1
            z1 = s[1] * v - s[4] * out + z2
            z2 = s[2] * v - s[5] * out
            y[i] = out
    return y


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forwards and backwards over the signal lengthened by its odd reflection."""
    zeros = min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = int(min(3 * (2 * len(sos) + 1 - zeros), len(x) - 1))
    wide = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    there = run_sections(sos, wide, True)
    back = run_sections(sos, there[::-1], True)[::-1]
    return back[pad : pad + len(x)]


def preprocess(x: np.ndarray, fs: float, band: tuple[float, float] | None = (20.0, 2000.0), order: int = 4, centre: str = "median") -> np.ndarray:
    """Centre, take off the line, band-pass; not a finite sample more or less."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    if not np.isfinite(x).all():
        raise SignalError(f"{int((~np.isfinite(x)).sum())} samples are not finite")
    if centre not in ("median", "mean", "none"):
        raise SignalError(f"unknown centre {centre}")
    if centre != "none":
        x = x - (np.median(x, 0) if centre == "median" else x.mean(0))
    t = np.arange(len(x)) - (len(x) - 1) / 2
    if len(x) > 1:
        x = x - x.mean(0) - t[:, None] * ((t @ x) / (t @ t))
    return zero_phase(x, butterworth(order, *band, fs)) if band else x
