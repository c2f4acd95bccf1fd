"""Window features that need transforms: numpy over Arrow batches of windows.

The function is row-wise. Windows of one length are stacked into a matrix, so a batch costs a
few vector operations per feature and window length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

WIDTHS = (2, 5, 10, 20)
BINS = (2, 3, 5, 10, 100)
FFT_ATTRS = ("real", "imag", "abs", "angle")
AR_ORDER = 10


@dataclass(frozen=True)
class Spectral:
    """A feature by name, and the shortest window for which it is not missing or constant."""

    name: str
    min_n: int


def _names() -> list[Spectral]:
    out = []
    for k in range(100):
        for attr in FFT_ATTRS:
            need = max(2 * k, 1) if attr in ("real", "abs", "angle") else 2 * k + 1
            # the zero-frequency term has no imaginary part
            out.append(Spectral(f'fft_coefficient__attr_"{attr}"__coeff_{k}', 10 ** 9 if (k, attr) == (0, "imag") else need))
    for kind in ("centroid", "variance", "skew", "kurtosis"):
        out.append(Spectral(f'fft_aggregated__aggtype_"{kind}"', 2))
    for b in BINS:
        out.append(Spectral(f"fourier_entropy__bins_{b}", 4))
    for c in (2, 5, 8):
        out.append(Spectral(f"spkt_welch_density__coeff_{c}", 2 * c))
    for c in range(15):
        for w in WIDTHS:
            out.append(Spectral(f"cwt_coefficients__coeff_{c}__w_{w}__widths_{WIDTHS}", c + 1))
    for c in range(AR_ORDER + 1):
        out.append(Spectral(f"ar_coefficient__coeff_{c}__k_{AR_ORDER}", 2 * AR_ORDER + 1))
    for lag in range(10):
        # the partial autocorrelation is limited to half the window
        out.append(Spectral(f"partial_autocorrelation__lag_{lag}", 2 * lag + 2 if lag else 10 ** 9))
    for b in BINS:
        out.append(Spectral(f"lempel_ziv_complexity__bins_{b}", 2))
    for d in range(3, 8):
        out.append(Spectral(f"permutation_entropy__dimension_{d}__tau_1", d + 1))
    out.append(Spectral('linear_trend__attr_"pvalue"', 3))
    return out


SPECTRAL: tuple[Spectral, ...] = tuple(_names())


def by_length(function, width: int):
    """An Arrow UDF from windows to `width` values each; `function` maps a matrix of windows of one length to theirs."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def values(xs: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy()
        out = np.full((len(xs), width), np.nan)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            windows = xs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            out[at] = function(windows.reshape(len(at), n).astype(float))
        cells = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1) * width, pa.int32()), cells)

    return values


def spectral_values(names: list[str]):
    """From windows to the named features, in that order."""
    return by_length(lambda m: window_matrix_features(m, names), len(names))


TREND_CHUNKS, TREND_STATS, TREND_ATTRS = (5, 10, 50), ("max", "min", "mean", "var"), ("slope", "intercept", "rvalue", "stderr")


def chunk_trends(m: np.ndarray) -> np.ndarray:
    """`(rows, n)` windows to the lines through statistics of their chunks: chunk lengths, statistics, attributes."""
    rows, n = m.shape
    out = []
    for chunk in TREND_CHUNKS:
        if n <= chunk:
            out += [np.full(rows, np.nan)] * (len(TREND_STATS) * len(TREND_ATTRS))
            continue
        at = np.arange(0, n, chunk)
        size = np.diff(at, append=n)
        apart = m - np.repeat(m[:, at], size, axis=1)
        s, q = np.add.reduceat(apart, at, axis=1), np.add.reduceat(apart * apart, at, axis=1)
        stats = {
            "max": np.maximum.reduceat(m, at, axis=1), "min": np.minimum.reduceat(m, at, axis=1),
            "mean": np.add.reduceat(m, at, axis=1) / size, "var": np.maximum((size * q - s * s) / (size * size), 0),
        }
        for stat in TREND_STATS:
            line = _lines(stats[stat])
            out += [line[attr] for attr in TREND_ATTRS]
    return np.stack(out, axis=1)


def _lines(ys: np.ndarray) -> dict[str, np.ndarray]:
    """Least squares lines through the rows of `ys` over 0, 1, 2, ..., shifted by the first value."""
    k = ys.shape[1]
    y, t = ys - ys[:, :1], np.arange(k)
    my, raw, tt = y.mean(axis=1), (y * y).mean(axis=1), (k * k - 1) / 12
    yy, ty = raw - my * my, (t * y).mean(axis=1) - (k - 1) / 2 * my
    with np.errstate(all="ignore"):
        r = np.where(yy <= 1e-14 * raw, 0.0, np.clip(ty / np.sqrt(tt * yy), -1, 1))
    stderr = np.zeros(len(ys)) if k == 2 else np.sqrt((1 - r * r) * np.maximum(yy, 0) / tt / (k - 2))
    return {"slope": ty / tt, "intercept": ys[:, 0] + my - ty / tt * (k - 1) / 2, "rvalue": r, "stderr": stderr}


def window_matrix_features(m: np.ndarray, names: list[str]) -> np.ndarray:
    """`(rows, n)` windows of one length to `(rows, features)`; NaN where a feature is missing."""
    blocks: dict[str, dict[str, np.ndarray]] = {}
    out = np.full((len(m), len(names)), np.nan)
    with np.errstate(all="ignore"):
        for j, name in enumerate(names):
            family = name.split("__", 1)[0]
            if family not in blocks:
                blocks[family] = _FAMILIES[family](m)
            column = blocks[family].get(name)
            if column is not None:
                out[:, j] = column
    out[~np.isfinite(out)] = np.nan
    return out


def _fft(m):
    f = np.fft.rfft(m, axis=1)
    parts = {"real": f.real, "imag": f.imag, "abs": np.abs(f), "angle": np.angle(f, deg=True)}
    return {
        f'fft_coefficient__attr_"{a}"__coeff_{k}': parts[a][:, k]
        for k in range(min(100, f.shape[1])) for a in FFT_ATTRS
    }


def _fft_aggregated(m):
    power = np.abs(np.fft.rfft(m, axis=1))
    freq = np.arange(power.shape[1], dtype=float)
    moment = lambda p: power @ freq ** p / power.sum(axis=1)
    c, m2, m3, m4 = (moment(p) for p in (1, 2, 3, 4))
    var = m2 - c ** 2
    wide = np.where(var < 0.5, np.nan, var)
    values = {
        "centroid": c,
        "variance": var,
        "skew": (m3 - 3 * c * var - c ** 3) / wide ** 1.5,
        "kurtosis": (m4 - 4 * c * m3 + 6 * m2 * c ** 2 - 3 * c) / wide ** 2,
    }
    return {f'fft_aggregated__aggtype_"{k}"': v for k, v in values.items()}


def welch_density(m: np.ndarray) -> np.ndarray:
    """Power density: mean over half-overlapping Hann segments of at most 256 values."""
    n = m.shape[1]
    size = min(n, 256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    starts = range(0, n - size + 1, size - size // 2)
    total = 0
    for s in starts:
        seg = m[:, s:s + size]
        seg = (seg - seg.mean(axis=1, keepdims=True)) * window
        total = total + np.abs(np.fft.rfft(seg, axis=1)) ** 2
    density = total / len(starts) / (window ** 2).sum()
    density[:, 1:(-1 if size % 2 == 0 else None)] *= 2
    return density


def _welch(m):
    d = welch_density(m)
    return {f"spkt_welch_density__coeff_{c}": d[:, c] for c in (2, 5, 8) if c < d.shape[1]}


def _shares_entropy(codes: np.ndarray) -> np.ndarray:
    """Entropy of the values in each row."""
    codes = np.sort(codes, axis=1)
    rows, n = codes.shape
    starts = np.ones((rows, n), bool)
    starts[:, 1:] = codes[:, 1:] != codes[:, :-1]
    flat = np.flatnonzero(starts)
    counts = np.diff(np.append(flat, rows * n))
    p = counts / n
    return -np.bincount(flat // n, weights=p * np.log(p), minlength=rows)


def _fourier_entropy(m):
    d = welch_density(m)
    top = d.max(axis=1, keepdims=True)
    d = d / top
    low, high = d.min(axis=1, keepdims=True), d.max(axis=1, keepdims=True)
    out = {}
    for b in BINS:
        slot = np.where(high > low, np.minimum(np.floor((d - low) / (high - low) * b), b - 1), 0)
        entropy = _shares_entropy(slot)
        out[f"fourier_entropy__bins_{b}"] = np.where(top[:, 0] > 0, entropy, np.nan)
    return out


def _cwt(m):
    rows, n = m.shape
    out = {}
    for w in WIDTHS:
        points = min(10 * w, n)
        t = np.arange(points) - (points - 1) / 2
        wavelet = 2 / (np.sqrt(3 * w) * np.pi ** 0.25) * (1 - (t / w) ** 2) * np.exp(-(t / w) ** 2 / 2)
        # centred part of the full convolution
        full = np.fft.irfft(np.fft.rfft(m, n + points - 1, axis=1) * np.fft.rfft(wavelet, n + points - 1), n + points - 1, axis=1)
        start = (points - 1) // 2
        for c in range(min(15, n)):
            out[f"cwt_coefficients__coeff_{c}__w_{w}__widths_{WIDTHS}"] = full[:, start + c]
    return out


def _ar(m):
    rows, n = m.shape
    k = AR_ORDER
    if n < 2 * k + 1:
        return {}
    lags = np.stack([np.ones((rows, n - k)), *[m[:, k - i:n - i] for i in range(1, k + 1)]], axis=2)
    coeffs = (np.linalg.pinv(lags, rcond=np.finfo(float).eps * max(lags.shape[1:])) @ m[:, k:, None])[:, :, 0]
    return {f"ar_coefficient__coeff_{c}__k_{k}": coeffs[:, c] for c in range(k + 1)}


def _pacf(m):
    """Durbin-Levinson recursion on bias-adjusted autocovariances."""
    rows, n = m.shape
    top = min(9, n // 2 - 1)
    if top < 1:
        return {}
    dv = m - m.mean(axis=1, keepdims=True)
    cov = np.stack([(dv[:, :n - l] * dv[:, l:]).sum(axis=1) / (n - l) for l in range(top + 1)], axis=1)
    out = {"partial_autocorrelation__lag_0": np.ones(rows)}
    phi = np.zeros((rows, 0))
    error = cov[:, 0]
    for l in range(1, top + 1):
        step = (cov[:, l] - (phi * cov[:, l - 1:0:-1]).sum(axis=1)) / error
        phi = np.column_stack([phi - step[:, None] * phi[:, ::-1], step])
        error = error * (1 - step ** 2)
        out[f"partial_autocorrelation__lag_{l}"] = step
    return out


def distinct_phrases(symbols: np.ndarray, kinds: int) -> np.ndarray:
    """For each row the number of phrases when each new phrase is the shortest one not seen before.

    A phrase is the number of the phrase that it extends and a symbol below `kinds`; all rows advance together.
    """
    rows, n = symbols.shape
    seen, count, phrase, each = np.full((rows, n), -1), np.zeros(rows, int), np.zeros(rows, int), np.arange(rows)
    for t in range(n):
        key = phrase * kinds + symbols[:, t]
        same = seen[:, :t] == key[:, None]
        known = same.any(axis=1)
        phrase = np.where(known, same.argmax(axis=1) + 1 if t else 0, 0)
        fresh = each[~known]
        seen[fresh, count[fresh]] = key[fresh]
        count[fresh] += 1
    return count


def _lempel_ziv(m):
    n = m.shape[1]
    low, high = m.min(axis=1), m.max(axis=1)
    out = {}
    for b in BINS:
        edges = np.linspace(low, high, b + 1, axis=1)[:, 1:]
        symbols = (edges[:, None, :] < m[:, :, None]).sum(axis=2)
        out[f"lempel_ziv_complexity__bins_{b}"] = distinct_phrases(symbols, b) / n
    return out


def _permutation(m):
    n = m.shape[1]
    out = {}
    for d in range(3, min(7, n) + 1):
        parts = np.lib.stride_tricks.sliding_window_view(m, d, axis=1)
        ranks = np.argsort(np.argsort(parts, axis=2), axis=2)
        out[f"permutation_entropy__dimension_{d}__tau_1"] = _shares_entropy(ranks @ (d ** np.arange(d)))
    return out


def student_two_sided(t: np.ndarray, df: int) -> np.ndarray:
    """P(|T| > |t|) of Student's t with whole degrees of freedom, by the finite series."""
    theta = np.arctan(np.abs(t) / np.sqrt(df))
    c2 = np.cos(theta) ** 2
    term = np.ones_like(theta)
    total = np.zeros_like(theta)
    if df % 2:
        if df > 1:
            term = np.cos(theta)
            total = term.copy()
            for i in range(3, df - 1, 2):
                term = term * c2 * (i - 1) / i
                total = total + term
            total = total * np.sin(theta)
        inside = 2 / np.pi * (theta + total)
    else:
        total = term.copy()
        for i in range(2, df - 1, 2):
            term = term * c2 * (i - 1) / i
            total = total + term
        inside = np.sin(theta) * total
    return np.clip(1 - inside, 0, 1)


def _trend_p(m):
    n = m.shape[1]
    if n < 3:
        return {}
    t = np.arange(n) - (n - 1) / 2
    dv = m - m.mean(axis=1, keepdims=True)
    norm = np.sqrt((t ** 2).sum() * (dv ** 2).sum(axis=1))
    r = np.where(norm > 0, np.clip(dv @ t / norm, -1, 1), 0.0)
    stat = r * np.sqrt((n - 2) / ((1 - r + 1e-20) * (1 + r + 1e-20)))
    return {'linear_trend__attr_"pvalue"': student_two_sided(stat, n - 2)}


_FAMILIES = {
    "fft_coefficient": _fft,
    "fft_aggregated": _fft_aggregated,
    "fourier_entropy": _fourier_entropy,
    "spkt_welch_density": _welch,
    "cwt_coefficients": _cwt,
    "ar_coefficient": _ar,
    "partial_autocorrelation": _pacf,
    "lempel_ziv_complexity": _lempel_ziv,
    "permutation_entropy": _permutation,
    "linear_trend": _trend_p,
}
