"""p-values for the association of a feature with the target, over Arrow batches of columns."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


ROWS = 4096  # features that are ranked together


def _tie_sums(v: np.ndarray) -> tuple[float, float, float]:
    counts = np.unique(v, return_counts=True)[1].astype(float)
    return (
        (counts * (counts - 1) / 2).sum(),
        (counts * (counts - 1) * (counts - 2)).sum(),
        (counts * (counts - 1) * (2 * counts + 5)).sum(),
    )


def concordance(x: np.ndarray, y: np.ndarray) -> float:
    """Concordant minus discordant pairs.

    With x in order, a pair counts by the order of its y. All blocks of a length are handled at
    once: for each y of a right half, how many of the left half lie below and above. Equal x are
    taken out by their own pairs. O(n log^2 n) array work.
    """
    order = np.lexsort((y, x))
    whole = _ascents(np.unique(y, return_inverse=True)[1][order])
    starts = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
    lengths = np.diff(starts, append=len(x))
    # Inside equal x, y ascends: every pair of unlike y was counted as an ascent.
    tied = sum(_unlike_pairs(y[order][s:s + k]) for s, k in zip(starts, lengths) if k > 1)
    return float(whole - tied)


def _unlike_pairs(y: np.ndarray) -> int:
    counts = np.unique(y, return_counts=True)[1]
    return (len(y) * (len(y) - 1) - int((counts * (counts - 1)).sum())) // 2


def _ascents(rank: np.ndarray) -> int:
    """Ascents minus descents over all pairs of positions; ranks are whole numbers from 0."""
    n, span = len(rank), int(rank.max()) + 1
    at, half, total = np.arange(n), 1, 0
    while half < n:
        block = at // (2 * half)
        right = (at // half) % 2 == 1
        left = np.sort((block * span + rank)[~right])
        low = np.searchsorted(left, block[right] * span)
        here = block[right] * span + rank[right]
        high = np.searchsorted(left, (block[right] + 1) * span)
        total += int((np.searchsorted(left, here) - low).sum()) - int((high - np.searchsorted(left, here, side="right")).sum())
        half *= 2
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau-b and its two-sided p-value by the normal approximation with tie correction."""
    n = len(x)
    if n < 2:
        return math.nan, math.nan
    s = concordance(x, y)
    (tx, x0, x1), (ty, y0, y1) = _tie_sums(x), _tie_sums(y)
    pairs = n * (n - 1) / 2
    if tx == pairs or ty == pairs:
        return math.nan, math.nan
    tau = s / math.sqrt((pairs - tx) * (pairs - ty))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m
    if n > 2:
        var += x0 * y0 / (9 * m * (n - 2))
    return tau, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2))


def two_sample_ks(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p-value of the two-sample Kolmogorov-Smirnov test."""
    a, b = np.sort(a), np.sort(b)
    n, m = len(a), len(b)
    every = np.concatenate([a, b])
    gaps = np.searchsorted(a, every, side="right") * m - np.searchsorted(b, every, side="right") * n
    reach = int(np.abs(gaps).max())  # the statistic times n * m, a whole number
    if reach == 0:
        return 1.0
    return _outside_share(n, m, reach)


@lru_cache(maxsize=100_000)
def _outside_share(n: int, m: int, reach: int) -> float:
    """Share of the monotone lattice paths from (0, 0) to (n, m) that touch |i*m - j*n| >= reach.

    Built up from the points on the border, so that a tiny share keeps its digits; one
    diagonal i + j at a time, for any n and m.
    """
    i = np.arange(n + 1)
    share = np.zeros(n + 1)
    for total in range(1, n + m + 1):
        j = total - i
        inside = (j >= 0) & (j <= m)
        from_left = np.zeros(n + 1)
        from_left[1:] = share[:-1] * i[1:]
        share = np.where(inside, np.where(np.abs(i * m - j * n) >= reach, 1.0, (from_left + share * j) / total), 0.0)
    return float(share[n])


def association(x: np.ndarray, y: np.ndarray) -> float:
    """p-value of feature `x` against target `y`; NaN for a constant feature.

    A feature with two values splits the target into two samples; any other is ranked.
    """
    values = np.unique(x)
    if len(values) < 2:
        return math.nan
    if len(values) == 2:
        return two_sample_ks(y[x == values[1]], y[x == values[0]])
    return kendall(x, y)[1]


def _run_lengths(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs of equal values in the rows of an ordered matrix, and where each row's first run stands."""
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(new)
    return np.diff(at, append=new.size).astype(float), np.flatnonzero(at % ordered.shape[1] == 0)


def _net_ascents(rank: np.ndarray) -> np.ndarray:
    """Ascents minus descents over all pairs of positions of each row; ranks are whole numbers from 0.

    The merge passes of `_ascents`, for all rows at once: a block's key is that of its row and place.
    """
    rows, n = rank.shape
    span, at, half = int(rank.max()) + 1, np.arange(n), 1
    total = np.zeros(rows, np.int64)
    while half < n:
        blocks = -(-n // (2 * half))
        block = np.arange(rows)[:, None] * blocks + (at // (2 * half))[None, :]
        right = (at // half) % 2 == 1
        key = block * span + rank
        left = np.sort(key[:, ~right], axis=1).ravel()  # rows follow each other, so the whole is in order
        here, base = key[:, right].ravel(), (block[:, right] * span).ravel()
        low, high = np.searchsorted(left, base), np.searchsorted(left, base + span)
        net = (np.searchsorted(left, here) - low) - (high - np.searchsorted(left, here, side="right"))
        total += net.reshape(rows, -1).sum(axis=1)
        half *= 2
    return total


def association_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`association` of each row of `x` with `y`; `y` is sorted once for all."""
    rows, n = x.shape
    out = np.full(rows, np.nan)
    if n < 2 or not rows:
        return out
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, axis=1)
    new = np.zeros(x.shape, np.int64)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    rank = np.empty_like(new)
    np.put_along_axis(rank, order, np.cumsum(new, axis=1), axis=1)
    kinds = rank.max(axis=1) + 1
    for i in np.flatnonzero(kinds == 2):
        out[i] = two_sample_ks(y[rank[i] == 1], y[rank[i] == 0])
    many = np.flatnonzero(kinds > 2)
    groups, group = np.unique(y, return_inverse=True)
    if not len(many) or len(groups) < 2:
        return out
    # In the order of y, and of x inside equal y: every pair of unlike x there counts as an ascent and is taken out.
    by_y = np.argsort(group, kind="stable")
    span = n + 1
    key = np.sort(group[by_y][None, :] * span + rank[many][:, by_y], axis=1)
    size = np.bincount(group).astype(float)
    same, first = _run_lengths(key)
    tied = (size * (size - 1) / 2).sum() - np.add.reduceat(same * (same - 1) / 2, first)
    s = _net_ascents(key % span) - tied
    count, first = _run_lengths(ordered[many])
    tx, x0, x1 = (np.add.reduceat(t, first) for t in (count * (count - 1) / 2, count * (count - 1) * (count - 2), count * (count - 1) * (2 * count + 5)))
    ty, y0, y1 = _tie_sums(y)
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m + x0 * y0 / (9 * m * (n - 2))
    out[many] = [math.erfc(z) for z in np.abs(s) / np.sqrt(var) / math.sqrt(2)]
    return out


def _column(function):
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = [function(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys)]
        return pd.Series([None if v != v else v for v in out], dtype="object").astype("float64")

    return run


@F.pandas_udf(DoubleType())
def association_p(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Features with the same target are taken together."""
    out = np.full(len(xs), np.nan)
    same: dict[bytes, list[int]] = {}
    for i, y in enumerate(ys):
        same.setdefault(np.asarray(y, float).tobytes(), []).append(i)
    for packed, at in same.items():
        for part in (at[k : k + ROWS] for k in range(0, len(at), ROWS)):
            out[part] = association_rows(np.stack([np.asarray(xs[i], float) for i in part]), np.frombuffer(packed))
    return pd.Series(out).astype("object").where(~np.isnan(out), None).astype("float64")


@F.pandas_udf(DoubleType())
def kendall_tau(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return _column(lambda x, y: kendall(x, y)[0])(xs, ys)


@F.pandas_udf(DoubleType())
def kendall_p(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return _column(lambda x, y: kendall(x, y)[1])(xs, ys)
