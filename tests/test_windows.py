import math

import numpy as np
import pandas as pd
import pytest
from macropanel.functions import spectral, windows
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
WINDOWS = [
    [1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 5.0, 5.0], [3.0, -1.0, 3.0, 0.0, 2.0, -1.0, 7.0], [0.0, 0.0, 0.0, 0.0, 0.0],
    *[RNG.normal(100, 5, n).tolist() for n in (4, 5, 6, 7, 12, 23, 60)],
]


@pytest.fixture(scope="module")
def computed(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WINDOWS)], "i int, xs array<double>")
    out, names = windows.with_features(df, prune_infeasible=False)
    return {r["i"]: dict(zip(names, r["fv"])) for r in out.collect()}


def close(got, want):
    if want is None or want != want:
        assert got is None
    else:
        assert got == pytest.approx(want, rel=1e-7, abs=1e-8)


def moments_of(x):
    s = pd.Series(x)
    return {"skewness": s.skew(), "kurtosis": s.kurt(), "variance": np.var(x), "median": np.median(x), "standard_deviation": np.std(x)}


def change_quantile(x, lo, hi, isabs, f):
    a, b = np.quantile(x, lo), np.quantile(x, hi)
    if a == b:
        return 0.0
    inside = (x >= a) & (x <= b)
    d = np.diff(x)[inside[1:] & inside[:-1]]
    d = np.abs(d) if isabs else d
    return float(f(d)) if len(d) else 0.0


def chunked_line(x, chunk, f):
    if len(x) <= chunk:
        return None
    y = np.array([f(x[i:i + chunk]) for i in range(0, len(x), chunk)])
    return np.polyfit(np.arange(len(y)), y, 1)[0]


def test_every_feature_has_a_value_or_a_reason(computed):
    assert len(computed[0]) == len(windows.FEATURES) + len(spectral.SPECTRAL)
    assert len(set(computed[0])) == len(computed[0])
    long = computed[len(WINDOWS) - 1]
    missing = {k for k, v in long.items() if v is None}
    allowed = ("fft_coefficient", "query_similarity_count", "agg_linear_trend")
    assert all(k.startswith(allowed) for k in missing)


def test_against_plain_formulas(computed):
    for i, w in enumerate(WINDOWS):
        x, got = np.array(w), computed[i]
        n, mean, sd = len(x), np.mean(x), np.std(x)
        for name, want in moments_of(x).items():
            close(got[name], want)
        close(got["abs_energy"], (x ** 2).sum())
        close(got["mean_n_absolute_max__number_of_maxima_7"], np.sort(np.abs(x))[-7:].mean() if n > 7 else None)
        close(got["longest_strike_above_mean"], max(len(r) for r in "".join("1" if v > mean else " " for v in x).split(" ")))
        for lo, hi in windows.CORRIDORS:
            for isabs in (False, True):
                for f, fun in (("mean", np.mean), ("var", np.var)):
                    close(got[f'change_quantiles__f_agg_"{f}"__isabs_{isabs}__qh_{hi}__ql_{lo}'], change_quantile(x, lo, hi, isabs, fun))
        for q in windows.QUANTILES:
            close(got[f"quantile__q_{q}"], np.quantile(x, q))
        for lag in range(10):
            want = None
            if n > lag and np.var(x) > 1e-8:
                want = ((x[:n - lag] - mean) * (x[lag:] - mean)).sum() / ((n - lag) * np.var(x))
            if not (lag == 0 and want is None):
                close(got[f"autocorrelation__lag_{lag}"], want)
        for chunk in (5, 10, 50):
            for f in ("max", "min", "mean", "var"):
                close(got[f'agg_linear_trend__attr_"slope"__chunk_len_{chunk}__f_agg_"{f}"'], chunked_line(x, chunk, getattr(np, f)))
        parts = np.array_split(x ** 2, 10)
        for k in range(10):
            total = (x ** 2).sum()
            close(got[f"energy_ratio_by_chunks__num_segments_10__segment_focus_{k}"], parts[k].sum() / total if total else None)
        for k in (1, 3, 5, 10, 50):
            peaks = sum(all(x[j] > x[j - s] and x[j] > x[j + s] for s in range(1, k + 1)) for j in range(k, n - k))
            close(got[f"number_peaks__n_{k}"], peaks)
        for r in (0.5, 1, 2.5, 10):
            close(got[f"ratio_beyond_r_sigma__r_{r}"], np.mean(np.abs(x - mean) > r * sd))


def test_linear_trend_p_value(computed):
    """Student's t tail by numerical integration."""
    for i, w in enumerate(WINDOWS):
        x, n = np.array(w), len(w)
        if np.var(x) == 0:
            close(computed[i]['linear_trend__attr_"pvalue"'], 1.0)
            continue
        r = np.corrcoef(np.arange(n), x)[0, 1]
        df = n - 2
        t = abs(r) * math.sqrt(df / max((1 - r) * (1 + r), 1e-20))
        grid = np.linspace(0, min(t, 1e3), 400_001)
        density = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2) * (1 + grid ** 2 / df) ** (-(df + 1) / 2)
        want = 1 - 2 * np.trapezoid(density, grid)
        assert computed[i]['linear_trend__attr_"pvalue"'] == pytest.approx(want, abs=2e-5)


def slow_dft(x):
    n = len(x)
    return [sum(x[t] * np.exp(-2j * np.pi * k * t / n) for t in range(n)) for k in range(n // 2 + 1)]


def test_transforms(computed):
    for i, w in enumerate(WINDOWS):
        x, got = np.array(w), computed[i]
        f = slow_dft(x)
        for k in range(100):
            want = f[k].real if k < len(f) else None
            close(got[f'fft_coefficient__attr_"real"__coeff_{k}'], want)
        size = np.abs(np.array(f))
        if size.sum() > 1e-6:
            close(got['fft_aggregated__aggtype_"centroid"'], (size * np.arange(len(f))).sum() / size.sum())
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
        g = np.abs(slow_dft((x - x.mean()) * hann)) ** 2 / (hann ** 2).sum()
        if len(g) > 2:
            last = len(x) % 2 == 0 and len(g) == 3
            close(got["spkt_welch_density__coeff_2"], g[2] * (1 if last else 2))


def test_cwt_is_a_centred_convolution(computed):
    x, w = np.array(WINDOWS[-2]), 2
    points = min(10 * w, len(x))
    t = np.arange(points) - (points - 1) / 2
    wavelet = 2 / (np.sqrt(3 * w) * np.pi ** 0.25) * (1 - (t / w) ** 2) * np.exp(-t ** 2 / (2 * w ** 2))
    full = np.convolve(x, wavelet)
    same = full[(points - 1) // 2:][:len(x)]
    for c in range(15):
        close(computed[len(WINDOWS) - 2][f"cwt_coefficients__coeff_{c}__w_2__widths_(2, 5, 10, 20)"], same[c])


def test_pacf_and_ar(computed):
    x, got = np.array(WINDOWS[-1]), computed[len(WINDOWS) - 1]
    n, dv = len(x), np.array(WINDOWS[-1]) - np.mean(WINDOWS[-1])
    cov = [(dv[:n - l] * dv[l:]).sum() / (n - l) for l in range(10)]
    for l in range(1, 10):  # last coefficient of the Yule-Walker equations of order l
        phi = np.linalg.solve([[cov[abs(i - j)] for j in range(l)] for i in range(l)], cov[1:l + 1])
        close(got[f"partial_autocorrelation__lag_{l}"], phi[-1])
    lags = np.column_stack([np.ones(n - 10)] + [x[10 - k:n - k] for k in range(1, 11)])
    want = np.linalg.pinv(lags) @ x[10:]
    for c in range(11):
        close(got[f"ar_coefficient__coeff_{c}__k_10"], want[c])
    assert all(computed[0][f"ar_coefficient__coeff_{c}__k_10"] is None for c in range(11))


def test_complexities(computed):
    assert spectral.distinct_phrases(np.array([[0, 0, 0, 0]]), 2) == [2]  # 0 | 00 | 0 is already known
    assert spectral.distinct_phrases(np.array([[1, 0, 0, 1, 1, 0]]), 2) == [4]  # 1 | 0 | 01 | 10
    close(computed[0]["permutation_entropy__dimension_3__tau_1"], 0.0)
    close(computed[2]["permutation_entropy__dimension_7__tau_1"], 0.0)
    assert computed[0]["permutation_entropy__dimension_5__tau_1"] is None
    orders = [tuple(np.argsort(WINDOWS[2][i:i + 3], kind="stable")) for i in range(5)]
    p = np.array([orders.count(o) for o in set(orders)]) / 5
    close(computed[2]["permutation_entropy__dimension_3__tau_1"], -(p * np.log(p)).sum())


def test_pruning_keeps_only_what_short_windows_can_tell(spark, computed):
    native, spec = windows.feature_specs(max_timeshift=6)
    kept = {f.name for f in [*native, *spec]}
    short = [i for i, w in enumerate(WINDOWS) if len(w) <= 7]
    for name in computed[0]:
        seen = {computed[i][name] for i in short}
        if name not in kept:
            assert len({0.0 if v is None else v for v in seen}) <= 2, name
    df = spark.createDataFrame([(0, WINDOWS[0])], "i int, xs array<double>")
    out, names = windows.with_features(df, ("moments",))
    long = windows.explode_features(out.withColumn("metric", F.lit("m")), names)
    assert {r["feature"]: r["value"] for r in long.collect()}["m__sum_values"] == 10.0
