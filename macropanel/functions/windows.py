"""Features of one rolling window, as SQL expressions over `xs array<double>`.

Everything is row-wise: the helper columns of a stage are computed once per row and used by
the features of the next one, and no feature needs a shuffle.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .spectral import SPECTRAL, TREND_ATTRS, TREND_CHUNKS, TREND_STATS, by_length, chunk_trends, spectral_values

GROUPS = (
    "moments", "shape", "change", "flags", "counts", "positions",
    "recurrence", "quantile", "lags", "trend", "other", "spectral",
)

QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
FIFTHS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
CORRIDORS = tuple((lo, hi) for lo in FIFTHS for hi in FIFTHS if lo < hi)
NEVER = 10 ** 9


@dataclass(frozen=True)
class Feature:
    """A feature: its name, its expression and the shortest window that can tell it apart
    from a constant."""

    name: str
    sql: str
    group: str
    min_n: int = 1


def _sum(arr: str, term: str = "x", var: str = "x") -> str:
    return f"aggregate({arr}, 0D, (acc, {var}) -> acc + {term})"


def _mean(arr: str) -> str:
    return f"{_sum(arr)} / nullif(size({arr}), 0)"


def _quantiles(arr: str, qs) -> str:
    """Quantiles of a sorted array, with linear interpolation between its values."""
    at = f"(size({arr}) - 1) * q"
    low, high = f"get({arr}, cast(floor({at}) as int))", f"get({arr}, cast(ceil({at}) as int))"
    listed = ", ".join(f"{q!r}D" for q in qs)
    return f"transform(array({listed}), q -> {low} + ({high} - {low}) * ({at} - floor({at})))"


def _flag(cond: str) -> str:
    return f"cast(cast({cond} as int) as double)"


def _count(arr: str, cond: str) -> str:
    return f"cast(size(filter({arr}, x -> {cond})) as double)"


def _longest_run(cond: str) -> str:
    run = (
        "aggregate(xs, named_struct('run', 0, 'best', 0), (a, x) -> named_struct("
        f"'run', if({cond}, a.run + 1, 0), 'best', greatest(a.best, if({cond}, a.run + 1, 0))), a -> a.best)"
    )
    return f"cast({run} as double)"


def _trend_sums(ys: str) -> str:
    """Sums for a line through `ys` over 0, 1, 2, ...; shifted by the first value, so that a
    large level costs no digits."""
    k, y = f"size({ys})", f"({ys}[t] - {ys}[0])"
    sums = (
        f"aggregate(sequence(0, {k} - 1), named_struct('y', 0D, 'yy', 0D, 'ty', 0D), "
        f"(a, t) -> named_struct('y', a.y + {y}, 'yy', a.yy + {y} * {y}, 'ty', a.ty + t * {y}), a -> "
        f"named_struct('k', cast({k} as double), 'y0', {ys}[0], 'my', a.y / {k}, "
        f"'tt', ({k} * {k} - 1) / 12D, 'ty', a.ty / {k} - ({k} - 1) / 2D * a.y / {k}, "
        f"'raw', a.yy / {k}, 'yy', a.yy / {k} - a.y / {k} * a.y / {k}))"
    )
    return f"if({k} < 2, null, {sums})"


def _trend(sums: str, attr: str) -> str:
    """Attributes of the least squares line from its sums."""
    s = sums
    r = f"if({s}.yy <= 1e-14D * {s}.raw, 0D, greatest(-1D, least(1D, {s}.ty / sqrt({s}.tt * {s}.yy))))"
    return {
        "slope": f"{s}.ty / {s}.tt",
        "intercept": f"{s}.y0 + {s}.my - {s}.ty / {s}.tt * ({s}.k - 1) / 2",
        "rvalue": r,
        "stderr": f"if({s}.k = 2, 0D, sqrt((1 - pow({r}, 2)) * greatest({s}.yy, 0D) / {s}.tt / ({s}.k - 2)))",
    }[attr]


def _define() -> list[Feature]:
    out: list[Feature] = []

    def add(group, name, sql, min_n=1):
        out.append(Feature(name, sql, group, min_n))

    # moments
    add("moments", "sum_values", "s1")
    add("moments", "mean", "mean")
    add("moments", "median", "med")
    add("moments", "length", "cast(n as double)")
    add("moments", "minimum", "mn")
    add("moments", "maximum", "mx")
    add("moments", "absolute_maximum", "greatest(abs(mn), abs(mx))")
    add("moments", "variance", "m2")
    add("moments", "standard_deviation", "sd")
    add("moments", "variation_coefficient", "sd / nullif(mean, 0D)")
    add("moments", "root_mean_square", "sqrt(ss / n)")
    add("moments", "abs_energy", "ss")
    add("moments", "mean_n_absolute_max__number_of_maxima_7",
        "if(n > 7, " + _sum("slice(reverse(array_sort(transform(xs, x -> abs(x)))), 1, 7)") + " / 7, null)", 8)

    # shape: bias-corrected third and fourth moments
    add("shape", "skewness",
        "if(n < 3, null, if(ss_dv < 1e-14D, 0D, sqrt(cast(n * (n - 1) as double)) / (n - 2) * m3 / pow(m2, 1.5D)))", 3)
    add("shape", "kurtosis",
        "if(n < 4, null, if(ss_dv < 1e-14D, 0D, (n - 1) / cast((n - 2) * (n - 3) as double) * "
        "((n + 1) * (m4 / (m2 * m2) - 3) + 6)))", 4)

    # change
    abs_d = _sum("d", "abs(x)")
    add("change", "mean_abs_change", f"{abs_d} / nullif(n - 1, 0)", 2)
    add("change", "mean_change", "(xs[n - 1] - xs[0]) / nullif(n - 1, 0)", 2)
    add("change", "absolute_sum_of_changes", abs_d, 2)
    add("change", "mean_second_derivative_central",
        "if(n < 3, null, (xs[n - 1] - xs[n - 2] - xs[1] + xs[0]) / (2 * (n - 2)))", 3)
    energy = f"sqrt({_sum('d', 'x * x')})"
    add("change", "cid_ce__normalize_False", energy, 2)
    add("change", "cid_ce__normalize_True", f"if(sd = 0, 0D, {energy} / sd)", 2)
    for lo, hi in CORRIDORS:
        c = _corridor_name(lo, hi)
        for isabs, total in ((False, f"{c}.s"), (True, f"{c}.a")):
            name = f"__isabs_{isabs}__qh_{hi}__ql_{lo}"
            mean = f"{total} / nullif({c}.n, 0)"
            add("change", f'change_quantiles__f_agg_"mean"{name}', f"coalesce({mean}, 0D)", 2)
            add("change", f'change_quantiles__f_agg_"var"{name}',
                f"coalesce(greatest({c}.q / nullif({c}.n, 0) - pow({mean}, 2), 0D), 0D)", 2)

    # flags
    add("flags", "variance_larger_than_standard_deviation", _flag("m2 > sd"))
    add("flags", "has_duplicate", _flag("size(array_distinct(xs)) < n"))
    add("flags", "has_duplicate_max", _flag("size(filter(xs, x -> x = mx)) >= 2"))
    add("flags", "has_duplicate_min", _flag("size(filter(xs, x -> x = mn)) >= 2"))
    for k in range(1, 20):
        add("flags", f"large_standard_deviation__r_{k * 0.05!r}", _flag(f"sd > {k * 0.05!r}D * (mx - mn)"))
    for k in range(20):
        add("flags", f"symmetry_looking__r_{k * 0.05!r}", _flag(f"abs(mean - med) < {k * 0.05!r}D * (mx - mn)"))

    # counts
    add("counts", "count_above_mean", _count("xs", "x > mean"))
    add("counts", "count_below_mean", _count("xs", "x < mean"))
    add("counts", "count_above__t_0", _count("xs", "x >= 0") + " / n")
    add("counts", "count_below__t_0", _count("xs", "x <= 0") + " / n")
    for v in (0, 1, -1):
        add("counts", f"value_count__value_{v}", _count("xs", f"x = {v}"))
    for hi, lo, hi_name, lo_name in ((1, -1, "1", "-1"), (0, -1e12, "0", "-1000000000000.0"), (1e12, 0, "1000000000000.0", "0")):
        add("counts", f"range_count__max_{hi_name}__min_{lo_name}", _count("xs", f"x >= {float(lo)!r}D and x < {float(hi)!r}D"))
    for m in (0, -1, 1):
        changes = f"size(filter(sequence(1, n - 1), i -> (xs[i] > {m}) != (xs[i - 1] > {m})))"
        add("counts", f"number_crossing_m__m_{m}", f"if(n < 2, 0D, cast({changes} as double))", 2)
    for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10):
        # a value is never more than sqrt(n - 1) deviations away
        need = int(r * r) + 2 if r >= 1 else 1
        add("counts", f"ratio_beyond_r_sigma__r_{r}", _count("xs", f"abs(x - mean) > {float(r)!r}D * sd") + " / n", need)
    for k in (1, 3, 5, 10, 50):
        peak = f"forall(sequence(1, {k}), j -> xs[i] > xs[i - j] and xs[i] > xs[i + j])"
        add("counts", f"number_peaks__n_{k}",
            f"if(n < {2 * k + 1}, 0D, cast(size(filter(sequence({k}, n - 1 - {k}), i -> {peak})) as double))", 2 * k + 1)

    # positions
    for what in ("maximum", "minimum"):
        v = "mx" if what == "maximum" else "mn"
        add("positions", f"first_location_of_{what}", f"(array_position(xs, {v}) - 1) / cast(n as double)")
        add("positions", f"last_location_of_{what}", f"1D - (array_position(reverse(xs), {v}) - 1) / cast(n as double)")
    add("positions", "longest_strike_above_mean", _longest_run("x > mean"))
    add("positions", "longest_strike_below_mean", _longest_run("x < mean"))
    for i, q in enumerate(QUANTILES):
        add("positions", f"index_mass_quantile__q_{q}", f"if(sa = 0, null, mass[{i}] / cast(n as double))")

    # recurrence: `dup` holds the distinct values that occur more than once
    add("recurrence", "percentage_of_reoccurring_values_to_all_values", "size(dup) / cast(size(uniq) as double)")
    again = _count("xs", "array_contains(dup, x)")
    add("recurrence", "percentage_of_reoccurring_datapoints_to_all_datapoints", f"{again} / n")
    add("recurrence", "sum_of_reoccurring_values", _sum("dup"))
    add("recurrence", "sum_of_reoccurring_data_points", _sum("filter(xs, v -> array_contains(dup, v))"))
    add("recurrence", "ratio_value_number_to_time_series_length", "size(uniq) / cast(n as double)")

    # quantile
    for i, q in enumerate(QUANTILES):
        add("quantile", f"quantile__q_{q}", f"deciles[{i}]")

    # lags
    for lag in range(10):
        value = f"get(acf, {lag - 1})" if lag else "1D"
        add("lags", f"autocorrelation__lag_{lag}", f"if(m2 <= 1e-8D, null, {value})", lag + 1 if lag else NEVER)
    add("lags", 'agg_autocorrelation__f_agg_"mean"__maxlag_40', f"if(m2 < 1e-10D or n = 1, 0D, {_mean('acf')})", 2)
    add("lags", 'agg_autocorrelation__f_agg_"median"__maxlag_40',
        f"if(m2 < 1e-10D or n = 1, 0D, {_quantiles('array_sort(acf)', (0.5,))}[0])", 2)
    acf_mean = _mean("acf")
    add("lags", 'agg_autocorrelation__f_agg_"var"__maxlag_40',
        f"if(m2 < 1e-10D or n = 1, 0D, greatest({_sum('acf', 'x * x')} / nullif(size(acf), 0) - pow({acf_mean}, 2), 0D))", 3)
    for lag in (1, 2, 3):
        span = f"sequence(0, n - 1 - 2 * {lag})"
        a, b, c = f"xs[i + 2 * {lag}]", f"xs[i + {lag}]", "xs[i]"
        for name, term in (("c3", f"{a} * {b} * {c}"),
                           ("time_reversal_asymmetry_statistic", f"({a} * {a} * {b} - {b} * {c} * {c})")):
            add("lags", f"{name}__lag_{lag}",
                f"if(2 * {lag} >= n, 0D, aggregate({span}, 0D, (acc, i) -> acc + {term}) / (n - 2 * {lag}))", 2 * lag + 1)

    # trend
    for attr in ("slope", "intercept", "rvalue", "stderr"):
        add("trend", f'linear_trend__attr_"{attr}"', _trend("t_xs", attr), 2)
    # Lines through chunks come as one array of a window, see `chunk_trends`.
    for i, (chunk, f, attr) in enumerate(itertools.product(TREND_CHUNKS, TREND_STATS, TREND_ATTRS)):
        add("trend", f'agg_linear_trend__attr_"{attr}"__chunk_len_{chunk}__f_agg_"{f}"', f"chunk_lines[{i}]",
            2 * chunk + 1 if attr == "stderr" else chunk + 1)

    # other
    for i in range(10):
        add("other", f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}", f"energy[{i}] / nullif(ss, 0D)", i + 1)
    add("other", "binned_entropy__max_bins_10",
        "-aggregate(transform(sequence(0, 9), b -> size(filter(tenth, y -> y = b)) / cast(n as double)), 0D, "
        "(acc, p) -> acc + if(p = 0, 0D, p * ln(p)))")
    share = "transform(sequence(1, 9), k -> size(filter(lead_digit, y -> y = k)) / cast(n as double))"
    law = "transform(sequence(1, 9), k -> log10(1 + 1 / cast(k as double)))"
    add("other", "benford_correlation",
        f"aggregate(zip_with({share}, {law}, (s, l) -> named_struct('s', s, 'l', l)), named_struct('s', 0D, 'l', 0D, 'ss', 0D, 'll', 0D, 'sl', 0D), "
        "(a, p) -> named_struct('s', a.s + p.s, 'l', a.l + p.l, 'ss', a.ss + p.s * p.s, 'll', a.ll + p.l * p.l, "
        "'sl', a.sl + p.s * p.l), a -> (9 * a.sl - a.s * a.l) / "
        "nullif(sqrt(9 * a.ss - a.s * a.s) * sqrt(9 * a.ll - a.l * a.l), 0D))")
    # no query is given, so there is nothing to count
    add("other", "query_similarity_count__query_None__threshold_0.0", "cast(null as double)", NEVER)
    return out



def _corridor_name(lo: float, hi: float) -> str:
    return f"c{int(lo * 10)}_{int(hi * 10)}"


def _corridors() -> dict[str, str]:
    """Sums over the differences whose two ends lie between two quantiles; none if those are equal."""
    out = {}
    for lo, hi in CORRIDORS:
        a, b = f"fifths[{FIFTHS.index(lo)}]", f"fifths[{FIFTHS.index(hi)}]"
        ends = f"least(xs[i], xs[i + 1]) >= {a} and greatest(xs[i], xs[i + 1]) <= {b}"
        out[_corridor_name(lo, hi)] = (
            f"aggregate(if({a} = {b}, array(), sequence(0, n - 2)), "
            "named_struct('n', 0, 's', 0D, 'a', 0D, 'q', 0D), "
            f"(acc, i) -> if({ends}, named_struct('n', acc.n + 1, 's', acc.s + d[i], "
            "'a', acc.a + abs(d[i]), 'q', acc.q + d[i] * d[i]), acc))"
        )
    return out


# Helper columns, stage by stage: each may use those of the stages before.
STAGES: tuple[dict[str, str], ...] = (
    {
        "n": "size(xs)",
        "s1": _sum("xs"),
        "sa": _sum("xs", "abs(x)"),
        "ss": _sum("xs", "x * x"),
        "srt": "array_sort(xs)",
        "uniq": "array_distinct(xs)",
        "d": "if(size(xs) < 2, array(), zip_with(slice(xs, 2, size(xs) - 1), slice(xs, 1, size(xs) - 1), (b, a) -> b - a))",
        "lead_digit": "transform(xs, x -> cast(nullif(regexp_extract(cast(abs(x) as string), '([1-9])', 1), '') as int))",
    },
    {
        "mean": "s1 / n",
        "mn": "srt[0]",
        "mx": "srt[n - 1]",
        "med": _quantiles("srt", (0.5,)) + "[0]",
        "fifths": _quantiles("srt", FIFTHS),
        "deciles": _quantiles("srt", QUANTILES),
        "mass": "transform(array(" + ", ".join(f"{q}D" for q in QUANTILES) + "), q -> aggregate(xs, "
                "named_struct('i', 0, 'sum', 0D, 'at', 0), (a, x) -> named_struct('i', a.i + 1, 'sum', a.sum + abs(x), "
                "'at', if(a.at = 0 and a.sum + abs(x) >= q * sa, a.i + 1, a.at)), a -> a.at))",
        "energy": "transform(sequence(0, 9), i -> aggregate(slice(xs, cast(i * (n div 10) + least(i, n % 10) as int) + 1, "
                  "cast(n div 10 as int) + if(i < n % 10, 1, 0)), 0D, (acc, x) -> acc + x * x))",
        "t_xs": _trend_sums("xs"),
        "dup": "filter(uniq, u -> size(filter(xs, x -> x = u)) > 1)",
    },
    {"dv": "transform(xs, x -> x - mean)",
     "tenth": "transform(xs, x -> if(mx = mn, 5, least(9, cast(floor((x - mn) / (mx - mn) * 10) as int))))",
     **_corridors()},
    {"ss_dv": _sum("dv", "x * x"), "s3": _sum("dv", "x * x * x"), "s4": _sum("dv", "x * x * x * x")},
    {"m2": "ss_dv / n", "m3": "s3 / n", "m4": "s4 / n"},
    {"sd": "sqrt(m2)",
     "acf": "if(n < 2 or m2 = 0, array(), transform(sequence(1, least(40, n - 1)), l -> "
            "aggregate(sequence(0, n - 1 - l), 0D, (acc, i) -> acc + dv[i] * dv[i + l]) / ((n - l) * m2)))"},
)

FEATURES: tuple[Feature, ...] = tuple(_define())


def feature_specs(
    groups=GROUPS, *, max_timeshift: int = 6, prune_infeasible: bool = False
) -> tuple[list[Feature], list]:
    """The native features and the spectral ones that a run computes.

    With `prune_infeasible` those that no window of at most `max_timeshift + 1` rows can tell
    apart from a constant are left out; imputation would turn them into a constant column,
    and selection would drop that.
    """
    longest = max_timeshift + 1
    fits = lambda f: not prune_infeasible or f.min_n <= longest
    native = [f for f in FEATURES if f.group in groups and fits(f)]
    spectral = [f for f in SPECTRAL if fits(f)] if "spectral" in groups else []
    return native, spectral


def with_features(
    rolled: DataFrame,
    groups=GROUPS,
    *,
    max_timeshift: int = 6,
    prune_infeasible: bool = False,
    xs: str = "xs",
) -> tuple[DataFrame, list[str]]:
    """Add `fv array<double>` with the features of each window; their names are returned in order."""
    native, spectral = feature_specs(groups, max_timeshift=max_timeshift, prune_infeasible=prune_infeasible)
    kept = [c for c in rolled.columns if c != xs]
    out = rolled.select(F.struct(*kept).alias("__row"), F.col(xs).alias("xs"))
    used = _needed(native)
    if any("chunk_lines" in f.sql for f in native):
        width = len(TREND_CHUNKS) * len(TREND_STATS) * len(TREND_ATTRS)
        out = out.withColumn("chunk_lines", by_length(chunk_trends, width)(F.col("xs")))
    for stage in STAGES:
        wanted = {name: sql for name, sql in stage.items() if name in used}
        if wanted:
            out = out.select("*", *[F.expr(sql).alias(name) for name, sql in wanted.items()])
    parts = []
    if native:
        parts.append(F.expr("array(" + ", ".join(f"cast({f.sql} as double)" for f in native) + ")"))
    if spectral:
        parts.append(spectral_values([f.name for f in spectral])(F.col("xs")))
    vector = F.concat(*parts) if len(parts) > 1 else parts[0]
    return out.select("__row.*", vector.alias("fv")), [f.name for f in [*native, *spectral]]


def _needed(native: list[Feature]) -> set[str]:
    """Helper columns the features refer to, directly or through other helpers."""
    words = lambda sql: set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    stages = {name: sql for stage in STAGES for name, sql in stage.items()}
    open_, used = set().union(*[words(f.sql) for f in native]) if native else set(), set()
    while open_:
        name = open_.pop()
        if name in stages and name not in used:
            used.add(name)
            open_ |= words(stages[name])
    return used


def explode_features(vectors: DataFrame, names: list[str], *, metric: str = "metric") -> DataFrame:
    """One row per feature: `{metric}__{feature}` and its value."""
    kept = [c for c in vectors.columns if c not in ("fv", metric)]
    labels = F.array(*[F.lit(n) for n in names])
    return (
        vectors.select(*kept, metric, F.posexplode("fv").alias("__i", "value"))
        .select(
            *kept, metric, F.concat(F.col(metric), F.lit("__"), F.get(labels, F.col("__i"))).alias("feature"), "value"
        )
    )
