"""Window features of supplier series: whole-number month values around zero, so that ties occur."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from macropanel.functions import windows
from macropanel.operators import columns
from macropanel.operators.longform import spread
from macropanel.operators.sequence import rolling_windows

from .base import q, q_sql, query, table

VALUE = "floor(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*)) - 25"


def supplier_months(spark, sf_dir):
    mean = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("supplier"), F.last_day("l_shipdate").alias("date"))
        .agg((F.floor(mean) - 25).cast("double").alias("value"))
        .withColumn("metric", F.lit("quantity"))
    )


def rolled(spark, sf_dir):
    months = spread(supplier_months(spark, sf_dir), "supplier")
    return rolling_windows(months, ["supplier"], table=False)


MONTHS = f"""months as (
  select l_suppkey as supplier, last_day(l_shipdate) as date, cast({VALUE} as double) as value
  from lineitem group by l_suppkey, last_day(l_shipdate))"""


def _at(q: float) -> str:
    pos = f"((n - 1) * {q!r}::double)"
    low, high = f"srt[cast(floor({pos}) as int) + 1]", f"srt[cast(ceil({pos}) as int) + 1]"
    return f"({low} + ({high} - {low}) * ({pos} - floor({pos})))"


BASE = f"""{MONTHS},
w as (select supplier, date, list(value) over (partition by supplier order by date rows between 6 preceding and current row) as xs from months),
b0 as (select *, len(xs) as n, list_sort(xs) as srt, list_distinct(xs) as uniq, list_sum(xs) as s1,
    list_sum(list_transform(xs, lambda x: abs(x))) as sa, list_sum(list_transform(xs, lambda x: x * x)) as ss,
    list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1]) as d from w where len(xs) >= 4),
b1 as (select *, s1 / n as mean, srt[1] as mn, srt[n] as mx, {_at(0.5)} as med,
    list_filter(uniq, lambda u: len(list_filter(xs, lambda x: x = u)) > 1) as dup from b0),
b2 as (select *, list_transform(xs, lambda x: x - mean) as dv from b1),
b as (select *, list_sum(list_transform(dv, lambda x: x * x)) / n as m2, list_sum(list_transform(dv, lambda x: x * x * x)) / n as m3,
    list_sum(list_transform(dv, lambda x: x * x * x * x)) / n as m4, sqrt(list_sum(list_transform(dv, lambda x: x * x)) / n) as sd from b2)"""


def _count(cond: str) -> str:
    return f"len(list_filter(xs, lambda x: {cond}))::double"


def _flag(cond: str) -> str:
    return f"({cond})::int::double"


def _slug(name: str) -> str:
    signed = re.sub(r"(?<=_)-(?=\d)", "neg_", name)
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9]+", "_", signed)).strip("_").lower()


def _moments():
    return {
        "sum_values": "s1", "mean": "mean", "median": "med", "length": "n::double", "minimum": "mn", "maximum": "mx",
        "absolute_maximum": "greatest(abs(mn), abs(mx))", "variance": "m2", "standard_deviation": "sd",
        "variation_coefficient": "sd / nullif(mean, 0)", "root_mean_square": "sqrt(ss / n)", "abs_energy": "ss",
        "mean_n_absolute_max__number_of_maxima_7": "case when n > 7 then list_avg(list_reverse_sort(list_transform(xs, lambda x: abs(x)))[1:7]) end",
    }


def _shape():
    return {
        "skewness": "case when m2 = 0 then 0 else sqrt(n * (n - 1)) / (n - 2) * m3 / pow(m2, 1.5) end",
        "kurtosis": "case when m2 = 0 then 0 else (n - 1) / ((n - 2) * (n - 3))::double * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) end",
    }


def _change():
    total = "list_sum(list_transform(d, lambda x: abs(x)))"
    energy = "sqrt(list_sum(list_transform(d, lambda x: x * x)))"
    out = {
        "mean_abs_change": f"{total} / (n - 1)", "mean_change": "(xs[n] - xs[1]) / (n - 1)",
        "absolute_sum_of_changes": total, "mean_second_derivative_central": "(xs[n] - xs[n - 1] - xs[2] + xs[1]) / (2 * (n - 2))",
        "cid_ce__normalize_False": energy, "cid_ce__normalize_True": f"case when sd = 0 then 0 else {energy} / sd end",
    }
    for lo, hi in windows.CORRIDORS:
        a, b = _at(lo), _at(hi)
        inside = (
            f"list_filter(range(1, n), lambda i: {a} <> {b} and xs[i] >= {a} and xs[i] <= {b} and xs[i + 1] >= {a} and xs[i + 1] <= {b})"
        )
        for isabs in (False, True):
            term = "abs(xs[i + 1] - xs[i])" if isabs else "xs[i + 1] - xs[i]"
            values = f"list_transform({inside}, lambda i: {term})"
            for f, agg in (("mean", "avg"), ("var", "var_pop")):
                out[f'change_quantiles__f_agg_"{f}"__isabs_{isabs}__qh_{hi}__ql_{lo}'] = f"coalesce(list_aggregate({values}, '{agg}'), 0)"
    return out


def _flags():
    out = {
        "variance_larger_than_standard_deviation": _flag("m2 > sd"), "has_duplicate": _flag("len(uniq) < n"),
        "has_duplicate_max": _flag("len(list_filter(xs, lambda x: x = mx)) >= 2"),
        "has_duplicate_min": _flag("len(list_filter(xs, lambda x: x = mn)) >= 2"),
    }
    for k in range(1, 20):
        out[f"large_standard_deviation__r_{k * 0.05!r}"] = _flag(f"sd > {k * 0.05!r}::double * (mx - mn)")
    for k in range(20):
        out[f"symmetry_looking__r_{k * 0.05!r}"] = _flag(f"abs(mean - med) < {k * 0.05!r}::double * (mx - mn)")
    return out


def _counts():
    out = {
        "count_above_mean": _count("x > mean"), "count_below_mean": _count("x < mean"),
        "count_above__t_0": _count("x >= 0") + " / n", "count_below__t_0": _count("x <= 0") + " / n",
        **{f"value_count__value_{v}": _count(f"x = {v}") for v in (0, 1, -1)},
        "range_count__max_1__min_-1": _count("x >= -1 and x < 1"), "range_count__max_0__min_-1000000000000.0": _count("x < 0"),
        "range_count__max_1000000000000.0__min_0": _count("x >= 0"),
    }
    for m in (0, -1, 1):
        out[f"number_crossing_m__m_{m}"] = f"len(list_filter(range(2, n + 1), lambda i: (xs[i] > {m}) <> (xs[i - 1] > {m})))::double"
    for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10):
        out[f"ratio_beyond_r_sigma__r_{r}"] = _count(f"abs(x - mean) > {float(r)!r}::double * sd") + " / n"
    peak = lambda k: " and ".join(f"xs[i] > xs[i - {j}] and xs[i] > xs[i + {j}]" for j in range(1, k + 1))
    for k in (1, 3, 5, 10, 50):
        out[f"number_peaks__n_{k}"] = f"len(list_filter(range({k + 1}, n - {k} + 1), lambda i: {peak(k)}))::double"
    return out


def _positions():
    out = {}
    for what, v in (("maximum", "mx"), ("minimum", "mn")):
        out[f"first_location_of_{what}"] = f"(list_position(xs, {v}) - 1) / n::double"
        out[f"last_location_of_{what}"] = f"1 - (list_position(list_reverse(xs), {v}) - 1) / n::double"
    # a run is a pair of ends with nothing but hits between them
    for side, op in (("above", ">"), ("below", "<")):
        runs = (
            f"list_transform(range(1, n + 1), lambda i: coalesce(list_max(list_filter(range(i, n + 1), "
            f"lambda j: list_bool_and(list_transform(xs[i:j], lambda x: x {op} mean)))) - i + 1, 0))"
        )
        out[f"longest_strike_{side}_mean"] = f"list_max({runs})::double"
    for p in windows.QUANTILES:
        first = f"list_min(list_filter(range(1, n + 1), lambda i: list_sum(list_transform(xs[1:i], lambda x: abs(x))) >= {p}::double * sa))"
        out[f"index_mass_quantile__q_{p}"] = f"case when sa = 0 then null else {first} / n::double end"
    return out


def _recurrence():
    again = "len(list_filter(xs, lambda x: list_contains(dup, x)))"
    return {
        "percentage_of_reoccurring_values_to_all_values": "len(dup) / len(uniq)::double",
        "percentage_of_reoccurring_datapoints_to_all_datapoints": f"{again} / n::double",
        "sum_of_reoccurring_values": "coalesce(list_sum(dup), 0)",
        "sum_of_reoccurring_data_points": "coalesce(list_sum(list_filter(xs, lambda x: list_contains(dup, x))), 0)",
        "ratio_value_number_to_time_series_length": "len(uniq) / n::double",
    }


def _quantile():
    return {f"quantile__q_{p}": _at(p) for p in windows.QUANTILES}


def _lags():
    acf = lambda l: f"list_sum(list_transform(range(1, n - {l} + 1), lambda i: dv[i] * dv[i + {l}])) / ((n - {l}) * m2)"
    every = "list_transform(range(1, n), lambda l: list_sum(list_transform(range(1, n - l + 1), lambda i: dv[i] * dv[i + l])) / ((n - l) * m2))"
    out = {f"autocorrelation__lag_{l}": f"case when n <= {l} or m2 = 0 then null else {acf(l)} end" for l in range(1, 10)}
    out["autocorrelation__lag_0"] = "case when m2 = 0 then null else 1::double end"
    for f, agg in (("mean", "avg"), ("median", "median"), ("var", "var_pop")):
        out[f'agg_autocorrelation__f_agg_"{f}"__maxlag_40'] = f"case when m2 = 0 then 0 else list_aggregate({every}, '{agg}') end"
    for l in (1, 2, 3):
        a, b, c = f"xs[i + 2 * {l}]", f"xs[i + {l}]", "xs[i]"
        for name, term in (("c3", f"{a} * {b} * {c}"), ("time_reversal_asymmetry_statistic", f"{a} * {a} * {b} - {b} * {c} * {c}")):
            out[f"{name}__lag_{l}"] = (
                f"case when 2 * {l} >= n then 0 else list_sum(list_transform(range(1, n - 2 * {l} + 1), lambda i: {term})) / (n - 2 * {l}) end"
            )
    return out


def _line(points: str, attr: str) -> str:
    """Least squares through a list, by the engine's own regression aggregates."""
    fun = {"slope": "regr_slope(y, t)", "intercept": "regr_intercept(y, t)",
           "rvalue": "case when var_pop(y) = 0 then 0 else corr(y, t) end",
           "stderr": "case when count(*) = 2 then 0 else sqrt(greatest(regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t), 0) / (count(*) - 2) / regr_sxx(y, t)) end"}[attr]
    return f"(select {fun} from (select unnest({points}) as y, unnest(range(0, len({points})))::double as t))"


def _trend():
    out = {f'linear_trend__attr_"{a}"': _line("xs", a) for a in ("slope", "intercept", "rvalue", "stderr")}
    for f, agg in (("max", "max"), ("min", "min"), ("mean", "avg"), ("var", "var_pop")):
        for c in (5, 10, 50):
            parts = f"list_transform(range(0, cast(ceil(n / {c}.0) as bigint)), lambda k: list_aggregate(xs[k * {c} + 1:least((k + 1) * {c}, n)], '{agg}')::double)"
            for a in ("slope", "intercept", "rvalue", "stderr"):
                out[f'agg_linear_trend__attr_"{a}"__chunk_len_{c}__f_agg_"{f}"'] = f"case when n > {c} then {_line(parts, a)} end"
    return out


def _other():
    out = {f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}": f"coalesce(xs[{i + 1}] * xs[{i + 1}], 0) / nullif(ss, 0)" for i in range(10)}
    out["query_similarity_count__query_None__threshold_0.0"] = "null::double"
    bins = "list_transform(xs, lambda x: case when mx = mn then 5 else least(9, cast(floor((x - mn) / (mx - mn) * 10) as int)) end)"
    share = f"list_transform(range(0, 10), lambda k: len(list_filter({bins}, lambda y: y = k)) / n::double)"
    out["binned_entropy__max_bins_10"] = f"-list_sum(list_transform({share}, lambda p: case when p = 0 then 0 else p * ln(p) end))"
    digit = "list_transform(xs, lambda x: try_cast(regexp_extract(cast(abs(x) as varchar), '[1-9]') as int))"
    shares = f"list_transform(range(1, 10), lambda k: coalesce(len(list_filter({digit}, lambda y: y = k)), 0) / n::double)"
    out["benford_correlation"] = (
        f"(select case when var_pop(s) = 0 then null else corr(s, l) end from (select unnest({shares}) as s, "
        "unnest(list_transform(range(1, 10), lambda k: log10(1 + 1 / k::double))) as l))"
    )
    return out


_SQL = {
    "moments": _moments, "shape": _shape, "change": _change, "flags": _flags, "counts": _counts, "positions": _positions,
    "recurrence": _recurrence, "quantile": _quantile, "lags": _lags, "trend": _trend, "other": _other,
}


def _register(group: str) -> None:
    cells = _SQL[group]()
    listed = ", ".join(f"{q_sql(sql)} as {_slug(name)}" for name, sql in cells.items())

    @query(f"feat_{group}", f"with {BASE} select supplier, date, {listed} from b")
    def run(spark, sf_dir):
        vectors, names = windows.with_features(rolled(spark, sf_dir), (group,))
        return vectors.select("supplier", "date", *[q(F.get("fv", F.lit(i))).alias(_slug(n)) for i, n in enumerate(names)])


for _group in _SQL:
    _register(_group)


@query("feat_spectral")
def feat_spectral(spark, sf_dir):
    """Transforms, spectra and complexities of the whole grid, which SQL cannot say; checked against numpy in the tests.

    A row for each feature that the window has: coefficients beyond its length have no value."""
    vectors, names = windows.with_features(rolled(spark, sf_dir), ("spectral",))
    found = windows.explode_features(vectors, names).where("value is not null")
    return found.select("supplier", "date", "feature", q(F.col("value")).alias("value"))


_SLOTTED = """slotted as (select supplier, date, case when value > 5 then 'inf'::double when value < -5 then '-inf'::double
  when value in (2, -2) then null else value end as value from months)"""


@query("impute_features", f"""
with {MONTHS}, {_SLOTTED},
stats as (select supplier, coalesce(max(value) filter (isfinite(value)), 0) as hi, coalesce(min(value) filter (isfinite(value)), 0) as lo,
  coalesce(median(value) filter (isfinite(value)), 0) as mid from slotted group by supplier)
select supplier, date, case when value is null then mid when value = 'inf'::double then hi when value = '-inf'::double then lo else value end as value
from slotted join stats using (supplier)""")
def impute_features(spark, sf_dir):
    v = F.col("value")
    damaged = supplier_months(spark, sf_dir).withColumn(
        "value",
        F.when(v > 5, F.lit(float("inf"))).when(v < -5, F.lit(float("-inf"))).when(~v.isin(2, -2), v),
    )
    packed = columns.pack(damaged, ["supplier"], y=False)
    return columns.unpack(columns.impute(packed), ["supplier"]).select("supplier", "date", "value")
