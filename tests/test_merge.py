from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from helpers import day, series
from macropanel.config import PanelConfig
from macropanel.operators.longform import to_long, to_wide, union_long
from macropanel.operators.merge import merge_panel
from macropanel.plans.panel import merge_only, monthly_panel
from macropanel.plans.training import train_simple, train_variance, wide_training
from pyspark.sql import functions as F


def random_table(seed, freq, days, n, columns):
    rng = np.random.default_rng(seed)
    dates = pd.to_datetime("2021-01-01") + pd.to_timedelta(np.sort(rng.choice(days, n, replace=False)), unit="D")
    frame = pd.DataFrame({c: rng.normal(size=n) for c in columns}, index=dates)
    return frame.mask(rng.random(frame.shape) < 0.1), freq


def by_pandas(tables):
    """Resample, suffix, outer join, ffill, bfill."""
    parts = []
    for frame, freq in tables:
        monthly = frame.resample("ME").mean()
        if freq == "daily" and not frame.index.max().is_month_end:
            monthly = monthly.iloc[:-1]
        if freq == "quarterly":
            monthly = monthly.interpolate(method="linear")
        suffix = {"daily": "_日度", "monthly": "_月度", "quarterly": "_季度"}.get(freq, "")
        parts.append(monthly.add_suffix(suffix))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.join(p, how="outer")
    return merged.ffill().bfill() if len(parts) > 1 else merged


TABLES = [
    random_table(1, "daily", 700, 200, ["a", "b"]),
    random_table(2, "monthly", 900, 30, ["c"]),
    random_table(3, "quarterly", 1100, 11, ["d", "e"]),
    random_table(4, "unknown", 400, 40, ["f"]),
]


def longs(spark, tables=TABLES):
    return [
        to_long(spark.createDataFrame(frame.rename_axis("day").reset_index()), "day", table=f"t{i}", freq=freq)
        for i, (frame, freq) in enumerate(tables)
    ]


def frame_of(df):
    pdf = df.toPandas().set_index("date")
    pdf.index = pd.to_datetime(pdf.index)
    return pdf.sort_index()


@pytest.mark.parametrize("count", [1, 2, 4])
def test_matches_pandas(spark, count):
    got = frame_of(merge_only(longs(spark)[:count], PanelConfig(missing_threshold=60.0)))
    want = by_pandas(TABLES[:count])
    assert list(got.columns) == list(want.columns)
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_fill_single_and_errors(spark):
    cfg = PanelConfig(missing_threshold=60.0)
    filled = frame_of(merge_only(longs(spark)[1:2], replace(cfg, fill_single=True)))
    want = by_pandas(TABLES[1:2]).ffill().bfill()
    np.testing.assert_allclose(filled.to_numpy(float), want.to_numpy(float))
    with pytest.raises(ValueError):
        union_long([])


def test_equal_names_in_two_tables_fail(spark):
    two = union_long([series(spark, [("2024-01-31", 1.0)]), series(spark, [("2024-01-31", 2.0)], table="u")])
    with pytest.raises(Exception, match="column in more than one table"):
        merge_panel(two).collect()


def test_empty_column_survives_the_merge(spark):
    tables = [series(spark, [("2024-01-31", 1.0), ("2024-02-29", 2.0)]), series(spark, [("2024-01-15", 5.0)], table="u", metric="n", freq="daily")]
    wide = merge_only(tables, PanelConfig())
    rows = wide.orderBy("date").collect()
    assert wide.columns == ["date", "m_月度", "n_日度"]
    assert [tuple(r)[1:] for r in rows] == [(1.0, None), (2.0, None)]


def test_entities_equal_each_alone(spark):
    parts = {}
    for key, shift in (("a", 0), ("b", 100)):
        tables = [(f + shift, q) for f, q in TABLES[: 3 if key == "a" else 2]]
        parts[key] = [t.withColumn("k", F.lit(key)) for t in longs(spark, tables)]
    cfg = PanelConfig(keys=("k",), missing_threshold=60.0)
    joint = monthly_panel(parts["a"] + [p.withColumn("table_pos", F.lit(i)) for i, p in enumerate(parts["b"])], cfg)
    for key in parts:
        alone = monthly_panel(parts[key], cfg)
        rows = lambda df: sorted(tuple(r) for r in df.filter(F.col("k") == key).select("metric", "date", "value").collect())
        assert rows(joint) == rows(alone)


def lagged_by_pandas(frame):
    return frame.shift(1).bfill().fillna(0)


@pytest.mark.parametrize("ratio", [0.9, 0.1])
def test_variance_training_matches_pandas(spark, ratio):
    cfg = PanelConfig(missing_threshold=60.0, max_feature_ratio=ratio)
    panel = monthly_panel(longs(spark), cfg)
    months = pd.date_range("2021-03-31", periods=20, freq="ME")
    y = pd.Series(np.arange(20.0), index=months, name="y")
    target = spark.createDataFrame([(t.date(), v) for t, v in y.items()], "date date, y double")
    master = y.to_frame().join(lagged_by_pandas(by_pandas(TABLES)), how="inner")
    x, k = master.drop(columns="y"), int(20 * ratio)
    want = x if x.shape[1] <= k else x[x.var().nlargest(k).index]
    trained = train_variance(panel, target, cfg)
    got = frame_of(wide_training(trained, cfg))
    assert list(got.columns) == [*want.columns, "y"]
    np.testing.assert_allclose(got.drop(columns="y").to_numpy(float), want.to_numpy(float))
    report = trained.metadata.first()
    assert (report["original_features"], report["final_features"], report["n_samples"]) == (x.shape[1], want.shape[1], 20)


def test_simple_training_keeps_all_dates(spark):
    cfg = PanelConfig(missing_threshold=60.0)
    target = spark.createDataFrame([(day("2030-01-31"), 1.0)], "date date, y double")
    got = frame_of(train_simple(monthly_panel(longs(spark), cfg), target, cfg))
    want = pd.concat([lagged_by_pandas(by_pandas(TABLES)), pd.Series([1.0], [pd.Timestamp("2030-01-31")], name="y")], axis=1)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_wide_keeps_given_names(spark):
    wide = to_wide(series(spark, [("2024-01-31", 1.0)]), ["m", "gone"])
    assert wide.columns == ["date", "m", "gone"]
