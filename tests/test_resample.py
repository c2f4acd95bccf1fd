import numpy as np
import pandas as pd
import pytest
from helpers import day, series, values
from macropanel.operators import resample
from macropanel.operators.longform import to_long
from pyspark.sql import functions as F


def reference(df, freq):
    """The intended result, by pandas, for a frame indexed by date."""
    monthly = df.sort_index().resample("ME").mean()
    if freq == "daily" and not df.index.max().is_month_end:
        monthly = monthly.iloc[:-1]
    if freq == "quarterly":
        monthly = monthly.interpolate(method="linear")
    return monthly


def wide(long):
    pdf = long.select("date", "metric", "value").toPandas()
    out = pdf.pivot(index="date", columns="metric", values="value")
    out.index = pd.to_datetime(out.index)
    return out.sort_index()


def same(a, b):
    b = b.reindex(columns=a.columns)
    assert list(a.index) == list(b.index)
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("freq", ["daily", "monthly", "quarterly", "unknown"])
def test_matches_pandas(spark, freq):
    rng = np.random.default_rng(3)
    dates = pd.to_datetime("2022-01-10") + pd.to_timedelta(np.sort(rng.integers(0, 900, 60)), unit="D")
    frame = pd.DataFrame({"v": rng.normal(size=60), "w": rng.normal(size=60)}, index=dates)
    frame.loc[rng.random(60) < 0.4, "w"] = np.nan
    raw = spark.createDataFrame(frame.rename_axis("d").reset_index())
    long = to_long(raw, "d", table="t", freq=freq)
    same(reference(frame, freq), wide(resample.resample_monthly(long)))


def test_interpolation_edges(spark):
    rows = [("2023-03-31", 1.0, None), ("2023-06-30", 4.0, 2.0), ("2023-12-31", None, 5.0), ("2024-03-15", 10.0, None)]
    raw = spark.createDataFrame([(day(d), v, w) for d, v, w in rows], "d date, v double, w double")
    frame = raw.toPandas().set_index("d").astype(float)
    frame.index = pd.to_datetime(frame.index)
    same(reference(frame, "quarterly"), wide(resample.resample_monthly(to_long(raw, "d", table="t", freq="quarterly"))))


def test_gap_month_and_partial_month(spark):
    long = series(spark, [("2024-01-15", 1.0), ("2024-02-29", 2.0), ("2024-04-02", 3.0)], freq="daily")
    out = resample.resample_monthly(long)
    assert [str(r["date"]) for r in out.orderBy("date").collect()] == ["2024-01-31", "2024-02-29", "2024-03-31"]
    assert values(out) == [1.0, 2.0, None]
    plain = resample.resample_monthly(long.withColumn("freq", F.lit("monthly")))
    assert values(plain) == [1.0, 2.0, None, 3.0]


def test_only_month_partial_keeps_an_undated_row(spark):
    long = series(spark, [("2024-01-15", 1.0)], freq="daily")
    assert resample.resample_monthly(long).count() == 0
    assert [(r["date"], r["value"]) for r in resample.resample_monthly(long, keep_empty=True).collect()] == [(None, None)]


@pytest.mark.parametrize("threshold, kept", [(50.0, {"v"}), (50.1, {"v", "w"}), (0.0, set()), (100.0, {"v", "w"})])
def test_sparse_is_at_or_above(spark, threshold, kept):
    from macropanel.operators.clean import drop_sparse

    raw = spark.createDataFrame([(day("2024-01-31"), 1.0, None), (day("2024-02-29"), 2.0, 3.0)], "d date, v double, w double")
    long = to_long(raw, "d", table="t")
    for out in (drop_sparse(long, threshold=threshold), resample.resample_monthly(long, missing_threshold=threshold)):
        assert {r["metric"] for r in out.select("metric").distinct().collect()} == kept


def test_text_counts_as_present_unless_checked_after_cast(spark):
    raw = spark.createDataFrame([(day("2024-01-31"), "x"), (day("2024-02-29"), "y")], "d date, v string")
    long = to_long(raw, "d", table="t")
    assert resample.resample_monthly(long, missing_threshold=20.0).count() == 2
    assert resample.resample_monthly(long, missing_threshold=20.0, check_after_cast=True).count() == 0


def test_nan_is_missing(spark):
    raw = spark.createDataFrame([(day("2024-01-31"), float("nan")), (day("2024-01-30"), 2.0)], "d date, v double")
    assert values(resample.month_end_mean(to_long(raw, "d", table="t"))) == [2.0]
