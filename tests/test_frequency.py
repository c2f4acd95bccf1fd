import datetime as dt

import pytest
from macropanel.operators.frequency import detect_frequency, detect_target_frequency

START = dt.date(2024, 1, 1)


def every(days, n):
    return [START + dt.timedelta(days=days * i) for i in range(n)]


def label(spark, dates, detect=detect_frequency):
    df = spark.createDataFrame([("s", d) for d in dates], "s string, date date")
    return detect(df, ["s"]).first()["freq"]


@pytest.mark.parametrize("days, n, expected", [
    (21, 6, "monthly"), (2, 6, "daily"), (2, 3, "daily"), (1, 5, "daily"), (20, 3, "monthly"), (40, 3, "monthly"),
    (80, 3, "quarterly"), (100, 3, "quarterly"), (7, 6, "unknown"), (14, 6, "unknown"), (19, 3, "unknown"),
    (41, 3, "unknown"), (79, 3, "unknown"), (101, 3, "unknown"), (30, 1, "unknown"),
])
def test_bounds(spark, days, n, expected):
    assert label(spark, every(days, n)) == expected


@pytest.mark.parametrize("dates, expected", [
    (["2024-01-05", "2024-02-10", "2024-03-15", "2024-04-20"], "monthly"),
    (["2024-01-01", "2024-04-20", "2024-07-15", "2024-10-10"], "quarterly"),
    (["2024-01-01", "2024-01-01", "2024-01-01", "2024-04-01"], "daily"),  # equal dates count as gaps of 0
])
def test_irregular(spark, dates, expected):
    assert label(spark, [dt.date.fromisoformat(d) for d in dates]) == expected


@pytest.mark.parametrize("days, expected", [
    (1, "daily"), (2, "monthly"), (28, "monthly"), (31, "monthly"), (88, "quarterly"), (93, "quarterly"), (94, "monthly"),
])
def test_target_bounds(spark, days, expected):
    assert label(spark, every(days, 4), detect_target_frequency) == expected


def test_missing_column_and_one_date(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2)], "s string, other int")
    assert detect_frequency(df, ["s"]).first()["freq"] == "unknown"
    assert label(spark, every(1, 1), detect_target_frequency) == "monthly"


def test_median_of_times_is_exact(spark):
    """Two middle gaps in different days are averaged before the floor."""
    import pandas as pd

    stamps = ["2024-01-01 00:00:00", "2024-01-01 20:00:00", "2024-01-06 15:00:00"]
    df = spark.createDataFrame([("s", pd.Timestamp(t).to_pydatetime()) for t in stamps], "s string, date timestamp")
    gaps = pd.Series(pd.to_datetime(stamps)).diff().dropna()
    assert gaps.median().days == 2
    assert detect_frequency(df, ["s"]).first()["freq"] == "daily"


def test_random_times_match_pandas(spark):
    import numpy as np
    import pandas as pd
    from macropanel.operators.frequency import median_gap_days

    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for s in range(12):
        stamps = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 ** 6 * (s + 1), 40 + s), unit="s")
        rows += [(s, t.to_pydatetime()) for t in stamps] + [(s, stamps[0].to_pydatetime())]
        expected[s] = pd.Series([*stamps, stamps[0]]).sort_values().diff().dropna().median().days
    found = median_gap_days(spark.createDataFrame(rows, "s int, date timestamp"), ["s"], "date").collect()
    assert {r["s"]: r["median_days"] for r in found} == expected
