import pytest
from helpers import day, series, values
from macropanel.operators import resample, sequence
from pyspark.sql import functions as F

MONTHS = ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30", "2024-05-31"]


def gapped(spark, vs):
    return series(spark, list(zip(MONTHS, vs)))


@pytest.mark.parametrize("function, expected", [
    (sequence.ffill, [None, 5.0, 5.0, 7.0, 7.0]),
    (sequence.bfill, [5.0, 5.0, 7.0, 7.0, None]),
    (sequence.fill_both, [5.0, 5.0, 5.0, 7.0, 7.0]),
])
def test_fills(spark, function, expected):
    df = gapped(spark, [None, 5.0, None, 7.0, None])
    assert values(function(df)) == expected
    assert values(function(function(df))) == expected


def test_lag(spark):
    assert values(sequence.leak_safe_lag(gapped(spark, [5.0, 7.0, 9.0]))) == [5.0, 5.0, 7.0]
    interior = gapped(spark, [5.0, None, 9.0, 1.0, 2.0])
    assert values(sequence.leak_safe_lag(interior)) == [5.0, 5.0, 9.0, 9.0, 1.0]
    assert values(sequence.leak_safe_lag(interior, strict_past=True)) == [0.0, 5.0, 5.0, 9.0, 1.0]
    assert values(sequence.leak_safe_lag(gapped(spark, [None] * 5))) == [0.0] * 5


def test_strict_past_never_sees_its_own_or_a_later_period(spark):
    base = [1.0, None, 3.0, None, 5.0]
    before = values(sequence.leak_safe_lag(gapped(spark, base), strict_past=True))
    for i in range(5):
        changed = base[:i] + [99.0] * (5 - i)
        after = values(sequence.leak_safe_lag(gapped(spark, changed), strict_past=True))
        assert after[:i + 1] == before[:i + 1]


def test_rolling(spark):
    out = sequence.rolling_windows(gapped(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), max_timeshift=2, min_timeshift=1)
    assert [r["xs"] for r in out.orderBy("date").collect()] == [[1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 3.0, 4.0], [3.0, 4.0, 5.0]]


SPLITS = [
    ([("2024-01-01", 0.0), ("2024-02-01", 8.0)], [4.0, 4.0]),
    ([("2024-01-01", None), ("2024-02-01", 8.0)], [4.0, 4.0]),
    ([("2024-01-01", 1.0), ("2024-02-01", 8.0)], [1.0, 8.0]),
    ([("2024-02-01", 8.0)], [8.0]),  # no January row at all
    ([("2024-01-01", None), ("2024-02-01", 0.0)], [None, 0.0]),
    ([("2024-01-31", None), ("2024-02-29", 8.0)], [None, 8.0]),  # month ends are not first days
    ([("2024-01-01", None), ("2024-01-01", None), ("2024-02-01", 8.0)], [None, None, 8.0]),
    ([("2023-01-01", None), ("2024-02-01", 8.0)], [None, 8.0]),
]


@pytest.mark.parametrize("rows, expected", SPLITS)
def test_jan_feb(spark, rows, expected):
    assert values(sequence.jan_feb_split(series(spark, rows))) == expected


@pytest.mark.parametrize("rows, expected", SPLITS)
def test_jan_feb_on_states_equals_jan_feb_on_rows(spark, rows, expected):
    more = rows + [("2024-02-10", 6.0), ("2024-03-05", 1.0)]
    long = series(spark, more)
    by_rows = resample.resample_monthly(sequence.jan_feb_split(long))
    state = resample.monthly_state(long, carry=["freq", "pos"], first_days=True)
    by_states = resample.resample_state(resample.split_states(state))
    assert values(by_states) == values(by_rows)


def test_jan_feb_by_month(spark):
    rows = [("2024-01-31", None), ("2024-02-29", 8.0)]
    assert values(sequence.jan_feb_split(series(spark, rows), mode="by_month")) == [4.0, 4.0]
    with pytest.raises(ValueError):
        sequence.jan_feb_split(series(spark, rows), mode="other")


def test_entities_do_not_mix(spark):
    a = gapped(spark, [None, 1.0, None, 3.0, None]).withColumn("k", F.lit("a"))
    b = gapped(spark, [9.0, None, None, None, 5.0]).withColumn("k", F.lit("b"))
    both = a.unionByName(b)
    for f in (sequence.fill_both, sequence.bfill, sequence.leak_safe_lag):
        joint = f(both, ["k"])
        assert values(joint.filter("k = 'a'")) == values(f(a, ["k"]))
        assert values(joint.filter("k = 'b'")) == values(f(b, ["k"]))
    assert day("2024-01-31") == joint.agg(F.min("date")).first()[0]
