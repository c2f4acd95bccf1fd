import datetime as dt

import pytest
from macropanel.functions import dates
from macropanel.functions.values import clean_name, num, suffixed
from pyspark.sql import functions as F


def one(spark, function, text, *more):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(function(F.col("t"), *[F.lit(m) for m in more])).first()[0]


def d(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.mark.parametrize("text, expected", [
    ("20240131", "2024-01-31"), (" 20240131 ", "2024-01-31"), ("20240101.0", None), ("invalid", None), (None, None),
    ("20240231", None), ("2024011", "2024-01-01"), ("193000", None),
])
def test_ymd(spark, text, expected):
    assert one(spark, dates.parse_ymd, text) == d(expected)


@pytest.mark.parametrize("text, expected", [
    ("2025年", None), ("2025年第1季度", "2025-01-01"), ("2025年第4季度", "2025-10-01"), ("2026年04月份", "2026-04-01"),
    ("201501", "2015-01-01"), ("2024-01-05", "2024-01-05"), ("x", None),
])
def test_chinese(spark, text, expected):
    assert one(spark, dates.parse_chinese, text) == d(expected)


@pytest.mark.parametrize("text, code, expected", [
    ("202401", "month", "2024-01-01"), ("2026Q3", "quarter", "2026-07-01"), ("20240131", "trade_date", "2024-01-31"),
    ("20240131", "date", "2024-01-31"), ("2024-01-31", "date", "2024-01-31"), ("202413", "month", None),
])
def test_coded(spark, text, code, expected):
    assert one(spark, dates.parse_coded, text, code) == d(expected)


@pytest.mark.parametrize("text, expected", [
    ("2019/1/1", "2019-01-01"), ("2024-01-05 10:00:00", "2024-01-05"), ("2023-1", "2023-01-01"), ("201501", None),
    ("2023年1月5日", "2023-01-05"), ("1/5/2023", "2023-01-05"), ("Jan 2023", "2023-01-01"), ("23-Jan", None), ("100", None),
])
def test_generic(spark, text, expected):
    assert one(spark, dates.parse_generic, text) == d(expected)


@pytest.mark.parametrize("texts, style, expected", [
    (["23-Jan", "98-Feb"], "dd_mon", ["2023-01-01", "1998-02-01"]),
    (["2024-01-05", "2024-01-06 00:00"], "iso", ["2024-01-05", "2024-01-06"]),
    (["20240131", "2024-01-05"], "ymd", ["2024-01-31", None]),
    (["2023年1月", "2023年02月"], "cn", ["2023-01-01", "2023-02-01"]),
    (["2024-01-05", None], "generic", ["2024-01-05", None]),
    (["2019/1/1", "x"], "generic", ["2019-01-01", None]),
    (["2024", None], "ymd", [None, None]),
])
def test_one_style_per_column(spark, texts, style, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.agg(dates.column_style(F.col("t")).alias("s")).first()["s"]
    assert found == style
    parsed = df.select("i", dates.parse_by_style(F.col("t"), F.lit(style)).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in parsed] == [d(e) for e in expected]


@pytest.mark.parametrize("text, expected", [
    ("1.5", 1.5), (" 2 ", 2.0), ("1,000", None), ("1d", None), ("1e3", 1000.0), ("", None), ("True", None), ("0x10", None),
    ("-.5", -0.5), ("5.", 5.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("nan", None), (None, None), ("1_0", None),
])
def test_num(spark, text, expected):
    assert one(spark, num, text) == expected


def test_names(spark):
    assert one(spark, clean_name, " CPI (all-items)/y.y ") == "cpi_all_items_y_y"
    row = spark.range(1).select(
        suffixed(F.lit("a"), F.lit("daily")), suffixed(F.lit("a"), F.lit("quarterly")), suffixed(F.lit("a"), F.lit("unknown"))
    ).first()
    assert tuple(row) == ("a_日度", "a_季度", "a")
