"""Short series for the tests."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows, **extra):
    """Long rows of one series from `(date text, value)`."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(day(d), v) for d, v in rows], "date date, value double")
    columns = {"table": "t", "metric": "m", "pos": 0, "freq": "monthly", **extra}
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def values(df, *order):
    """`value` in date order."""
    return [r["value"] for r in df.orderBy(*(order or ("date",))).collect()]
