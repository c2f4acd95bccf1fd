"""Operators along the dates of one series.

They expect one row per series and date (as resampling gives it), so a window holds at
most one row per calendar period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DATE, VALUE
from .longform import series_cols, series_window


def _reversed(keys, table):
    return Window.partitionBy(*series_cols(keys, table)).orderBy(F.col(DATE).desc())


def _whole(keys, table):
    return series_window(keys, table).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous_known(col: Column, window) -> Column:
    return F.last(col, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def ffill(df: DataFrame, keys: Sequence[str] = (), *, value: str = VALUE, table: bool = True) -> DataFrame:
    """Fill a gap with the last known value."""
    return df.withColumn(value, previous_known(F.col(value), series_window(keys, table)))


def bfill(df: DataFrame, keys: Sequence[str] = (), *, value: str = VALUE, table: bool = True) -> DataFrame:
    """Fill a gap with the next known value.

    Written over the reversed order: a frame that grows from the start costs one pass,
    whereas one that shrinks towards the end is rescanned for every row.
    """
    return df.withColumn(value, previous_known(F.col(value), _reversed(keys, table)))


def fill_zero(df: DataFrame, *, value: str = VALUE) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def fill_both(df: DataFrame, keys: Sequence[str] = (), *, value: str = VALUE, table: bool = True) -> DataFrame:
    """Forward fill, then back fill. After the first only leading gaps are left, and those
    take the first known value of the series."""
    forward = previous_known(F.col(value), series_window(keys, table))
    first = F.first(F.col(value), ignorenulls=True).over(_whole(keys, table))
    return df.withColumn(value, F.coalesce(forward, first))


def leak_safe_lag(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    value: str = VALUE,
    strict_past: bool = False,
    table: bool = True,
) -> DataFrame:
    """Lag by one row, then close the gaps and put 0 where nothing is known.

    By default gaps are closed by the next lagged value. `strict_past` closes them from
    earlier rows only, so that no row sees its own or a later period.
    """
    lagged = df.withColumn(value, F.lag(value, 1).over(series_window(keys, table)))
    filled = (ffill if strict_past else bfill)(lagged, keys, value=value, table=table)
    return fill_zero(filled, value=value)


def rolling_windows(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    max_timeshift: int = 6,
    min_timeshift: int = 3,
    value: str = VALUE,
    table: bool = True,
) -> DataFrame:
    """`xs`: the values of up to `max_timeshift + 1` rows that end at each date, oldest first;
    windows of fewer than `min_timeshift + 1` rows are dropped."""
    frame = series_window(keys, table).rowsBetween(-max_timeshift, 0)
    return (
        df.withColumn("xs", F.collect_list(value).over(frame))
        .filter(F.size("xs") >= min_timeshift + 1)
        .drop(value)
    )


def jan_feb_split(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    mode: str = "exact_first_day",
    where: Column | None = None,
    value: str = VALUE,
    table: bool = True,
) -> DataFrame:
    """Halve a cumulated January-February value over both months.

    Applies where January is present but missing or 0 and February is known and not 0.
    `exact_first_day` looks at rows dated January 1 and February 1 only; `by_month` takes
    any day of the two months. A year with two rows for one of the months is left alone.
    Only rows of the two months (and of `where`) are shuffled, everything else passes by.
    """
    if mode not in ("exact_first_day", "by_month"):
        raise ValueError(f"unknown mode {mode!r}")
    month = F.month(DATE)
    involved = month.isin(1, 2)
    if mode == "exact_first_day":
        involved = involved & (F.dayofmonth(DATE) == 1)
    if where is not None:
        involved = involved & where
    year = "__year"
    w = Window.partitionBy(*series_cols(keys, table), year)
    count = lambda m: F.count(F.when(month == m, F.lit(1))).over(w)
    cell = lambda m: F.max(F.when(month == m, F.col(value))).over(w)
    jan, feb = cell(1), cell(2)
    fires = (count(1) == 1) & (count(2) == 1) & (jan.isNull() | (jan == 0)) & feb.isNotNull() & (feb != 0)
    split = (
        df.filter(involved)
        .withColumn(year, F.year(DATE))
        .withColumn("__half", F.when(fires, feb / 2))
        .withColumn(value, F.coalesce("__half", value))
    )
    if "raw_null" in df.columns:
        split = split.withColumn("raw_null", F.col("raw_null") & F.col("__half").isNull())
    split = split.drop(year, "__half")
    return df.filter(~F.coalesce(involved, F.lit(False))).unionByName(split)
