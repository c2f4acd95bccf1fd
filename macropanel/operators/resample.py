"""Month-end resampling of daily, monthly and quarterly series in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DATE, FREQ, POS, VALUE
from ..functions.values import exact_total, total_of
from .longform import series_cols, series_window
from .sequence import previous_known


def month_end_mean(
    df: DataFrame, keys: Sequence[str] = (), *, exact_scale: int | None = None, table: bool = True
) -> DataFrame:
    """Mean of the known values per series and calendar month; months without a row are absent."""
    return state_mean(monthly_state(df, keys, exact_scale=exact_scale, table=table), keys, table=table)


def state_mean(state: DataFrame, keys: Sequence[str] = (), *, table: bool = True) -> DataFrame:
    """The mean of the known values of each monthly state."""
    return state.select(*series_cols(keys, table), DATE, _mean().alias(VALUE))


def monthly_state(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    carry: Sequence[str] = (),
    exact_scale: int | None = None,
    first_days: bool = False,
    mergeable: bool = False,
    table: bool = True,
) -> DataFrame:
    """Everything later stages need to know about a month of a series, in one aggregation.

    Sums and counts combine before the shuffle, so a series that holds most of the rows
    costs no more than its number of months. `carry` columns must be constant per series; they
    are grouped by, because a text column among the aggregates would force a sort of all rows.
    `first_days` adds the value and the number of rows of the first day of each month. `mergeable` leaves
    exact totals as decimals, for `merge_states`.
    """
    by = series_cols(keys, table)
    raw_null = F.col("raw_null") if "raw_null" in df.columns else F.col(VALUE).isNull()
    on_first = F.dayofmonth(DATE) == 1
    first = [
        F.count_if(on_first).alias("first_rows"),
        F.max(F.when(on_first, F.col(VALUE))).alias("first_value"),
        F.count_if(on_first & raw_null).alias("first_empty"),
    ] if first_days else []
    total = exact_total if mergeable and exact_scale is not None else total_of
    return (
        df.groupBy(*by, *carry, F.last_day(DATE).alias(DATE))
        .agg(
            total(F.col(VALUE), exact_scale).alias("total"),
            F.count(VALUE).alias("known"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(raw_null).alias("empty"),
            F.count_if(~raw_null & F.col(VALUE).isNull()).alias("not_number"),
            F.max(DATE).alias("last_date"),
            *first,
        )
    )


def merge_states(states: DataFrame, keys: Sequence[str] = (), *, carry: Sequence[str] = (), table: bool = True) -> DataFrame:
    """One state a series and month from the states of several batches of its rows."""
    by = [*series_cols(keys, table), *carry, DATE]
    most = [c for c in ("last_date", "first_value") if c in states.columns]
    sums = [c for c in states.columns if c not in by and c not in most]
    return states.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def _mean() -> Column:
    return F.col("total") / F.nullif(F.col("known"), F.lit(0))


def month_spine(df: DataFrame, keys: Sequence[str] = (), *, table: bool = True) -> DataFrame:
    """Add the missing months between the first and last month of each series, with NULL.

    Each row is expanded up to the row that follows it, so no calendar is joined.
    """
    following = F.lead(DATE).over(series_window(keys, table))
    until = F.coalesce(F.add_months(F.trunc(following, "MM"), -1), F.trunc(DATE, "MM"))
    months = F.sequence(F.trunc(DATE, "MM"), until, F.expr("interval 1 month"))
    others = [c for c in df.columns if c not in (DATE, VALUE)]
    return df.select(*others, VALUE, months.alias("__months")).select(
        *others,
        F.posexplode("__months").alias("__i", "__month"),
        VALUE,
    ).select(
        *others,
        F.last_day("__month").alias(DATE),
        F.when(F.col("__i") == 0, F.col(VALUE)).alias(VALUE),
    )


def trim_partial_month(df: DataFrame, keys: Sequence[str] = (), *, last_date: str, table: bool = True) -> DataFrame:
    """Drop the last month of a series unless its last dated row is a month end."""
    whole = Window.partitionBy(*series_cols(keys, table))
    last = F.max(last_date).over(whole)
    return (
        df.withColumn("__last", last)
        .filter((F.col("__last") == F.last_day("__last")) | (F.last_day(DATE) < F.last_day("__last")))
        .drop("__last")
    )


def interpolate(
    df: DataFrame, keys: Sequence[str] = (), *, where: Column | None = None, table: bool = True
) -> DataFrame:
    """Linear interpolation over row position in the rows that satisfy `where` (default all).

    Interior gaps are linear, trailing gaps repeat the last value, leading gaps stay NULL.
    """
    ahead = series_window(keys, table)
    back = Window.partitionBy(*series_cols(keys, table)).orderBy(F.col(DATE).desc())
    v = F.col(VALUE)
    known = lambda position: F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(position).alias("at")))
    span = F.col("__i") - F.col("__b.at")
    gap = span + F.col("__j") - F.col("__a.at")
    filled = (
        F.when(v.isNotNull() | F.col("__b").isNull(), v)
        .when(F.col("__a").isNull(), F.col("__b.v"))
        .otherwise(F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * span / gap)
    )
    if where is not None:
        filled = F.when(where, filled).otherwise(v)
    return (
        df.withColumn("__i", F.row_number().over(ahead))
        .withColumn("__b", previous_known(known("__i"), ahead))
        .withColumn("__j", F.row_number().over(back))
        .withColumn("__a", previous_known(known("__j"), back))
        .withColumn(VALUE, filled)
        .drop("__i", "__b", "__j", "__a")
    )


def sparse_share(keys: Sequence[str] = (), *, after_cast: bool = False, table: bool = True) -> Column:
    """Share of missing cells of a series in percent, from its monthly states."""
    whole = Window.partitionBy(*series_cols(keys, table))
    missing = F.col("empty") + F.col("not_number") if after_cast else F.col("empty")
    return F.sum(missing).over(whole) * 100.0 / F.sum("rows").over(whole)


def split_states(
    state: DataFrame,
    keys: Sequence[str] = (),
    *,
    mode: str = "exact_first_day",
    where: Column | None = None,
    table: bool = True,
) -> DataFrame:
    """`jan_feb_split` on monthly states made with `first_days`.

    The split moves half of February's value to January, so it can be booked on the sums of
    the two months; the source rows are then read once, and only states are shuffled.
    """
    by_day = mode == "exact_first_day"
    month = F.month(DATE)
    w = Window.partitionBy(*series_cols(keys, table), F.year(DATE))
    of = lambda m, c: F.max(F.when(month == m, c)).over(w)
    rows = F.col("first_rows") if by_day else F.col("rows")
    single = F.col("first_value") if by_day else F.col("total")
    jan, feb = of(1, single), of(2, single)
    fires = (of(1, rows) == 1) & (of(2, rows) == 1) & (jan.isNull() | (jan == 0)) & feb.isNotNull() & (feb != 0)
    if where is not None:
        fires = fires & where
    was_empty = F.col("first_empty") if by_day else F.col("empty")
    half, in_jan = F.col("__half"), F.col("__half").isNotNull() & (month == 1)
    gained = (in_jan & single.isNull()).cast("long")
    return (
        state.withColumn("__half", F.when(month.isin(1, 2) & fires, feb / 2))
        .withColumns({
            "total": F.when(in_jan, F.coalesce("total", F.lit(0.0)) + half)
            .when(half.isNotNull(), F.col("total") - half).otherwise(F.col("total")),
            "known": F.col("known") + gained,
            "empty": F.col("empty") - F.when(in_jan, was_empty).otherwise(F.lit(0)),
            "not_number": F.col("not_number") - F.when(in_jan, gained - was_empty).otherwise(F.lit(0)),
        })
        .drop("__half", "first_rows", "first_value", "first_empty")
    )


def resample_state(
    state: DataFrame,
    keys: Sequence[str] = (),
    *,
    missing_threshold: float | None = None,
    check_after_cast: bool = False,
    keep_empty: bool = False,
    table: bool = True,
) -> DataFrame:
    """Monthly states to a gap-free monthly series, by the `freq` of each series.

    daily: drop a last partial month; quarterly: interpolate; other: plain mean. Series with
    too many missing cells are dropped. All steps share one exchange.

    A series whose only month is partial has no month left. With `keep_empty` it keeps one row
    without a date, so that a merge still knows its column.
    """
    if missing_threshold is not None:
        share = sparse_share(keys, after_cast=check_after_cast, table=table)
        state = state.withColumn("__share", share).filter(F.col("__share") < missing_threshold).drop("__share")
    whole = Window.partitionBy(*series_cols(keys, table))
    last = F.col("__last")
    keep = (F.col(FREQ) != "daily") | (last == F.last_day(last)) | (F.col(DATE) < F.last_day(last))
    only = F.col("__first") == F.last_day(last)
    carried = [c for c in (FREQ, POS, "table_pos") if c in state.columns]
    # The spine is laid before the trim: the month before a trimmed one may itself be a gap.
    monthly = state.select(
        *series_cols(keys, table), *carried, F.max("last_date").over(whole).alias("__last"),
        F.min(DATE).over(whole).alias("__first"), DATE, _mean().alias(VALUE),
    )
    spined = month_spine(monthly, keys, table=table)
    if keep_empty:
        spined = spined.filter(keep | only).withColumns(
            {DATE: F.when(keep, F.col(DATE)), VALUE: F.when(keep, F.col(VALUE))}
        )
    else:
        spined = spined.filter(keep)
    spined = spined.drop("__last", "__first")
    return interpolate(spined, keys, where=F.col(FREQ) == "quarterly", table=table)


def resample_monthly(
    df: DataFrame,
    keys: Sequence[str] = (),
    *,
    missing_threshold: float | None = None,
    check_after_cast: bool = False,
    exact_scale: int | None = None,
    keep_empty: bool = False,
    table: bool = True,
) -> DataFrame:
    """Long rows with a `freq` column to month-end series."""
    carry = [c for c in (FREQ, POS, "table_pos") if c in df.columns]
    if FREQ not in df.columns:
        df, carry = df.withColumn(FREQ, F.lit("unknown")), [*carry, FREQ]
    state = monthly_state(df, keys, carry=carry, exact_scale=exact_scale, table=table)
    return resample_state(
        state, keys, missing_threshold=missing_threshold, check_after_cast=check_after_cast,
        keep_empty=keep_empty, table=table,
    )
