"""Sampling frequency of each series from the gaps between its dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from ..config import FREQ

DAY = 86_400_000_000


def _series_gaps(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """Gaps between consecutive dates of each series as a small histogram.

    One row per (series, whole days) with the number of gaps and the least and largest
    one. Equal dates are counted, not sorted, so a series that holds most of the rows
    is spread over tasks: times are reduced to distinct values, those to seconds, those to
    days, and only the days of a series (bounded by the calendar) meet in one task.
    """
    is_date = isinstance(df.schema[date].dataType, DateType)
    stamp = F.unix_micros(F.col(date).cast("timestamp"))
    points = (
        df.groupBy(*by, stamp.alias("lo"))
        .agg(F.count(F.lit(1)).alias("n"))
        # missing dates make no gap, but keep a series without any date in the result
        .withColumn("n", F.when(F.col("lo").isNull(), F.lit(1)).otherwise(F.col("n")))
        .withColumn("hi", F.col("lo"))
        # zero gaps come from equal dates
        .withColumn("g_min", F.when(F.col("n") > 1, F.lit(0)).cast("long"))
        .withColumn("g_max", F.when(F.col("n") > 1, F.lit(0)).cast("long"))
    )
    if not is_date:
        points = _coarsen(_coarsen(points, by, DAY // 86_400), by, DAY)
    ordered = Window.partitionBy(*by).orderBy("lo")
    days = points.withColumn("gap", F.col("lo") - F.lag("hi").over(ordered))
    # A point without a gap adds nothing to the counts; its series shows up all the same.
    within = F.struct(
        F.when(F.col("n") > 1, F.lit(0)).cast("long").alias("days"), (F.col("n") - 1).alias("n"),
        F.col("g_min").alias("least"), F.col("g_max").alias("largest"),
    )
    between = F.struct(
        F.floor(F.col("gap") / DAY).alias("days"), F.col("gap").isNotNull().cast("long").alias("n"),
        F.col("gap").alias("least"), F.col("gap").alias("largest"),
    )
    return (
        days.select(*by, F.explode(F.array(within, between)).alias("g"))
        .groupBy(*by, F.col("g.days").alias("days"))
        .agg(F.sum("g.n").alias("n"), F.min("g.least").alias("least"), F.max("g.largest").alias("largest"))
    )


def _coarsen(points: DataFrame, by: list[str], width: int) -> DataFrame:
    """Join the points of each time slot into one, keeping the gaps inside the slot."""
    slot = F.floor(F.col("lo") / width).alias("slot")
    inside = Window.partitionBy(*by, "slot").orderBy("lo")
    return (
        points.withColumn("slot", slot)
        .withColumn("gap", F.col("lo") - F.lag("hi").over(inside))
        .groupBy(*by, "slot")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"),
            F.min(F.least("g_min", "gap")).alias("g_min"),
            F.max(F.greatest("g_max", "gap")).alias("g_max"),
        )
        .drop("slot")
    )


def median_gap_days(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Median gap of each series in whole days (floored), exact for even counts too.

    Both middle ranks are found in the histogram. If they fall into the same whole day, so
    does their mean; if not, the lower one is the largest gap of its slot and the upper
    one the least of its slot. A series with fewer than two dates has no median.
    """
    by = list(by)
    hist = _series_gaps(df, by, date)
    up_to = Window.partitionBy(*by).orderBy("days")
    whole = Window.partitionBy(*by)
    ranked = (
        hist.withColumn("upto", F.sum("n").over(up_to))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("r1", F.floor((F.col("total") + 1) / 2))
        .withColumn("r2", F.floor(F.col("total") / 2) + 1)
    )
    holds = lambda r: (F.col(r) <= F.col("upto")) & (F.col(r) > F.col("upto") - F.col("n"))
    return (
        ranked.groupBy(*by)
        .agg(
            F.max(F.when(holds("r1"), F.col("days"))).alias("d1"),
            F.max(F.when(holds("r2"), F.col("days"))).alias("d2"),
            F.max(F.when(holds("r1"), F.col("largest"))).alias("low"),
            F.max(F.when(holds("r2"), F.col("least"))).alias("high"),
            F.sum("n").alias("gaps"),
        )
        .select(
            *by, "gaps",
            F.when(F.col("d1") == F.col("d2"), F.col("d1"))
            .otherwise(F.floor((F.col("low") + F.col("high")) / (2 * DAY)))
            .cast("int").alias("median_days"),
        )
    )


def frequency_label(days: Column) -> Column:
    """Wide bounds, used for indicator tables; weekly and anything else is unknown."""
    return (
        F.when(days <= 2, "daily")
        .when(days.between(20, 40), "monthly")
        .when(days.between(80, 100), "quarterly")
        .otherwise("unknown")
    )


def target_frequency_label(days: Column) -> Column:
    """Narrow bounds, used for the target; anything else is monthly."""
    return (
        F.when(days <= 1, "daily")
        .when(days.between(28, 31), "monthly")
        .when(days.between(88, 93), "quarterly")
        .otherwise("monthly")
    )


def _detect(df, by, date, label, default):
    by = list(by) or ["__all"]
    if by == ["__all"]:
        df = df.withColumn("__all", F.lit(0))
    if date not in df.columns:
        out = df.groupBy(*by).agg(F.lit(default).alias(FREQ))
    else:
        out = median_gap_days(df, by, date).select(*by, label(F.col("median_days")).alias(FREQ))
    return out.drop("__all")


def detect_frequency(df: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """`(by..., freq)`: daily, monthly, quarterly or unknown, all series in one job."""
    return _detect(df, by, date, frequency_label, "unknown")


def detect_target_frequency(df: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """As `detect_frequency` with narrow bounds and monthly as the default."""
    return _detect(df, by, date, target_frequency_label, "monthly")
