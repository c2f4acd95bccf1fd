"""Merging monthly tables into one panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import DATE, FREQ, METRIC, POS, TABLE, VALUE
from ..functions.values import prefixed, suffixed
from .longform import attach
from .sequence import ffill, fill_both


def suffix_metrics(long: DataFrame) -> DataFrame:
    """Append the frequency suffix to every metric name."""
    return long.withColumn(METRIC, suffixed(F.col(METRIC), F.col(FREQ)))


def prefix_metrics(long: DataFrame, name: str = "name") -> DataFrame:
    """Put the catalog name before every metric name."""
    return long.withColumn(METRIC, prefixed(F.col(name), F.col(METRIC)))


def merge_panel(
    monthly: DataFrame,
    keys: Sequence[str] = (),
    *,
    fill: bool = True,
    fill_single: bool = False,
    strict_past: bool = False,
) -> DataFrame:
    """Full outer merge of all tables on the date, as long rows `(keys, metric, pos.., date, value)`.

    Every metric gets a row for every date some table of its entity has. Instead of one join
    per table, each series is packed into one row (its months), meets the date axis of its
    entity once, and is unpacked again. A metric name that two tables share is an error.

    Gaps are filled forward, then backward, except when the entity has one table only.
    """
    order = [c for c in ("table_pos", POS) if c in monthly.columns]
    axis = monthly.groupBy(*keys).agg(
        F.array_sort(F.collect_set(DATE)).alias("__axis"),
        (F.min(TABLE) != F.max(TABLE)).alias("__several"),
    )
    series = monthly.groupBy(*keys, METRIC).agg(
        F.collect_list(F.struct(DATE, VALUE)).alias("__months"),
        F.min(TABLE).alias("__first"),
        F.max(TABLE).alias("__last"),
        *[F.min(c).alias(c) for c in order],
    )
    clash = F.concat(F.lit("column in more than one table: "), F.col(METRIC))
    checked = F.when(F.col("__first") != F.col("__last"), F.raise_error(clash).cast("map<date,double>")).otherwise(
        F.map_from_entries(F.filter("__months", lambda m: m[DATE].isNotNull()))  # a row without a date marks an empty column
    )
    grid = attach(series, axis, keys).select(
        *keys, METRIC, *order, "__several", checked.alias("__map"), F.explode("__axis").alias(DATE)
    ).select(*keys, METRIC, *order, "__several", DATE, F.element_at("__map", F.col(DATE)).alias(VALUE))
    if not fill:
        return grid.drop("__several")
    filled = (ffill if strict_past else fill_both)(grid.withColumn("__v", F.col(VALUE)), keys, value="__v", table=False)
    wanted = F.lit(True) if fill_single else F.col("__several")
    return filled.withColumn(VALUE, F.when(wanted, F.col("__v")).otherwise(F.col(VALUE))).drop("__v", "__several")
