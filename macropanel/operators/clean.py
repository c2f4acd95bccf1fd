"""Dropping and choosing metrics on long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DATE, METRIC, POS, VALUE
from .longform import series_cols

# Parts of a series that meet in different tasks.
SLOTS = 64


def drop_sparse(
    long: DataFrame,
    keys: Sequence[str] = (),
    *,
    threshold: float = 20.0,
    check_after_cast: bool = False,
    table: bool = True,
) -> DataFrame:
    """Drop a metric when its share of missing cells is `threshold` percent or more.

    `raw_null` (set by `to_long`) counts empty cells; text that is no number counts only
    with `check_after_cast`. Dates and keys are never tested. The rows of a series are dealt over
    `SLOTS` slots, so that a long one does not meet what is kept of it in one task.
    """
    by = series_cols(keys, table)
    missing = F.col(VALUE).isNull()
    if "raw_null" in long.columns and not check_after_cast:
        missing = F.col("raw_null")
    dealt = long.withColumn("__slot", F.pmod(F.xxhash64(DATE, VALUE), F.lit(SLOTS)))
    whole = Window.partitionBy(*by)
    kept = (
        dealt.groupBy(*by, "__slot")
        .agg(F.count_if(missing).alias("__missing"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__share", F.sum("__missing").over(whole) * 100.0 / F.sum("__rows").over(whole))
        .filter(F.col("__share") < threshold)
    )
    return dealt.join(kept.select(*by, "__slot"), [*by, "__slot"], "left_semi").select(*long.columns)


def drop_all_null(long: DataFrame, keys: Sequence[str] = (), *, table: bool = True) -> DataFrame:
    """Drop metrics without any known value."""
    by = series_cols(keys, table)
    kept = long.filter(F.col(VALUE).isNotNull()).select(*by).distinct()
    return long.join(kept, by, "left_semi")


def choose_columns(
    long: DataFrame,
    catalog: DataFrame,
    *,
    id_col: str = "id",
    numeric: Column | None = None,
) -> DataFrame:
    """Keep the columns the catalog lists for an id; an id of which no listed column exists
    (or that lists none) keeps all its numeric columns.

    `numeric` says whether a row's cell may belong to a numeric column. It is combined over
    the rows of a column, so the operator also runs on monthly states.
    """
    if numeric is None:
        numeric = ~F.col("raw_null") & F.col(VALUE).isNull() if "raw_null" in long.columns else F.lit(False)
        numeric = ~numeric
    columns = long.groupBy(id_col, METRIC).agg(F.bool_and(numeric).alias("__numeric"))
    listed = catalog.select(
        F.col("id").alias(id_col), F.explode("columns").alias(METRIC), F.lit(True).alias("__listed")
    ).distinct()
    per_id = Window.partitionBy(id_col)
    kept = (
        columns.join(listed, [id_col, METRIC], "left")
        .withColumn("__any", F.max(F.coalesce("__listed", F.lit(False))).over(per_id))
        .filter(F.when(F.col("__any"), F.col("__listed")).otherwise(F.col("__numeric")))
        .select(id_col, METRIC)
    )
    return long.join(kept, [id_col, METRIC], "left_semi")


def target_series(
    monthly: DataFrame, target_col: str = "y", keys: Sequence[str] = ()
) -> DataFrame:
    """`(keys, date, y)`: the metric called `target_col`, else the first measure of the table."""
    keys = list(keys)
    named = F.max(F.when(F.col(METRIC) == target_col, F.col(METRIC)))
    chosen = monthly.groupBy(*keys).agg(F.coalesce(named, F.min_by(METRIC, POS)).alias(METRIC))
    return monthly.join(chosen, [*keys, METRIC], "left_semi").select(*keys, DATE, F.col(VALUE).alias("y"))


def in_date_range(df: DataFrame, start: str | None = None, end: str | None = None, *, date: str = DATE) -> DataFrame:
    """Rows between two dates, both included and both optional."""
    if start:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def drop_null_dates(df: DataFrame, *, date: str = DATE) -> DataFrame:
    return df.filter(F.col(date).isNotNull())


def tail_rows(df: DataFrame, n: int = 10, *, date: str = DATE, ties: Sequence[str] = ()) -> DataFrame:
    """The `n` latest rows; `ties` decides among rows of one date."""
    return df.orderBy(F.col(date).desc(), *[F.col(c).desc() for c in ties]).limit(n)
