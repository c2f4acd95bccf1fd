"""Wide to long and back. The core works on long rows `(keys, table, metric, pos, date, value)`.

A long table made by `to_long` is dense: every measure has a row for every date of its
table, with NULL for a missing value. So the first and last date of each series are those
of its whole table, and no join is needed to find them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DATE, FREQ, METRIC, POS, TABLE, VALUE
from ..functions.values import measure, missing


def series_cols(keys: Sequence[str] = (), table: bool = True) -> list[str]:
    """The columns that name one series."""
    return [*keys, *([TABLE] if table else []), METRIC]


def series_window(keys: Sequence[str] = (), table: bool = True):
    """The rows of one series in date order. All sequence operators share this spec, so
    Spark plans one exchange and one sort for a chain of them."""
    return Window.partitionBy(*series_cols(keys, table)).orderBy(DATE)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by `cols` into the session's number of shuffle partitions.

    For heavy work on few bytes, such as window features: the adaptive planner joins small
    partitions into one task, but leaves a stated number alone. Windows and groups over the
    same columns need no further exchange.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *cols)


def to_long(
    df: DataFrame,
    date_col: str,
    *,
    table: str,
    keys: Sequence[str] = (),
    measures: Sequence[str] | None = None,
    freq: str = "unknown",
) -> DataFrame:
    """Unpivot the measures of one dated table; `raw_null` tells which cells were empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if measures is None:
        measures = [c for c in df.columns if c != date_col and c not in keys]
    cells = F.array(*[
        F.struct(
            F.lit(i).alias(POS),
            F.lit(name).alias(METRIC),
            measure(F.col(f"`{name}`"), types[name]).alias(VALUE),
            missing(F.col(f"`{name}`"), types[name]).alias("raw_null"),
        )
        for i, name in enumerate(measures)
    ])
    return (
        df.filter(F.col(f"`{date_col}`").isNotNull())
        .select(*keys, F.col(f"`{date_col}`").cast("date").alias(DATE), F.explode(cells).alias("c"))
        .select(
            *keys, F.lit(table).alias(TABLE), f"c.{METRIC}", f"c.{POS}", DATE,
            f"c.{VALUE}", "c.raw_null", F.lit(freq).alias(FREQ),
        )
    )


def attach(df: DataFrame, per_entity: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the columns of a frame with one row per entity; without keys that is a single row,
    taken in as a scalar subquery."""
    if keys:
        return df.join(per_entity, list(keys))
    row = per_entity.select(F.struct(*per_entity.columns).alias("row")).scalar()
    return df.withColumn("__row", row).select(*df.columns, "__row.*")


def union_long(tables: Sequence[DataFrame]) -> DataFrame:
    """All long tables as one, numbered in list order; an empty list is an error."""
    if not tables:
        raise ValueError("no tables to merge")
    tables = [
        t if "table_pos" in t.columns else t.withColumn("table_pos", F.lit(i)) for i, t in enumerate(tables)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def metric_names(long: DataFrame) -> list[str]:
    """Metric names in table and column order, read by one small action."""
    order = [c for c in ("table_pos", POS) if c in long.columns]
    names = long.groupBy(METRIC).agg(*[F.min(c).alias(c) for c in order])
    return [r[METRIC] for r in names.orderBy(*order, METRIC).collect()]


def to_wide(
    long: DataFrame,
    names: Sequence[str] | None = None,
    *,
    keys: Sequence[str] = (),
    aliases: Sequence[str] | None = None,
) -> DataFrame:
    """One row per date, one column per metric. With `names` no extra pass is needed."""
    if names is None:
        names = metric_names(long)
    out = long.groupBy(*keys, DATE).pivot(METRIC, list(names)).agg(F.first(VALUE, ignorenulls=True))
    if aliases is not None:
        out = out.select(*keys, DATE, *[F.col(f"`{n}`").alias(a) for n, a in zip(names, aliases)])
    return out


