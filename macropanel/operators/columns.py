"""Feature columns: one row per (entity, feature) with its values over the dates as an array.

From here on a feature is one row, as long as the calendar of its entity. Statistics of a
feature are then row-wise, and nothing has to be pivoted before the selection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..config import DATE, METRIC, POS, VALUE


def pack(long: DataFrame, keys: Sequence[str] = (), *, feature: str = METRIC, y: bool = True) -> DataFrame:
    """`(keys, feature, pos.., dates, xs, ys)` from long rows, in date order."""
    order = [c for c in ("table_pos", POS) if c in long.columns]
    point = F.struct(DATE, F.col(VALUE).alias("x"), *([F.col("y")] if y else []))
    packed = long.groupBy(*keys, F.col(feature).alias("feature")).agg(
        F.array_sort(F.collect_list(point)).alias("p"), *[F.min(c).alias(c) for c in order]
    )
    return packed.select(
        *keys, "feature", *order, F.col(f"p.{DATE}").alias("dates"), F.col("p.x").alias("xs"),
        *([F.col("p.y").alias("ys")] if y else []),
    )


def transpose(vectors: DataFrame, names: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """Windows with feature vectors to feature columns.

    `vectors` is `(keys, metric, pos.., date, fv, y)`. The windows of a series (at most one per
    period) meet in one row, are turned there, and leave as one row per feature.
    """
    order = [c for c in ("table_pos", POS) if c in vectors.columns]
    series = vectors.groupBy(*keys, METRIC).agg(
        F.array_sort(F.collect_list(F.struct(DATE, "fv", "y"))).alias("p"), *[F.min(c).alias(c) for c in order]
    )
    labels = F.array(*[F.lit(n) for n in names])
    turned = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda f: F.transform(F.col("p.fv"), lambda v: F.get(v, f)),
    )
    return (
        series.select(
            *keys, METRIC, *order, F.col(f"p.{DATE}").alias("dates"), F.col("p.y").alias("ys"), turned.alias("turned")
        )
        .select(*keys, METRIC, *order, "dates", "ys", F.posexplode("turned").alias("fpos", "xs"))
        .select(
            *keys, F.concat(F.col(METRIC), F.lit("__"), F.get(labels, F.col("fpos"))).alias("feature"),
            *order, "fpos", "dates", "xs", "ys",
        )
    )


def unpack(columns: DataFrame, keys: Sequence[str] = (), *, y: bool = False) -> DataFrame:
    """Feature columns back to long rows `(keys, feature, date, value)`."""
    parts = ["dates", "xs", *(["ys"] if y else [])]
    return columns.select(*keys, "feature", F.explode(F.arrays_zip(*parts)).alias("p")).select(
        *keys, "feature", F.col("p.dates").alias(DATE), F.col("p.xs").alias(VALUE),
        *([F.col("p.ys").alias("y")] if y else []),
    )


def sum_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def with_stats(columns: DataFrame) -> DataFrame:
    """Add mean `__m`, deviations `__d` and their sum of squares `__s`."""
    return (
        columns.withColumn("__m", sum_of(F.col("xs")) / F.size("xs"))
        .withColumn("__d", F.transform("xs", lambda x: x - F.col("__m")))
        .withColumn("__s", sum_of(F.transform("__d", lambda d: d * d)))
    )


def impute(columns: DataFrame) -> DataFrame:
    """+inf to the largest, -inf to the least, missing to the median of the finite values of the
    feature; 0 where it has none."""
    inf = float("inf")
    finite = F.filter("xs", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(inf)))
    n = F.size("__f")
    middle = (F.get("__f", F.floor((n - 1) / 2).cast("int")) + F.get("__f", F.floor(n / 2).cast("int"))) / 2
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        columns.withColumn("__f", F.array_sort(finite))
        .withColumn("__fill", F.array(zero(F.get("__f", F.lit(0))), zero(middle), zero(F.get("__f", n - 1))))
        .withColumn("xs", F.transform(
            "xs",
            lambda x: F.when(x.isNull() | F.isnan(x), F.get("__fill", F.lit(1)))
            .when(x == inf, F.get("__fill", F.lit(2)))
            .when(x == -inf, F.get("__fill", F.lit(0)))
            .otherwise(x),
        ))
        .drop("__f", "__fill")
    )


def restrict_to_target(columns: DataFrame) -> DataFrame:
    """Keep the dates for which `y` is known (the inner join with the target)."""
    known = lambda x, i: F.get("ys", i).isNotNull()
    return columns.select(
        *[c for c in columns.columns if c not in ("dates", "xs", "ys")],
        F.filter("dates", known).alias("dates"), F.filter("xs", known).alias("xs"),
        F.filter("ys", lambda y: y.isNotNull()).alias("ys"),
    )


def standardise(columns: DataFrame) -> DataFrame:
    """(x - mean) / population deviation; a constant feature becomes 0."""
    scale = F.sqrt(F.col("__s") / F.size("xs"))
    scaled = (
        with_stats(columns)
        .withColumn("__k", F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(scale))
        .withColumn("xs", F.transform("__d", lambda d: d / F.col("__k")))
    )
    return scaled.drop("__m", "__d", "__s", "__k")


MISALIGNED = "features of one entity must share their dates; merge and fill the panel first"


def matrix(arrays) -> np.ndarray:
    """Arrays of one task as the rows of a matrix."""
    if len({len(a) for a in arrays}) > 1:
        raise ValueError(MISALIGNED)
    return np.stack(list(arrays))
