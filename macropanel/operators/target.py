"""Joining features with the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..config import DATE


def join_target(long: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inner join on entity and date: only periods known on both sides stay."""
    return long.join(target, [*keys, DATE], "inner")


def attach_target(long: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Left join: `y` is NULL where the target has no such period."""
    return long.join(target, [*keys, DATE], "left")


def outer_concat(wide: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full outer join of a wide panel and the target on entity and date."""
    return wide.join(target, [*keys, DATE], "full_outer")
