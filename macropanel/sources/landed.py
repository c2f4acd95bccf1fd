"""Vendor data that has landed as files: JSON answers and raw tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DATE, METRIC, POS, VALUE, VENDOR_DATE_COL
from ..functions import dates
from ..functions.values import num

_OBJECT_TABLES = (
    "errorcode int, errmsg string, code int, message string, "
    "tables array<struct<header: array<string>, table: array<array<string>>>>"
)
_PLAIN_TABLES = "header array<string>, tables array<array<string>>"


class Answers(NamedTuple):
    long: DataFrame    # (id, date, metric, pos, value)
    errors: DataFrame  # (id, reason)


def flatten_answers(landed: DataFrame, *, id_col: str = "id", payload: str = "payload") -> Answers:
    """Landed JSON answers to long rows.

    An answer is either `tables[0]` with `header` and `table`, or a two-dimensional `tables`
    with a top-level `header`. The first column is the date; rows whose date does not parse
    are dropped, other cells become numbers. Answers with an error code or without data
    are listed in `errors`.
    """
    a = F.from_json(payload, _OBJECT_TABLES)
    b = F.from_json(payload, _PLAIN_TABLES)
    first = F.get(F.col("a.tables"), F.lit(0))
    parsed = (
        landed.select(id_col, a.alias("a"), b.alias("b"))
        .select(
            id_col,
            F.coalesce(first["header"], F.col("b.header")).alias("header"),
            F.when(first["header"].isNotNull() | first["table"].isNotNull(), first["table"])
            .otherwise(F.col("b.tables")).alias("rows"),
            F.when(F.coalesce(F.col("a.errorcode"), F.lit(0)) != 0,
                   F.concat_ws(": ", F.col("a.errorcode").cast("string"), F.col("a.errmsg")))
            .when(F.coalesce(F.col("a.code"), F.lit(0)) != 0,
                  F.concat_ws(": ", F.col("a.code").cast("string"), F.col("a.message")))
            .alias("error"),
        )
    )
    some = (F.coalesce(F.size("header"), F.lit(0)) > 0) & (F.coalesce(F.size("rows"), F.lit(0)) > 0)
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~some, "empty answer")
    tagged = parsed.withColumn("reason", reason)
    cells = (
        tagged.filter("reason is null")
        .select(id_col, "header", F.explode("rows").alias("line"))
        .transform(dates.with_date, dates.parse_generic(F.get("line", F.lit(0))), DATE)
        .select(id_col, DATE, F.posexplode(F.arrays_zip("header", "line")).alias(POS, "c"))
        .filter(F.col(POS) > 0)
        .select(
            id_col, DATE, F.col("c.header").alias(METRIC), F.col(POS),
            num(F.col("c.line")).alias(VALUE), num(F.col("c.line")).isNull().alias("raw_null"),
        )
    )
    return Answers(cells, tagged.filter("reason is not null").select(id_col, "reason"))


def date_parser(policy: str, code: Column | None = None):
    """Text to date by vendor policy: `chinese` spellings, `coded` by the date column's name, `iso`."""
    if policy == "chinese":
        return dates.parse_chinese
    if policy == "iso":
        return dates.parse_iso
    if policy == "coded":
        return lambda text: dates.parse_coded(text, code)
    raise ValueError(f"unknown date policy {policy!r}")


def normalise_table(df: DataFrame, date_col: str, policy: str) -> DataFrame:
    """One raw vendor table: date column renamed to the vendor name and parsed, bad dates dropped.

    Row order is not kept; sort where the table is written.
    """
    if date_col not in df.columns:
        raise ValueError(f"date column {date_col!r} not found; columns are {df.columns}")
    parse = date_parser(policy, F.lit(date_col))
    renamed = [F.col(f"`{c}`") for c in df.columns if c != date_col]
    dated = dates.with_date(df, parse(F.col(f"`{date_col}`").cast("string")), "__date")
    return dated.select(F.col("__date").alias(VENDOR_DATE_COL), *renamed)


def normalise_landed(landed: DataFrame, policy: str, *, carry: Sequence[str] = ()) -> DataFrame:
    """All landed tables at once: `(id, raw_date, metric, pos, text)` to `(id, date, ..., value)`.

    `coded` dates need a `date_col` column that says what kind of date column the id has.
    """
    if policy == "coded":
        date = dates.parse_coded(F.col("raw_date"), F.col("date_col"))
    else:
        date = date_parser(policy)(F.col("raw_date"))
    return dates.with_date(landed, date, DATE).select(
        "id", *carry, DATE, METRIC, POS, num(F.col("text")).alias(VALUE), F.col("text").isNull().alias("raw_null")
    )
