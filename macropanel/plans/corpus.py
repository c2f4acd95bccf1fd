"""From a corpus of sheets to long rows: automatic and declared detection.

Detection works on landed rows in few passes: the first rows of each sheet, the cells of
sheets whose date column has no known name, one pass that counts per column, one over the
dates of sheets without a stated frequency, and the final one. What a pass finds is one row
per sheet and is written down, so that no later step repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..config import DATE, DATE_KEYWORDS, DECLARED_DATE_KEYWORDS, FREQ, METRIC, POS, TABLE, VALUE
from ..functions import dates
from ..functions.values import num
from ..operators import profile
from ..operators.frequency import detect_frequency
from ..session import cut_lineage


class Corpus(NamedTuple):
    """Result of parsing a corpus."""

    profiles: DataFrame  # (path, date_col, date_idx, data_cols, freq, unit, metadata_rows, rows)
    long: DataFrame      # (table, metric, pos, date, value, raw_null, freq)
    rejects: DataFrame   # (path, reason)


def auto_parse(
    rows: DataFrame,
    *,
    fix_headers: bool = True,
    free_dates: bool = True,
    require_numeric: bool = True,
    numeric_share: float = 0.5,
) -> Corpus:
    """Find header, date column, metadata, numeric columns and frequency of every sheet.

    The strict variant for vendor exports (`fix_headers=False, free_dates=False,
    require_numeric=False`) takes names and `YYYYMMDD` dates as they are and accepts
    sheets without a numeric column.
    """
    headers = profile.fixed_headers(rows) if fix_headers else profile.plain_headers(rows)
    headers = cut_lineage(headers)
    metadata = profile.sheet_metadata(rows, headers)
    found = cut_lineage(
        headers.join(metadata, "path", "left")
        .fillna({"metadata_rows": 0, FREQ: "unknown"})
        .join(profile.date_column(rows, headers, metadata), "path", "left")
    )
    # Free parsing only in sheets in which no cell at all is YYYYMMDD, so both are counted.
    ymd = dates.parse_ymd(F.col("__text"))
    free = dates.parse_generic(F.col("__text")) if free_dates else F.lit(None).cast("date")
    stats = (
        profile.data_rows(rows, found.filter("date_idx is not null"))
        .withColumn("__text", F.get("cells", F.col("date_idx")))
        .select("path", ymd.isNotNull().alias("a"), free.isNotNull().alias("b"), F.posexplode("cells").alias("col", "cell"))
        .withColumn("number", num(F.col("cell")).isNotNull())
        .groupBy("path", "col")
        .agg(
            F.count_if("a").alias("rows_a"), F.count_if("b").alias("rows_b"),
            F.count_if(F.col("a") & F.col("number")).alias("num_a"),
            F.count_if(F.col("b") & F.col("number")).alias("num_b"),
        )
        .groupBy("path")
        .agg(
            F.max("rows_a").alias("rows_a"), F.max("rows_b").alias("rows_b"),
            F.array_sort(F.collect_list(F.struct("col", "num_a", "num_b"))).alias("counts"),
        )
        .withColumn("style", F.when(F.col("rows_a") > 0, "padded_ymd").otherwise("generic"))
        .withColumn("rows", F.when(F.col("rows_a") > 0, F.col("rows_a")).otherwise(F.col("rows_b")))
    )
    hits = lambda c: F.when(F.col("style") == "padded_ymd", c["num_a"]).otherwise(c["num_b"])
    numeric = F.transform(
        F.filter("counts", lambda c: hits(c) >= numeric_share * F.greatest("rows", F.lit(1))), lambda c: c["col"]
    )
    described = found.join(stats.select("path", "style", "rows", numeric.alias("numeric")), "path", "left")
    wanted = F.col("numeric")
    return _finish(rows, described, wanted, require_numeric=require_numeric)


def declared_parse(
    rows: DataFrame,
    freq: str | None = None,
    keywords: Sequence[str] = DECLARED_DATE_KEYWORDS,
) -> Corpus:
    """Sheets with a plain header: date column by keyword, one date style per column, all other
    columns kept. Without `freq` the frequency comes from the dates."""
    named = profile.date_column_by_keyword(profile.header_cells(rows), keywords)
    found = cut_lineage(
        profile.plain_headers(rows).join(named, "path", "left").select(
            "*", F.lit(0).alias("metadata_rows"), F.lit(freq or "unknown").alias(FREQ),
            F.lit(None).cast("string").alias("unit"),
        )
    )
    style = (
        profile.data_rows(rows, found.filter("date_idx is not null"))
        .select("path", F.get("cells", F.col("date_idx")).alias("__text"))
        .groupBy("path")
        .agg(dates.column_style(F.col("__text")).alias("style"), F.count(F.lit(1)).alias("rows"))
    )
    every = F.sequence(F.lit(0), F.size("names") - 1)
    return _finish(rows, found.join(style, "path", "left"), every, require_numeric=False)


def load_parse(rows: DataFrame, keywords: Sequence[str] = DATE_KEYWORDS) -> Corpus:
    """The directory load: as `declared_parse` with the long keyword list and detected frequency."""
    return declared_parse(rows, None, keywords)


def dated_rows(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Data rows with a date that parses in the style of their sheet; `(path, date, cells, ...)`."""
    below = profile.data_rows(rows, described.filter("date_idx is not null"))
    date = dates.parse_by_style(F.get("cells", F.col("date_idx")), F.col("style"))
    return dates.with_date(below, date, DATE)


def _finish(rows, described, wanted, *, require_numeric):
    # Of equal names the first one counts.
    is_first = lambda i: F.array_position("names", F.get("names", i)) == i + 1
    kept = F.filter(wanted, lambda i: (i != F.col("date_idx")) & is_first(i))
    described = described.withColumn("data_idx", F.coalesce(kept, F.array().cast("array<int>")))
    open_sheets = described.filter(F.col(FREQ) == "unknown")
    seen = detect_frequency(dated_rows(rows, open_sheets).select("path", DATE), ["path"])
    enough = F.size("data_idx") > 0 if require_numeric else F.lit(True)
    profiles = cut_lineage(
        described.join(seen.withColumnRenamed(FREQ, "seen"), "path", "left")
        .withColumn(FREQ, F.coalesce(F.nullif(FREQ, F.lit("unknown")), "seen", F.lit("unknown")))
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .withColumn("ok", F.col("date_idx").isNotNull() & enough)
    )
    good = profiles.filter("ok")
    reason = F.when(F.col("date_idx").isNull(), "no date column found").otherwise("no numeric data columns found")
    long = (
        dated_rows(rows, good)
        .select("path", DATE, "cells", "names", FREQ, F.explode("data_idx").alias(POS))
        .select(
            F.col("path").alias(TABLE), F.get("names", F.col(POS)).alias(METRIC), POS, DATE,
            F.get("cells", F.col(POS)).alias("__text"), FREQ,
        )
        .select(
            TABLE, METRIC, POS, DATE, num(F.col("__text")).alias(VALUE),
            F.col("__text").isNull().alias("raw_null"), FREQ,
        )
    )
    return Corpus(
        good.select(
            "path", F.get("names", F.col("date_idx")).alias("date_col"), "date_idx",
            F.transform("data_idx", lambda i: F.get("names", i)).alias("data_cols"),
            FREQ, "unit", "metadata_rows", "rows",
        ),
        long,
        profiles.filter("not ok").select("path", reason.alias("reason")),
    )
