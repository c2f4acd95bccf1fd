"""Profiling a corpus of sheets: header repair, date column, metadata rows, numeric columns.

A corpus is `(path, row, cells array<string>)`; row 0 is the header and every row has one
cell per header cell (NULL for an empty one). Each step handles all sheets in one job, and
what it finds is one small row per sheet that is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import (
    DATE_KEYWORDS, FREQ_CODES, FREQ_LABEL, SHEET_DATE_NAMES, UNIT_LABEL, VENDOR_DATE_COL,
)
from ..functions import dates
from ..functions.values import NUMBER, num

BLANK = ("", "nan", "None")


def header_cells(rows: DataFrame) -> DataFrame:
    """`(path, col, name)` of the header rows."""
    return rows.filter("row = 0").select("path", F.posexplode("cells").alias("col", "name"))


def date_column_by_keyword(headers: DataFrame, keywords: Sequence[str] = DATE_KEYWORDS) -> DataFrame:
    """`(path, date_idx)`: first column whose name contains a keyword, ignoring case."""
    name = F.lower(F.trim("name"))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(name, F.lit(word.lower()))
    return headers.filter(hit).groupBy("path").agg(F.min("col").alias("date_idx"))


def is_default_name(name: Column) -> Column:
    """Names a reader makes up: missing, `Unnamed: N`, or a bare number."""
    s = F.trim(name)
    return (
        name.isNull() | (s == "") | s.startswith("Unnamed:") | s.rlike(NUMBER)
        | s.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    )


def fixed_headers(rows: DataFrame) -> DataFrame:
    """`(path, names, offset)`: repaired column names of each sheet.

    More than half made-up names: all names come from the first data row, which is then no
    data (`offset` 1). Some: only those are replaced and the row stays. Names still blank
    become `col_{i}`.
    """
    first = rows.filter("row <= 1").groupBy("path").agg(
        F.max(F.when(F.col("row") == 0, F.col("cells"))).alias("head"),
        F.max(F.when(F.col("row") == 1, F.col("cells"))).alias("lead"),
    )
    defaults = F.size(F.filter("head", is_default_name))
    has_row = F.col("lead").isNotNull()
    most = has_row & (defaults > F.floor(F.size("head") / 2))

    def repaired(name, i):
        text = F.trim(F.get(F.col("lead"), i))
        filled = F.when(text.isNull() | text.isin(*BLANK), F.concat(F.lit("col_"), i.cast("string"))).otherwise(text)
        replace = F.col("most") | (F.col("some") & is_default_name(name))
        unnamed = F.concat(F.lit("Unnamed: "), i.cast("string"))
        kept = F.when(name.isNull() | (F.trim(name) == ""), unnamed).otherwise(name)
        return F.when(replace, filled).otherwise(kept)

    return (
        first.filter(F.col("head").isNotNull())
        .select("path", "head", "lead", most.alias("most"), (has_row & (defaults > 0)).alias("some"))
        .select("path", F.transform("head", repaired).alias("names"), F.col("most").cast("int").alias("offset"))
    )


def plain_headers(rows: DataFrame) -> DataFrame:
    """`(path, names, offset)` with the names as they are."""
    return rows.filter("row = 0").select("path", F.col("cells").alias("names"), F.lit(0).alias("offset"))


def first_of_duplicates(headers: DataFrame) -> DataFrame:
    """Of columns with one name in a sheet keep the first."""
    w = Window.partitionBy("path", "name").orderBy("col")
    return headers.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _labels(cells: Column, labels: Sequence[str]) -> Column:
    return F.exists(cells, lambda v: F.coalesce(F.trim(v).isin(*labels), F.lit(False)))


def _leading_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The first three data rows of each sheet as sorted structs `(r, cells)`."""
    return (
        rows.filter("row between 1 and 4")
        .join(headers.select("path", "offset"), "path")
        .withColumn("r", (F.col("row") - F.col("offset")).cast("int"))
        .filter("r between 1 and 3")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("top"))
    )


def sheet_metadata(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """`(path, metadata_rows, freq, unit)` from the first three data rows.

    metadata_rows: how many leading rows hold a frequency or unit label. freq: the first
    frequency code in a row with the frequency label. unit: the cell after the unit label,
    else the first cell of that row that is no label and no code.
    """
    codes = F.create_map(*[F.lit(x) for pair in FREQ_CODES.items() for x in pair])
    first_plain = F.coalesce(
        F.array_position(
            F.transform("top", lambda t: _labels(t["cells"], (FREQ_LABEL, UNIT_LABEL))), F.lit(False)
        ),
        F.lit(0),
    )
    leading = F.when(first_plain == 0, F.size("top")).otherwise(first_plain - 1).cast("int")

    def freq_of(t):
        found = F.filter(t["cells"], lambda v: F.trim(v).isin(*FREQ_CODES))
        return F.when(_labels(t["cells"], (FREQ_LABEL,)), F.element_at(codes, F.trim(F.get(found, F.lit(0)))))

    def unit_of(t):
        trimmed = F.transform(t["cells"], lambda v: F.coalesce(F.trim(v), F.lit("")))
        after = F.get(trimmed, F.array_position(trimmed, F.lit(UNIT_LABEL)).cast("int"))
        other = F.filter(
            trimmed,
            lambda v: ~v.isin(UNIT_LABEL, FREQ_LABEL, VENDOR_DATE_COL, *FREQ_CODES, *BLANK),
        )
        good = F.when(~after.isin(*BLANK), after)
        return F.when(_labels(t["cells"], (UNIT_LABEL,)), F.coalesce(good, F.get(other, F.lit(0))))

    first_known = lambda f: F.get(F.array_compact(F.transform("top", f)), F.lit(0))
    return _leading_rows(rows, headers).select(
        "path",
        leading.alias("metadata_rows"),
        F.coalesce(first_known(freq_of), F.lit("unknown")).alias("freq"),
        first_known(unit_of).alias("unit"),
    )


def data_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows below header and metadata; `found` has `(path, offset, metadata_rows, ...)`."""
    return rows.filter("row > 0").join(found, "path").filter("row > offset + metadata_rows")


def date_column_by_content(rows: DataFrame, found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`(path, date_idx)`: first column most of whose cells read as dates, at least two different.

    Cells with only blanks do not count; missing cells count as cells that do not parse. A
    style is accepted on its own share. Free parsing is tried only where most cells have a
    date separator, so that plain numbers are never taken for dates. When metadata rows
    leave fewer than two rows, they are counted as data.
    """
    text = F.col("text")
    styles = {
        "ymd": dates.parse_ymd(text),
        "cn_month": dates.parse_cn_month(text),
        "cn_day": dates.parse_cn_day(text),
        "generic": F.when(text.rlike(dates.DATE_LIKE), dates.parse_generic(text)),
    }
    # Least and largest date tell whether two differ, without a distinct count.
    first = [F.count(F.lit(1)).alias("n"), F.count_if(text.rlike(dates.DATE_LIKE)).alias("date_like")]
    again = [F.sum("n").alias("n"), F.sum("date_like").alias("date_like")]
    for s in styles:
        first += [F.count(s).alias(f"n_{s}"), F.min(s).alias(f"lo_{s}"), F.max(s).alias(f"hi_{s}")]
        again += [F.sum(f"n_{s}").alias(f"n_{s}"), F.min(f"lo_{s}").alias(f"lo_{s}"), F.max(f"hi_{s}").alias(f"hi_{s}")]
    stats = (
        rows.filter("row > 0").join(found.select("path", "offset", "metadata_rows"), "path")
        .filter("row > offset")
        .select("path", F.posexplode("cells").alias("col", "cell"), F.expr("row > offset + metadata_rows").alias("below"))
        .select("path", "col", "below", F.coalesce(F.trim("cell"), F.lit("nan")).alias("text"))
        .filter("text != ''")
        .select("*", *[c.alias(s) for s, c in styles.items()])
        .groupBy("path", "col", "below").agg(*first)
    )
    # Sheets too short once metadata rows are skipped are judged on all their rows.
    size = rows.filter("row > 0").groupBy("path").agg(F.max("row").alias("last"))
    short = size.join(found, "path").select(
        "path", F.expr("last - offset - metadata_rows < 2").alias("short")
    )
    merged = stats.join(short, "path").filter("below or short").groupBy("path", "col").agg(*again)
    passes = F.lit(False)
    for s in styles:
        ok = (F.col(f"n_{s}") / F.col("n") >= threshold) & (F.col(f"lo_{s}") < F.col(f"hi_{s}"))
        if s == "generic":
            ok = ok & (F.col("date_like") / F.col("n") >= threshold)
        passes = passes | F.coalesce(ok, F.lit(False))
    return merged.filter((F.col("n") >= 2) & passes).groupBy("path").agg(F.min("col").alias("date_idx"))


def date_column(rows: DataFrame, headers: DataFrame, metadata: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`(path, date_idx)`: the vendor's date name, else another known name, else by content."""
    where = lambda f: F.array_position(F.transform("names", f), F.lit(True)) - 1
    exact = where(lambda v: F.coalesce(v == VENDOR_DATE_COL, F.lit(False)))
    known = where(lambda v: F.coalesce(v.isin(*SHEET_DATE_NAMES), F.lit(False)))
    named = headers.select(
        "path", F.when(exact >= 0, exact).when(known >= 0, known).cast("int").alias("by_name")
    )
    found = headers.select("path", "offset").join(metadata, "path", "left").fillna({"metadata_rows": 0})
    # Only sheets without a known name are scanned for their content.
    open_sheets = found.join(named.filter("by_name is null").select("path"), "path", "left_semi")
    by_content = date_column_by_content(rows, open_sheets, threshold)
    return (
        named.join(by_content, "path", "left")
        .select("path", F.coalesce("by_name", "date_idx").alias("date_idx"))
        .filter("date_idx is not null")
    )


def numeric_columns(dated: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`(path, col)` of columns at least half of whose cells are numbers.

    `dated` is `(path, date_idx, date, cells)`; the date column is left out.
    """
    return (
        dated.select("path", "date_idx", F.posexplode("cells").alias("col", "cell"))
        .filter("col != date_idx")
        .groupBy("path", "col")
        .agg(F.avg(num(F.col("cell")).isNotNull().cast("int")).alias("share"))
        .filter(F.col("share") >= threshold)
        .select("path", "col")
    )
