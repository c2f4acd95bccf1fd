"""Date parsing expressions: text column in, DATE out, NULL where it does not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# `%Y%m%d` as a strptime pattern reads it: month and day may have one digit.
YMD = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"

ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
DD_MON = r"^\d{2}-[A-Za-z]{3}"
EIGHT_DIGITS = r"^\d{8}$"
CN_MONTH_PREFIX = r"^\d{4}年\d{1,2}月"
DATE_LIKE = r"[-/年月]"


def with_date(df: DataFrame, date: Column, name: str) -> DataFrame:
    """Add a parsed date and drop the rows without one.

    The date is handed over by a generator, which runs the parser once per row; a filter on a
    plain column would be rewritten to run it again for every condition on the date.
    """
    return df.select("*", F.explode(F.array_compact(F.array(date))).alias(name))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, month, day)
    return F.when((year != "") & (month != "") & (day != ""), F.try_to_date(text, "yyyy-M-d"))


def parse_ymd(text: Column) -> Column:
    """`YYYYMMDD` after trimming; anything else is NULL."""
    s = F.trim(text)
    return _ymd(*(F.regexp_extract(s, YMD, g) for g in (1, 2, 3)))


def parse_cn_month(text: Column) -> Column:
    """`2026年1月` or `2026年01月`."""
    return F.when(text.rlike(r"^\d{4}年\d{1,2}月$"), F.try_to_date(text, "yyyy年M月"))


def parse_cn_day(text: Column) -> Column:
    """`2026年1月5日`."""
    return F.when(text.rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$"), F.try_to_date(text, "yyyy年M月d日"))


def parse_dd_mon(text: Column) -> Column:
    """`23-Jan`: two-digit year (69 to 99 lie in the last century) and month name."""
    century = F.when(F.substring(text, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    full = F.concat(century, F.substring(text, 1, 3), F.initcap(F.substring(text, 4, 3)))
    return F.when(text.rlike(r"^\d{2}-[A-Za-z]{3}$"), F.try_to_date(full, "yyyy-MMM"))


def parse_quarter(text: Column) -> Column:
    """`2026Q1`: first day of the quarter."""
    quarter = F.regexp_extract(text, r"^(\d{4})Q([1-4])$", 2)
    month = F.when(quarter != "", quarter.try_cast("int") * 3 - 2).cast("string")
    return F.try_to_date(F.concat_ws("-", F.substring(text, 1, 4), month, F.lit("1")), "yyyy-M-d")


def parse_generic(text: Column) -> Column:
    """The spellings a free date parser reads, always with a four-digit year.

    A fixed list instead of a bare cast: a cast would read `201501` as the year 201501.
    """
    s = F.trim(text)
    day = F.regexp_extract(s, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})([ T]\d{1,2}:.*)?$", 1)
    return F.coalesce(
        F.when(day != "", F.try_to_date(F.translate(day, "/", "-"), "yyyy-M-d")),
        F.when(s.rlike(r"^\d{4}[-/]\d{1,2}$"), F.try_to_date(F.translate(s, "/", "-"), "yyyy-M")),
        F.when(s.rlike(EIGHT_DIGITS), F.try_to_date(s, "yyyyMMdd")),
        parse_cn_month(s),
        parse_cn_day(s),
        F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "M/d/yyyy")),
        F.when(s.rlike(r"^[A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(s), "MMM yyyy")),
        F.when(s.rlike(r"^\d{4}Q[1-4]$"), parse_quarter(s)),
        F.when(s.rlike(r"^\d{4}$"), F.try_to_date(s, "yyyy")),
    )


def parse_iso(text: Column) -> Column:
    """Reread of a date written by this engine: ISO day, any time part dropped."""
    day = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})([ T].*)?$", 1)
    return F.when(day != "", F.try_to_date(day, "yyyy-MM-dd"))


def parse_chinese(text: Column) -> Column:
    """Vendor dates such as `201501`, `2026年04月份`, `2026年第1季度`; a bare `2026年` is NULL."""
    s = F.trim(text)
    month = F.regexp_extract(s, r"^(\d{4})(\d{2})$", 2)
    cn_month = F.regexp_extract(s, r"^(\d{4})年(\d{2})月份", 2)
    quarter = F.regexp_extract(s, r"^(\d{4})年第(\d)季度", 2)
    first_month = (quarter.try_cast("int") * 3 - 2).cast("string")
    year = F.substring(s, 1, 4)
    one = F.lit("1")
    return (
        F.when(month != "", F.try_to_date(F.concat_ws("-", year, month, one), "yyyy-M-d"))
        .when(cn_month != "", F.try_to_date(F.concat_ws("-", year, cn_month, one), "yyyy-M-d"))
        .when(quarter != "", F.try_to_date(F.concat_ws("-", year, first_month, one), "yyyy-M-d"))
        .when(s.rlike(r"^\d{4}年$"), F.lit(None).cast("date"))
        .otherwise(parse_generic(s))
    )


def parse_coded(text: Column, code: Column) -> Column:
    """Vendor dates whose shape is told by the date column's name.

    `month`/`quarter`: `YYYYMM` or `YYYYQn`; `date`/`trade_date`: `YYYYMMDD`; else generic.
    """
    s = F.trim(text)
    periodic = code.isin("month", "quarter")
    month = F.try_to_date(
        F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.lit("1")), "yyyy-M-d"
    )
    return (
        F.when(periodic & s.rlike(r"^\d{6}$"), month)
        .when(periodic & s.rlike(r"^\d{4}Q\d$"), parse_quarter(s))
        .when(code.isin("date", "trade_date") & s.rlike(EIGHT_DIGITS), F.try_to_date(s, "yyyyMMdd"))
        .otherwise(parse_generic(s))
    )


# --- one style per column -------------------------------------------------------------

def column_style(text: Column) -> Column:
    """Aggregate: the parse style a whole date column gets, decided once per group.

    A missing cell reads as the text `nan`, so one missing cell rules out both
    styles that ask for every value to match.
    """
    from .values import num

    s = F.coalesce(text, F.lit("nan"))
    return (
        F.when(F.bool_and(s.rlike(DD_MON)), F.lit("dd_mon"))
        .when(F.bool_and(s.rlike(ISO_PREFIX)), F.lit("iso"))
        .when(F.bool_or(s.rlike(EIGHT_DIGITS)), F.lit("ymd"))
        .when(F.bool_and(text.isNull() | num(text).isNotNull()), F.lit("ymd"))
        .when(F.bool_or(s.rlike(CN_MONTH_PREFIX)), F.lit("cn"))
        .otherwise(F.lit("generic"))
    )


def parse_by_style(text: Column, style: Column) -> Column:
    """Parse with the style `column_style` chose."""
    cn = F.coalesce(
        parse_cn_day(text),
        parse_generic(F.replace(F.replace(text, F.lit("年"), F.lit("-")), F.lit("月"), F.lit(""))),
    )
    return (
        F.when(style == "dd_mon", parse_dd_mon(text))
        .when(style == "ymd", F.when(text == F.trim(text), parse_ymd(text)))
        .when(style == "padded_ymd", parse_ymd(text))
        .when(style == "cn", cn)
        .otherwise(parse_generic(text))
    )
