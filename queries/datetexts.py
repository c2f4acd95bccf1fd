"""Parsing dates spelled in many ways; the texts are made from the order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from macropanel.functions import dates

from .base import query, table

# The same expressions run in both engines, on (o_orderkey, y, m, d) with m and d two digits.
_PARTS = {
    "y": "lpad(cast(year(o_orderdate) as string), 4, '0')",
    "m": "lpad(cast(month(o_orderdate) as string), 2, '0')",
    "d": "lpad(cast(day(o_orderdate) as string), 2, '0')",
}
_BASE = "base as (select o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, " + ", ".join(
    f"{e} as {n}" for n, e in _PARTS.items()
) + " from orders)"
_KIND = "cast(substr(o_orderpriority, 1, 1) as int)"


def _texts(spark, sf_dir, text):
    parts = [F.expr(e).alias(n) for n, e in _PARTS.items()]
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", *parts)
    return base.withColumn("text", F.expr(text))


_YMD_TEXT = f"""case {_KIND} when 1 then y || m || d when 2 then ' ' || y || m || d || ' ' when 3 then y || m || d || '.0'
  when 4 then y || m || '32' else y || '-' || m || '-' || d end"""


@query("parse_ymd", f"""
with {_BASE}, texts as (select o_orderkey, o_orderpriority, {_YMD_TEXT} as text, cast(o_orderdate as date) as day from base)
select o_orderkey, text, case when {_KIND} in (1, 2) then day end as date from texts""")
def parse_ymd(spark, sf_dir):
    out = _texts(spark, sf_dir, _YMD_TEXT)
    return out.select("o_orderkey", "text", dates.parse_ymd(F.col("text")).alias("date"))


_CN_TEXT = f"""case {_KIND} when 1 then y || m when 2 then y || '年' || m || '月份' when 3 then y || '年第' ||
  cast(quarter(o_orderdate) as string) || '季度' when 4 then y || '年' else y || '-' || m || '-' || d end"""


@query("parse_chinese", f"""
with {_BASE}, texts as (select *, {_CN_TEXT} as text, cast(o_orderdate as date) as day from base)
select o_orderkey, text, cast(case {_KIND} when 1 then date_trunc('month', day) when 2 then date_trunc('month', day)
  when 3 then date_trunc('quarter', day) when 4 then null else day end as date) as date from texts""")
def parse_chinese(spark, sf_dir):
    out = _texts(spark, sf_dir, _CN_TEXT)
    return out.select("o_orderkey", "text", dates.parse_chinese(F.col("text")).alias("date"))


_CODED_TEXT = f"""case {_KIND} when 1 then y || m when 2 then y || 'Q' || cast(quarter(o_orderdate) as string)
  when 3 then y || m || d when 4 then y || '/' || m || '/' || d else 'none' end"""
_CODE = f"case {_KIND} when 1 then 'month' when 2 then 'quarter' when 3 then 'trade_date' else 'month' end"


@query("parse_quarter", f"""
with {_BASE}, texts as (select *, {_CODED_TEXT} as text, {_CODE} as code, cast(o_orderdate as date) as day from base)
select o_orderkey, text, code, cast(case {_KIND} when 1 then date_trunc('month', day) when 2 then date_trunc('quarter', day)
  when 3 then day when 4 then day end as date) as date from texts""")
def parse_quarter(spark, sf_dir):
    out = _texts(spark, sf_dir, _CODED_TEXT).withColumn("code", F.expr(_CODE))
    return out.select("o_orderkey", "text", "code", dates.parse_coded(F.col("text"), F.col("code")).alias("date"))


_GENERIC_TEXT = f"""case {_KIND} when 1 then y || '-' || m || '-' || d || ' 08:30:00' when 2 then y || '/' || cast(month(o_orderdate) as string)
  || '/' || cast(day(o_orderdate) as string) when 3 then m || '/' || d || '/' || y when 4 then y || m else y || '-' || m end"""


@query("parse_generic", f"""
with {_BASE}, texts as (select *, {_GENERIC_TEXT} as text from base)
select o_orderkey, text, cast(coalesce(try_strptime(text, '%Y-%m-%d %H:%M:%S'), try_strptime(text, '%Y/%m/%d'),
  try_strptime(text, '%m/%d/%Y'), case when length(text) = 7 then try_strptime(text || '-01', '%Y-%m-%d') end) as date) as date from texts""")
def parse_generic(spark, sf_dir):
    out = _texts(spark, sf_dir, _GENERIC_TEXT)
    return out.select("o_orderkey", "text", dates.parse_generic(F.col("text")).alias("date"))


_ISO_TEXT = f"case {_KIND} when 1 then y || '-' || m || '-' || d when 2 then y || '-' || m || '-' || d || 'T00:00:00' else y || m end"


@query("parse_iso", f"""
with {_BASE}, texts as (select *, {_ISO_TEXT} as text, cast(o_orderdate as date) as day from base)
select o_orderkey, text, case when {_KIND} in (1, 2) then day end as date from texts""")
def parse_iso(spark, sf_dir):
    out = _texts(spark, sf_dir, _ISO_TEXT)
    return out.select("o_orderkey", "text", dates.parse_iso(F.col("text")).alias("date"))


_CN_DAY_TEXT = "case o_orderstatus when 'O' then y || '年' || m || '月' when 'F' then y || '年' || m || '月' || d || '日' else y || '年' end"


@query("parse_chinese_days", f"""
with {_BASE}, texts as (select *, {_CN_DAY_TEXT} as text from base)
select o_orderkey, text, cast(coalesce(try_strptime(text, '%Y年%m月'), try_strptime(text, '%Y年%m月%d日')) as date) as date from texts""")
def parse_chinese_days(spark, sf_dir):
    out = _texts(spark, sf_dir, _CN_DAY_TEXT)
    text = F.col("text")
    return out.select("o_orderkey", "text", F.coalesce(dates.parse_cn_month(text), dates.parse_cn_day(text)).alias("date"))


# One column per customer; its style depends on all of its cells.
_COLUMN_TEXT = """case substr(c_mktsegment, 1, 1) when 'A' then y || '-' || m || '-' || d when 'B' then
  case when o_orderstatus = 'P' then y || '-' || m || '-' || d else y || m || d end
  when 'F' then y || '年' || m || '月' when 'H' then case when o_orderstatus <> 'P' then y || '-' || m || '-' || d end
  else substr(y, 3, 2) || '-' || {month_name} end"""
_NAMES = "case m " + " ".join(
    f"when '{i:02d}' then '{n}'" for i, n in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)
) + " end"
_COLUMN_TEXT = _COLUMN_TEXT.format(month_name=_NAMES)


@query("parse_by_column", f"""
with base as (select o_custkey, o_orderkey, o_orderstatus, c_mktsegment, cast(o_orderdate as date) as day,
    {', '.join(f'{e} as {n}' for n, e in _PARTS.items())} from orders join customer on o_custkey = c_custkey),
texts as (select *, {_COLUMN_TEXT} as text from base),
styles as (select o_custkey,
    case when bool_and(regexp_matches(coalesce(text, 'nan'), '^\\d{{2}}-[A-Za-z]{{3}}')) then 'dd_mon'
      when bool_and(regexp_matches(coalesce(text, 'nan'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) then 'iso'
      when bool_or(regexp_matches(coalesce(text, 'nan'), '^\\d{{8}}$')) then 'ymd'
      when bool_and(text is null) then 'ymd'
      when bool_or(regexp_matches(coalesce(text, 'nan'), '^\\d{{4}}年\\d{{1,2}}月')) then 'cn' else 'generic' end as style
  from texts group by o_custkey)
select o_orderkey, text, style, cast(case style when 'dd_mon' then try_strptime(text, '%y-%b')
  when 'ymd' then case when length(text) = 8 then try_strptime(text, '%Y%m%d') end
  when 'cn' then try_strptime(text, '%Y年%m月') else try_strptime(text, '%Y-%m-%d') end as date) as date
from texts join styles using (o_custkey)""")
def parse_by_column(spark, sf_dir):
    parts = [F.expr(e).alias(n) for n, e in _PARTS.items()]
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    texts = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_custkey", "o_orderkey", "o_orderstatus", "c_mktsegment", *parts)
        .withColumn("text", F.expr(_COLUMN_TEXT))
    )
    styles = texts.groupBy("o_custkey").agg(dates.column_style(F.col("text")).alias("style"))
    return texts.join(styles, "o_custkey").select(
        "o_orderkey", "text", "style", dates.parse_by_style(F.col("text"), F.col("style")).alias("date")
    )
