"""Numbers, names, and the choice of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from macropanel.config import PanelConfig
from macropanel.functions import values
from macropanel.operators import clean, profile
from macropanel.operators.longform import to_long
from macropanel.operators.merge import prefix_metrics, suffix_metrics
from macropanel.operators.resample import month_end_mean, resample_monthly
from macropanel.plans.training import monthly_target

from .base import LINEITEM_LONG, MEAN, ORDERS_BY_PRIORITY, lineitem_long, orders_by_priority, query, table

NUMBER_SQL = r"'^\s*[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?\s*$'"


def num_sql(text: str) -> str:
    return (
        f"case when regexp_full_match({text}, {NUMBER_SQL}) then try_cast({text} as double) "
        f"when regexp_full_match(lower(trim({text})), '[+]?inf(inity)?') then 'inf'::double "
        f"when regexp_full_match(lower(trim({text})), '-inf(inity)?') then '-inf'::double end"
    )


# One spelling per part, good and bad ones.
_SPELLINGS = (
    "case p_size % 12 when 0 then cast(p_size as string) when 1 then concat(' ', cast(p_size as string), ' ') "
    "when 2 then concat(cast(p_size as string), 'd') when 3 then concat('1e', cast(p_size % 5 as string)) "
    "when 4 then '1,000' when 5 then p_type when 6 then '' when 7 then concat('-', cast(p_size as string), '.5') "
    "when 8 then '0x10' when 9 then 'True' when 10 then concat('.', cast(p_size as string)) else '1_0' end"
)


@query("numeric_coerce", f"""
with texts as (select p_partkey, {_SPELLINGS} as text from part)
select p_partkey, text, {num_sql('text')} as value from texts""")
def numeric_coerce(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPELLINGS).alias("text"))
    return texts.withColumn("value", values.num(F.col("text")))


@query("numeric_columns", f"""
with cells as (
  select p_brand as path, 1 as col, {_SPELLINGS} as cell from part
  union all select p_brand, 2, p_type from part union all select p_brand, 3, cast(p_size as string) from part
  union all select p_brand, 4, case when p_size % 2 = 0 then cast(p_size as string) end from part)
select path, col from cells group by path, col having avg(case when ({num_sql('cell')}) is not null then 1.0 else 0.0 end) >= 0.5""")
def numeric_columns(spark, sf_dir):
    sheets = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"), F.lit(0).alias("date_idx"),
        F.array(
            F.lit("2024"), F.expr(_SPELLINGS), F.col("p_type"), F.col("p_size").cast("string"),
            F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")),
        ).alias("cells"),
    )
    return profile.numeric_columns(sheets)


_GAPPY = """
with long as (
  select l_returnflag, 'quantity' as metric, cast(l_shipdate as date) as date, case when l_tax < 0.08 then l_quantity end as value from lineitem
  union all select l_returnflag, 'price', cast(l_shipdate as date), case when l_tax < 0.02 then l_extendedprice end from lineitem
  union all select l_returnflag, 'none', cast(l_shipdate as date), null from lineitem)"""


def _gappy(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate",
        F.when(F.col("l_tax") < 0.08, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_tax") < 0.02, F.col("l_extendedprice")).alias("price"),
        F.lit(None).cast("double").alias("none"),
    )
    return to_long(items, "l_shipdate", table="lineitem", keys=["l_returnflag"])


def _column_sums(long):
    return long.groupBy("l_returnflag", "metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query("drop_sparse", f"""{_GAPPY}
select l_returnflag, metric, count(*) as rows, cast(sum(cast(value as decimal(18,2))) as double) as total
from long group by l_returnflag, metric having count(*) filter (value is null) * 100.0 / count(*) < 20""")
def drop_sparse(spark, sf_dir):
    return _column_sums(clean.drop_sparse(_gappy(spark, sf_dir), ["l_returnflag"], threshold=20.0))


_NAN = """nan_long as (
  select 'tax' as metric, case when l_linenumber > 1 then l_tax end as value, last_day(l_shipdate) as date from lineitem
  union all select 'discount', case when l_linenumber < 7 then l_discount end, last_day(l_shipdate) from lineitem)"""


def _with_nan(spark, sf_dir):
    """Tax is no number in the first line of each order, discount in the seventh."""
    nan = F.lit(float("nan"))
    wide = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", F.when(F.col("l_linenumber") > 1, F.col("l_tax")).otherwise(nan).alias("tax"),
        F.when(F.col("l_linenumber") < 7, F.col("l_discount")).otherwise(nan).alias("discount"),
    )
    return to_long(wide, "l_shipdate", table="t", freq="monthly")


@query("drop_sparse_nan", f"""
with {_NAN} select metric, count(*) as rows, cast(sum(cast(value as decimal(18,2))) as double) as total
from nan_long group by metric having count(*) filter (value is null) * 100.0 / count(*) < 20""")
def drop_sparse_nan(spark, sf_dir):
    kept = clean.drop_sparse(_with_nan(spark, sf_dir), threshold=20.0)
    return kept.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("resample_sparse_nan", f"""
with {_NAN}, kept as (select metric from nan_long group by metric having count(*) filter (value is null) * 100.0 / count(*) < 20)
select metric, date, cast(sum(cast(value as decimal(18,2))) as double) / count(value) as value from nan_long semi join kept using (metric) group by metric, date""")
def resample_sparse_nan(spark, sf_dir):
    return resample_monthly(_with_nan(spark, sf_dir), missing_threshold=20.0, exact_scale=2).select("metric", "date", "value")


@query("drop_all_null", f"""{_GAPPY}
select l_returnflag, metric, count(*) as rows, cast(sum(cast(value as decimal(18,2))) as double) as total
from long group by l_returnflag, metric having count(value) > 0""")
def drop_all_null(spark, sf_dir):
    return _column_sums(clean.drop_all_null(_gappy(spark, sf_dir), ["l_returnflag"]))


# Every part brand is an indicator; some list columns it has, some only ones it lacks.
_LANDED = """landed as (
  select p_brand as id, 'size' as metric, cast(p_size as string) as text from part
  union all select p_brand, 'price', cast(p_retailprice as string) from part
  union all select p_brand, 'kind', p_type from part)"""


def _listed(brand):
    return (
        F.when(brand.endswith("1"), F.array(F.lit("size"), F.lit("weight")))
        .when(brand.endswith("2"), F.array(F.lit("kind")))
        .when(brand.endswith("3"), F.array(F.lit("weight")))
        .otherwise(F.array().cast("array<string>"))
    )


@query("column_subset_fallback", f"""
with {_LANDED},
catalog as (select distinct p_brand as id, case when p_brand like '%1' then ['size', 'weight']
  when p_brand like '%2' then ['kind'] when p_brand like '%3' then ['weight'] else [] end as columns from part),
columns_ as (select id, metric, bool_and(({num_sql('text')}) is not null) as numeric_ from landed group by all),
flagged as (select c.id, c.metric, numeric_, list_contains(g.columns, c.metric) as listed from columns_ c join catalog g using (id)),
kept as (select id, metric from (select *, bool_or(listed) over (partition by id) as any_listed from flagged)
  where case when any_listed then listed else numeric_ end)
select id, metric, count(*) as rows from landed semi join kept using (id, metric) group by all""")
def column_subset_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = F.array(
        F.struct(F.lit("size").alias("metric"), F.col("p_size").cast("string").alias("text")),
        F.struct(F.lit("price").alias("metric"), F.col("p_retailprice").cast("string").alias("text")),
        F.struct(F.lit("kind").alias("metric"), F.col("p_type").alias("text")),
    )
    landed = part.select(F.col("p_brand").alias("id"), F.explode(cells).alias("c")).select(
        "id", "c.metric", values.num(F.col("c.text")).alias("value"), F.col("c.text").isNull().alias("raw_null")
    )
    catalog = part.select(F.col("p_brand").alias("id")).distinct().withColumn("columns", _listed(F.col("id")))
    return clean.choose_columns(landed, catalog).groupBy("id", "metric").agg(F.count(F.lit(1)).alias("rows"))


@query("target_rename", f"""
with {LINEITEM_LONG}
select last_day(date) as date, {MEAN} as y from lineitem_long where metric = 'l_quantity' group by all""")
def target_rename(spark, sf_dir):
    monthly = month_end_mean(lineitem_long(spark, sf_dir), exact_scale=2)
    order = lineitem_long(spark, sf_dir).select("metric", "pos").distinct()
    return clean.target_series(monthly.join(order, "metric"), "y")


@query("target_by_name", f"""
with {LINEITEM_LONG}, last as (select max(date) as last_date from lineitem_long)
select last_day(date) as date, {MEAN} as y from lineitem_long, last where metric = 'l_discount'
  and (last_day(date) < last_day(last_date) or last_date = last_day(last_date)) group by all""")
def target_by_name(spark, sf_dir):
    return monthly_target(lineitem_long(spark, sf_dir), "l_discount", PanelConfig(exact_scale=2))


@query("prefix_suffix", f"""
with {ORDERS_BY_PRIORITY}
select 'order book_' || metric || '_日度' as metric, count(*) as rows from orders_long group by all""")
def prefix_suffix(spark, sf_dir):
    named = orders_by_priority(spark, sf_dir).withColumn("name", F.lit("order book"))
    return suffix_metrics(prefix_metrics(named)).groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query("snake_case_names", r"""
with names as (select p_partkey, ' ' || upper(p_name) || ' (' || p_brand || ')/' || p_type || '-' as name from part)
select p_partkey, name, trim(regexp_replace(lower(trim(name)), '[\s()\-./]+', '_', 'g'), '_') as clean from names""")
def snake_case_names(spark, sf_dir):
    name = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ("), "p_brand", F.lit(")/"), "p_type", F.lit("-"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("name"), values.clean_name(name).alias("clean")
    )


_NULLED = "case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end"


def _some_null_dates(spark, sf_dir):
    date = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", date.alias("date"), "o_totalprice")


@query("drop_null_dates", f"""
select o_orderkey, date from (select o_orderkey, {_NULLED} as date from orders) where date is not null""")
def drop_null_dates(spark, sf_dir):
    return clean.drop_null_dates(_some_null_dates(spark, sf_dir)).select("o_orderkey", "date")


@query("date_range", """
select o_orderkey, cast(o_orderdate as date) as date from orders
where o_orderdate >= timestamp '1996-03-01' and cast(o_orderdate as date) <= date '1997-09-30'""")
def date_range(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return clean.in_date_range(dated, "1996-03-01", "1997-09-30")


@query("tail_preview", f"""
select o_orderkey, date from (select o_orderkey, {_NULLED} as date from orders)
where date is not null order by date desc, o_orderkey desc limit 20""")
def tail_preview(spark, sf_dir):
    dated = clean.drop_null_dates(_some_null_dates(spark, sf_dir))
    return clean.tail_rows(dated, 20, ties=["o_orderkey"]).select("o_orderkey", "date")
