"""Merging tables into a panel, and the whole runs built on it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from macropanel.config import PanelConfig
from macropanel.operators import clean, sequence, target
from macropanel.operators.longform import to_wide, union_long
from macropanel.operators.merge import merge_panel, suffix_metrics
from macropanel.operators.resample import resample_monthly
from macropanel.plans import catalog_merge as cm
from macropanel.plans.panel import merge_only, monthly_panel
from macropanel.plans.training import lagged_panel, monthly_target, train_simple, train_variance, wide_training
from macropanel.session import cut_lineage
from macropanel.sources import landed as vendor

from .base import (
    LINEITEM_LONG, MEAN, ORDERS_BY_PRIORITY, events_long, lineitem_long, orders_by_priority, query, table,
)

CFG = PanelConfig(exact_scale=2)
METRICS = [*(f"price_{i}_日度" for i in range(1, 6)), "l_quantity_月度", "l_extendedprice_月度", "l_discount_月度", "event_value_日度"]
ALIASES = [*(f"price_{i}" for i in range(1, 6)), "l_quantity", "l_extendedprice", "l_discount", "event_value"]


def three_tables(spark, sf_dir):
    return [orders_by_priority(spark, sf_dir), lineitem_long(spark, sf_dir), events_long(spark, sf_dir)]


def _months(name: str, trim: bool) -> str:
    """Months of each series from its first to its last, gaps included, maybe without a partial last one."""
    kept = "where date < last_day(last_date) or last_date = last_day(last_date)" if trim else ""
    return f"""{name}_all as (select metric, pos, last_day(date) as date, {MEAN} as value from {name}_long group by metric, pos, last_day(date)),
{name}_spine as (select metric, pos, last_day(cast(unnest(generate_series(date_trunc('month', min(date)),
    date_trunc('month', max(date)), interval 1 month)) as date)) as date from {name}_all group by metric, pos),
{name}_month as (select s.metric, s.pos, s.date, a.value from {name}_spine s left join {name}_all a using (metric, pos, date)
  join (select metric, max(date) as last_date from {name}_long group by metric) using (metric) {kept})"""


# Long monthly rows of the three tables.
MONTHLY = f"""{ORDERS_BY_PRIORITY}, {LINEITEM_LONG},
events_long as (select 'event_value' as metric, 0 as pos, cast(ts as date) as date, value from events),
{_months('orders', True)}, {_months('events', True)}, {_months('lineitem', False)},
monthly as (select 0 as t, * from orders_month union all select 1, * from lineitem_month union all select 2, * from events_month),
metrics as (select distinct 0 as t, pos, metric from orders_long union select 1, pos, metric from lineitem_long
  union select 2, pos, metric from events_long)"""

# Every metric at every date seen in some table.
PANEL = f"""{MONTHLY},
grid as (select t, pos, metric, date from metrics, (select distinct date from monthly)),
panel as (select t, pos, metric, date, value from grid left join monthly using (t, pos, metric, date)),
filled as (select t, pos, metric, date, coalesce(
    last_value(value ignore nulls) over (partition by metric order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by metric order by date rows between unbounded preceding and unbounded following)) as value
  from panel)"""


def _pivot(source: str, having: str = "") -> str:
    cells = ", ".join(f"max(value) filter (metric = '{m}') as {m}" for m in ALIASES)
    return f"select date, {cells} from {source} group by date {having}"


@query("outer_merge_panel", f"with {PANEL} {_pivot('panel')}")
def outer_merge_panel(spark, sf_dir):
    monthly = resample_monthly(union_long(three_tables(spark, sf_dir)), exact_scale=2)
    return to_wide(merge_panel(suffix_metrics(cut_lineage(monthly)), fill=False), METRICS, aliases=ALIASES)


@query("merge_fill", f"with {PANEL} {_pivot('filled')}")
def merge_fill(spark, sf_dir):
    panel = monthly_panel(three_tables(spark, sf_dir), CFG)
    return to_wide(panel, METRICS, aliases=ALIASES)


@query("run_merge_only", f"with {PANEL} {_pivot('filled')}")
def run_merge_only(spark, sf_dir):
    wide = merge_only(three_tables(spark, sf_dir), CFG, METRICS)
    return wide.toDF("date", *ALIASES)


@query("single_table_unfilled", f"""
with {ORDERS_BY_PRIORITY}, {_months('orders', True)}
select metric, date, value
from (select metric, date from (select distinct metric from orders_month), (select distinct date from orders_month))
left join orders_month using (metric, date)""")
def single_table_unfilled(spark, sf_dir):
    panel = monthly_panel([orders_by_priority(spark, sf_dir)], CFG)
    return panel.select(F.substring_index("metric", "_", 2).alias("metric"), "date", "value")


# --- several entities at once: each has its own tables, dates and fills -------------------

_SEGMENTS = f"""orders_raw as (
  select c_mktsegment as segment, 'price' as metric, cast(o_orderdate as date) as date, o_totalprice as value
  from orders join customer on o_custkey = c_custkey),
last as (select segment, max(date) as last_date from orders_raw group by segment),
items_raw as (
  select c_mktsegment as segment, 'quantity' as metric, cast(l_shipdate as date) as date, l_quantity as value
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
monthly as (
  select segment, metric, last_day(date) as date, {MEAN} as value from orders_raw join last using (segment)
  where last_day(date) < last_day(last_date) or last_date = last_day(last_date) group by all
  union all
  select segment, metric, last_day(date) as date, {MEAN} as value from items_raw group by all),
grid as (select segment, metric, date from (select distinct segment, metric from monthly) join (select distinct segment, date from monthly) using (segment)),
panel as (select segment, metric, date, value from grid left join monthly using (segment, metric, date)),
filled as (select segment, metric, date, coalesce(
    last_value(value ignore nulls) over (partition by segment, metric order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by segment, metric order by date rows between unbounded preceding and unbounded following)) as value
  from panel)"""


def segment_tables(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    items = table(spark, sf_dir, "lineitem")
    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    long = lambda df, name, pos, date, value, freq: df.select(
        F.col("c_mktsegment").alias("segment"), F.lit(name).alias("table"), F.lit(name).alias("metric"),
        F.lit(pos).alias("pos"), F.to_date(date).alias("date"), F.col(value).alias("value"),
        F.lit(False).alias("raw_null"), F.lit(freq).alias("freq"),
    )
    return [
        long(owned, "price", 0, "o_orderdate", "o_totalprice", "daily"),
        long(items.join(owned, F.col("l_orderkey") == F.col("o_orderkey")), "quantity", 0, "l_shipdate", "l_quantity", "monthly"),
    ]


@query("merge_fill_by_entity", f"with {_SEGMENTS} select segment, metric, date, value from filled")
def merge_fill_by_entity(spark, sf_dir):
    panel = monthly_panel(segment_tables(spark, sf_dir), replace(CFG, keys=("segment",)))
    return panel.select("segment", F.substring_index("metric", "_", 1).alias("metric"), "date", "value")


# --- joins with the target ----------------------------------------------------------------

TARGET = f"target as (select last_day(date) as date, {MEAN} as y from (select cast(l_shipdate as date) as date, l_tax as value from lineitem) group by all)"
TARGET_TRIMMED = f"""target as (select last_day(date) as date, {MEAN} as y
  from (select cast(l_shipdate as date) as date, l_tax as value from lineitem), (select cast(max(l_shipdate) as date) as last_date from lineitem)
  where last_day(date) < last_day(last_date) or last_date = last_day(last_date) group by all)"""
LAGGED = """lagged as (select t, pos, metric, date, lag(value) over (partition by metric order by date) as value from filled),
features as (select t, pos, metric, date, coalesce(first_value(value ignore nulls) over (
    partition by metric order by date rows between current row and unbounded following), 0.0::double) as value from lagged)"""


def tax_target(spark, sf_dir):
    """Mean tax of the month; the table is daily, so a last partial month is dropped."""
    from macropanel.operators.longform import to_long

    items = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ship"), "l_tax")
    return monthly_target(to_long(items, "ship", table="tax"), "y", CFG)


def lagged(spark, sf_dir):
    return lagged_panel(monthly_panel(three_tables(spark, sf_dir), CFG))


def _short(column="metric"):
    return F.regexp_replace(column, "_[日月]度$", "")


@query("target_inner_join", f"""with {PANEL}, {LAGGED}, {TARGET_TRIMMED}
select metric, date, value, y from features join target using (date)""")
def target_inner_join(spark, sf_dir):
    joined = target.join_target(lagged(spark, sf_dir), tax_target(spark, sf_dir))
    return joined.select(_short().alias("metric"), "date", "value", "y")


@query("outer_concat", f"""with {PANEL}, {LAGGED}, {TARGET_TRIMMED}, wide as ({_pivot('features')})
select * from wide full join target using (date)""")
def outer_concat(spark, sf_dir):
    panel = monthly_panel(three_tables(spark, sf_dir), CFG)
    wide = train_simple(panel, tax_target(spark, sf_dir), CFG, METRICS)
    return wide.toDF("date", *ALIASES, "y")


@query("run_variance", f"""with {PANEL}, {LAGGED}, {TARGET_TRIMMED},
joined as (select metric, date, value from features join target using (date))
select target.date, y, {", ".join(ALIASES)} from target join ({_pivot('joined')}) using (date)""")
def run_variance(spark, sf_dir):
    trained = train_variance(monthly_panel(three_tables(spark, sf_dir), CFG), tax_target(spark, sf_dir), CFG)
    wide = wide_training(trained, CFG)
    return wide.toDF(*[c.removesuffix("_日度").removesuffix("_月度") for c in wide.columns])


@query("selection_report", f"""with {PANEL}, {LAGGED}, {TARGET_TRIMMED},
joined as (select metric, date from features join target using (date)),
size as (select count(distinct date) as n, count(distinct metric) as p from joined)
select 'variance' as method, p as original_features, least(p, cast(floor(n * 0.6) as bigint)) as final_features,
  n as n_samples, 0.6::double as max_feature_ratio from size""")
def selection_report(spark, sf_dir):
    panel = monthly_panel(three_tables(spark, sf_dir), CFG)
    return train_variance(panel, tax_target(spark, sf_dir), CFG).metadata


# --- landed vendor data --------------------------------------------------------------------

# Every nation is an indicator with two columns; dates are spelled by month.
_LANDED_ROWS = """
  select n_name as id, {raw_date} as raw_date, o_totalprice as price, o_orderkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""


def landed_nations(spark, sf_dir, raw_date):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return _cells(rows.select(F.col("n_name").alias("id"), raw_date.alias("raw_date"), "o_totalprice", "o_orderstatus"))


def _cells(rows):
    cells = F.array(
        F.struct(F.lit("value").alias("metric"), F.lit(0).alias("pos"), F.col("o_totalprice").cast("string").alias("text")),
        F.struct(F.lit("status").alias("metric"), F.lit(1).alias("pos"), F.col("o_orderstatus").alias("text")),
    )
    return rows.select("id", "raw_date", F.explode(cells).alias("c")).select("id", "raw_date", "c.metric", "c.pos", "c.text")


def nation_catalog(spark, sf_dir, freq, date_col="month"):
    region = F.col("n_regionkey")
    listed = F.when(region < 2, F.array(F.lit("value"))).otherwise(F.array(F.lit("missing")))
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"), F.concat(F.lit("series "), F.col("n_name")).alias("name"), F.lit(freq).alias("freq"),
        F.lit(date_col).alias("date_col"), listed.alias("columns"), F.col("n_nationkey").alias("table_pos"),
    )


def _run_catalog(spark, sf_dir, raw_date, policy, freq, date_col="month"):
    catalog = nation_catalog(spark, sf_dir, freq, date_col)
    selected = catalog.select("id", "table_pos")
    out = cm.merge_catalog(
        selected, catalog.drop("table_pos"), landed_nations(spark, sf_dir, raw_date), policy, CFG,
        start="1995-02-01", end="2000-12-31",
    )
    return out.panel.select("metric", "date", "value")


def _catalog_sql(date_expr: str, suffix: str, monthly: str, status: str = "") -> str:
    """Month values per nation between two dates. January is never split here, because a
    nation has several rows on the first of a month or a known value for it."""
    return f"""
with raw as (select n_name as id, {date_expr} as date, o_totalprice as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
kept as (select * from raw where date between date '1995-02-01' and date '2000-12-31'),
last as (select id, max(date) as last_date from kept group by id),
month_ as (select id, last_day(date) as date, {MEAN} as value from kept join last using (id) {monthly} group by id, last_day(date)),
grid as (select id, date from (select distinct id from month_), (select distinct date from month_)),
spine as (select g.id, g.date, m.value from grid g left join month_ m using (id, date))
select 'series ' || id || '_value{suffix}' as metric, date, coalesce(
    last_value(value ignore nulls) over (partition by id order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by id order by date rows between unbounded preceding and unbounded following)) as value
from spine {status}"""


_TRIM = "where last_day(date) < last_day(last_date) or last_date = last_day(last_date)"


@query("catalog_merge_spelled", _catalog_sql("cast(date_trunc('month', o_orderdate) as date)", "_月度", ""))
def catalog_merge_spelled(spark, sf_dir):
    raw = F.date_format("o_orderdate", "yyyy年MM月份")
    return _run_catalog(spark, sf_dir, raw, cm.SPELLED, "monthly")


@query("catalog_merge_coded", _catalog_sql("cast(o_orderdate as date)", "_日度", _TRIM))
def catalog_merge_coded(spark, sf_dir):
    return _run_catalog(spark, sf_dir, F.date_format("o_orderdate", "yyyyMMdd"), cm.CODED, "daily", "trade_date")


@query("catalog_merge_single", _catalog_sql(
    "cast(o_orderdate as date)", "_日度", _TRIM, "union all select 'series ' || id || '_status_日度', date, null from grid"
))
def catalog_merge_single(spark, sf_dir):
    return _run_catalog(spark, sf_dir, F.date_format("o_orderdate", "yyyy-MM-dd"), cm.SINGLE, "daily", "date")


# One row a month; January is 0 or empty in turn, as vendors that add it to February give it.
_SPLIT = f"""
with months as (select n_name as id, n_nationkey as k, last_day(o_orderdate) as date, floor({MEAN.replace("value", "o_totalprice")}) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name, n_nationkey, last_day(o_orderdate)),
given as (select id, date, case when month(date) = 1 then case when k % 2 = 0 then 0 end else value end as value from months),
beside as (select *, lead(value) over w as next, lead(date) over w as next_date, lag(date) over w as prior_date from given window w as (partition by id order by date)),
halved as (select id, date, case
    when month(date) = 1 and next is not null and next_date = last_day(date + interval 1 day) then next / 2
    when month(date) = 2 and prior_date = last_day(date - interval 1 month) then value / 2 else value end as value from beside),
grid as (select id, date from (select distinct id from halved), (select distinct date from halved))
select 'series ' || id || '_value_月度' as metric, date, coalesce(
    last_value(value ignore nulls) over (partition by id order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by id order by date rows between unbounded preceding and unbounded following)) as value
from grid left join halved using (id, date)"""


def _run_split(spark, sf_dir, policy, pattern, date_col):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    sold = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    mean = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    months = sold.groupBy(F.col("n_name").alias("id"), F.col("n_nationkey").alias("k"), F.trunc("o_orderdate", "month").alias("day")).agg(F.floor(mean).alias("v"))
    given = F.when(F.month("day") != 1, F.col("v")).when(F.col("k") % 2 == 0, F.lit(0))
    landed = months.select(
        "id", F.date_format("day", pattern).alias("raw_date"), F.lit("value").alias("metric"), F.lit(0).alias("pos"), given.cast("string").alias("text")
    )
    catalog = nation_catalog(spark, sf_dir, "monthly", date_col)
    out = cm.merge_catalog(catalog.select("id", "table_pos"), catalog.drop("table_pos"), landed, policy, CFG)
    return out.panel.select("metric", "date", "value")


@query("catalog_merge_split", _SPLIT)
def catalog_merge_split(spark, sf_dir):
    return _run_split(spark, sf_dir, cm.SPELLED, "yyyy年MM月份", "month")


@query("catalog_merge_split_coded", _SPLIT)
def catalog_merge_split_coded(spark, sf_dir):
    return _run_split(spark, sf_dir, cm.CODED, "yyyyMM", "month")


@query("vendor_normalise", """
select n_name as id, cast(date_trunc('month', o_orderdate) as date) as date, count(*) as rows,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus <> 'F' group by all""")
def vendor_normalise(spark, sf_dir):
    spelled = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy年")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyyMM")
    ).otherwise(F.date_format("o_orderdate", "yyyy年MM月份"))
    long = vendor.normalise_landed(landed_nations(spark, sf_dir, spelled), "chinese").filter("metric = 'value'")
    return long.groupBy("id", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


def _answers(spark, sf_dir):
    """One JSON answer per customer, in the two shapes vendors use; some are errors."""
    orders = table(spark, sf_dir, "orders")
    line = F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus")
    )
    packed = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.collect_list(line).alias("table"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    header = F.array(F.lit("time"), F.lit("price"), F.lit("status"))
    nested = F.to_json(F.struct(F.lit(0).alias("errorcode"), F.array(F.struct(header.alias("header"), F.col("table"))).alias("tables")))
    flat = F.to_json(F.struct(F.lit(0).alias("errorcode"), header.alias("header"), F.col("table").alias("tables")))
    failed = F.to_json(F.struct(F.lit(-4318).alias("errorcode"), F.lit("no access").alias("errmsg")))
    payload = F.when(F.col("urgent") == 0, failed).when(F.col("urgent") == 1, flat).otherwise(nested)
    return packed.select("id", payload.alias("payload"))


_ANSWERED = """answered as (select o_custkey as id, count(*) filter (o_orderpriority = '1-URGENT') as urgent from orders group by 1)"""


@query("answer_flatten", f"""
with {_ANSWERED}, cells as (
  select o_custkey as id, cast(o_orderdate as date) as date, 'price' as metric, 1 as pos, o_totalprice as value from orders
  union all select o_custkey, cast(o_orderdate as date), 'status', 2, null from orders)
select cells.* from cells join answered using (id) where urgent > 0""")
def answer_flatten(spark, sf_dir):
    return vendor.flatten_answers(_answers(spark, sf_dir)).long.drop("raw_null")


@query("answer_errors", f"with {_ANSWERED} select id, '-4318: no access' as reason from answered where urgent = 0")
def answer_errors(spark, sf_dir):
    return vendor.flatten_answers(_answers(spark, sf_dir)).errors
