"""Frequency, resampling and operators along a series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from macropanel.operators import frequency, resample, sequence
from macropanel.operators.longform import to_long
from macropanel.session import checkpoint_folder
from macropanel.sources.months import MonthStates

from .base import (
    CUSTOMER_SPINE, MEAN, ORDERS_BY_CUSTOMER, ORDERS_BY_PRIORITY, lineitem_wide, orders_by_customer,
    orders_by_priority, query, table,
)

KEYS = ["customer"]


def customer_spine(spark, sf_dir):
    """Month means per customer with NULL for the months without an order."""
    monthly = resample.month_end_mean(orders_by_customer(spark, sf_dir), KEYS, exact_scale=2)
    return resample.month_spine(monthly, KEYS)


@query("monthly_mean", f"""
with long as (
  select l_returnflag, 'l_quantity' as metric, cast(l_shipdate as date) as date, l_quantity as value from lineitem
  union all select l_returnflag, 'l_extendedprice', cast(l_shipdate as date), l_extendedprice from lineitem
  union all select l_returnflag, 'l_discount', cast(l_shipdate as date), l_discount from lineitem)
select l_returnflag, metric, last_day(date) as date, {MEAN} as value from long group by all""")
def monthly_mean(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    long = to_long(wide, "l_shipdate", table="lineitem", keys=["l_returnflag"])
    return resample.month_end_mean(long, ["l_returnflag"], exact_scale=2).drop("table")


@query("monthly_refresh", f"""
with long as (
  select l_returnflag, 'l_quantity' as metric, cast(l_shipdate as date) as date, l_quantity as value from lineitem
  union all select l_returnflag, 'l_extendedprice', cast(l_shipdate as date), l_extendedprice from lineitem
  union all select l_returnflag, 'l_discount', cast(l_shipdate as date), l_discount from lineitem)
select l_returnflag, metric, last_day(date) as date, {MEAN} as value, count(value) as known, max(date) as last_date from long group by all""")
def monthly_refresh(spark, sf_dir):
    """Month means from landed states: the finished lines first, then the open ones as a second batch."""
    lines = table(spark, sf_dir, "lineitem")
    states = MonthStates(spark, f"{checkpoint_folder(spark)}/months-{uuid.uuid4().hex}", ["l_returnflag"], exact_scale=2)
    finished = F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
    for batch, chosen in (("finished", finished), ("open", ~finished)):
        wide = lines.where(chosen).select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
        states.add(to_long(wide, "l_shipdate", table="lineitem", keys=["l_returnflag"]), batch)
    return states.read().select("l_returnflag", "metric", "date", (F.col("total") / F.nullif(F.col("known"), F.lit(0))).alias("value"), "known", "last_date")


@query("month_spine_gaps", f"with {CUSTOMER_SPINE} select customer, date, value from customer_spine")
def month_spine_gaps(spark, sf_dir):
    return customer_spine(spark, sf_dir).select("customer", "date", "value")


@query("daily_trim_partial", f"""
with {ORDERS_BY_PRIORITY},
all_ as (select metric, last_day(date) as date, {MEAN} as value from orders_long group by metric, last_day(date)),
last as (select metric, max(date) as last_date from orders_long group by metric),
spine as (select metric, last_day(cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
  interval 1 month)) as date)) as date from all_ group by metric)
select s.metric, s.date, a.value from spine s left join all_ a using (metric, date) join last using (metric)
where s.date < last_day(last_date) or last_date = last_day(last_date)""")
def daily_trim_partial(spark, sf_dir):
    return resample.resample_monthly(orders_by_priority(spark, sf_dir), exact_scale=2).select("metric", "date", "value")


@query("trim_partial_month", f"""
with {ORDERS_BY_CUSTOMER},
last as (select customer, max(date) as last_date from customer_long group by customer)
select customer, date, value from customer_long join last using (customer)
where last_day(date) < last_day(last_date) or last_date = last_day(last_date)""")
def trim_partial_month(spark, sf_dir):
    daily = orders_by_customer(spark, sf_dir).withColumn("last", F.col("date"))
    return resample.trim_partial_month(daily, KEYS, last_date="last").filter(
        F.col("date").isNotNull()
    ).select("customer", "date", "value")


@query("quarterly_interpolate", f"""
with {CUSTOMER_SPINE},
numbered as (select *, row_number() over (partition by customer order by date) as i from customer_spine),
around as (
  select *, last_value(value ignore nulls) over before as pv, first_value(value ignore nulls) over after as nv,
    last_value(case when value is not null then i end ignore nulls) over before as pi,
    first_value(case when value is not null then i end ignore nulls) over after as ni
  from numbered
  window before as (partition by customer order by date rows between unbounded preceding and current row),
         after as (partition by customer order by date rows between current row and unbounded following))
select customer, date, case when value is not null then value when pi is null then null when ni is null then pv
  else pv + (nv - pv) * (i - pi) / (ni - pi) end as value from around""")
def quarterly_interpolate(spark, sf_dir):
    return resample.resample_monthly(
        orders_by_customer(spark, sf_dir, "quarterly"), KEYS, exact_scale=2
    ).select("customer", "date", "value")


@query("unknown_freq_resample", f"""
with weekly as (
  select l_returnflag, cast(date_trunc('week', l_shipdate) as date) as date, l_quantity as value from lineitem),
gaps as (
  select l_returnflag, date_diff('day', lag(date) over (partition by l_returnflag order by date), date) as g
  from (select distinct l_returnflag, date from weekly)),
freq as (
  select l_returnflag, case when floor(median(g)) <= 2 then 'daily' when floor(median(g)) between 20 and 40 then 'monthly'
    when floor(median(g)) between 80 and 100 then 'quarterly' else 'unknown' end as freq
  from gaps group by l_returnflag)
select l_returnflag, freq, last_day(date) as date, {MEAN} as value
from weekly join freq using (l_returnflag) group by all""")
def unknown_freq_resample(spark, sf_dir):
    weekly = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"), "l_quantity"
    )
    long = to_long(weekly, "week", table="lineitem", keys=["l_returnflag"]).drop("freq")
    freq = frequency.detect_frequency(long.select("l_returnflag", "date").distinct(), ["l_returnflag"])
    monthly = resample.resample_monthly(long.join(freq, "l_returnflag"), ["l_returnflag"], exact_scale=2)
    return monthly.select("l_returnflag", "freq", "date", "value")


def _freq_sql(source: str, key: str, micros: str, narrow: bool = False) -> str:
    days = "floor(m / 86400000000)"
    label = (
        f"case when {days} <= 1 then 'daily' when {days} between 28 and 31 then 'monthly' "
        f"when {days} between 88 and 93 then 'quarterly' else 'monthly' end"
        if narrow else
        f"case when m is null then 'unknown' when {days} <= 2 then 'daily' when {days} between 20 and 40 then 'monthly' "
        f"when {days} between 80 and 100 then 'quarterly' else 'unknown' end"
    )
    return f"""
with gaps as (
  select {key}, {micros} - lag({micros}) over (partition by {key} order by {micros}) as g from {source}),
medians as (select {key}, median(g) as m from gaps group by {key})
select {key}, {label} as freq from medians"""


@query("detect_freq", _freq_sql("orders", "o_custkey", "epoch_us(o_orderdate)"))
def detect_freq(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"))
    return frequency.detect_frequency(orders, ["o_custkey"])


@query("detect_freq_of_times", _freq_sql("events", "user_id", "epoch_us(ts)"))
def detect_freq_of_times(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date"))
    return frequency.detect_frequency(events, ["user_id"])


@query("detect_freq_whole_table", """
with gaps as (select epoch_us(l_shipdate) - lag(epoch_us(l_shipdate)) over (order by l_shipdate) as g from lineitem)
select case when floor(median(g) / 86400000000) <= 2 then 'daily' else 'other' end as freq from gaps""")
def detect_freq_whole_table(spark, sf_dir):
    return frequency.detect_frequency(lineitem_wide(spark, sf_dir).withColumnRenamed("ship", "date"))


@query("detect_target_freq", _freq_sql("lineitem", "l_partkey", "epoch_us(l_shipdate)", narrow=True))
def detect_target_freq(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"))
    return frequency.detect_target_frequency(items, ["l_partkey"])


_BACK = "rows between unbounded preceding and current row"
_AHEAD = "rows between current row and unbounded following"
_BY = "partition by customer order by date"


@query("ffill", f"""with {CUSTOMER_SPINE}
select customer, date, last_value(value ignore nulls) over ({_BY} {_BACK}) as value from customer_spine""")
def ffill(spark, sf_dir):
    return sequence.ffill(customer_spine(spark, sf_dir), KEYS).select("customer", "date", "value")


@query("bfill", f"""with {CUSTOMER_SPINE}
select customer, date, first_value(value ignore nulls) over ({_BY} {_AHEAD}) as value from customer_spine""")
def bfill(spark, sf_dir):
    return sequence.bfill(customer_spine(spark, sf_dir), KEYS).select("customer", "date", "value")


@query("fill_zero", f"with {CUSTOMER_SPINE} select customer, date, coalesce(value, 0.0::double) as value from customer_spine")
def fill_zero(spark, sf_dir):
    return sequence.fill_zero(customer_spine(spark, sf_dir)).select("customer", "date", "value")


_LAGGED = f"lagged as (select customer, date, lag(value) over ({_BY}) as value from customer_spine)"


@query("leak_safe_lag", f"""with {CUSTOMER_SPINE}, {_LAGGED}
select customer, date, coalesce(first_value(value ignore nulls) over ({_BY} {_AHEAD}), 0.0::double) as value from lagged""")
def leak_safe_lag(spark, sf_dir):
    return sequence.leak_safe_lag(customer_spine(spark, sf_dir), KEYS).select("customer", "date", "value")


@query("strict_past_lag", f"""with {CUSTOMER_SPINE}, {_LAGGED}
select customer, date, coalesce(last_value(value ignore nulls) over ({_BY} {_BACK}), 0.0::double) as value from lagged""")
def strict_past_lag(spark, sf_dir):
    lagged = sequence.leak_safe_lag(customer_spine(spark, sf_dir), KEYS, strict_past=True)
    return lagged.select("customer", "date", "value")


@query("rolling_windows", f"""with {CUSTOMER_SPINE}, {_LAGGED},
filled as (select customer, date, coalesce(first_value(value ignore nulls) over ({_BY} {_AHEAD}), 0.0::double) as value from lagged),
rolled as (select customer, date, list(value) over ({_BY} rows between 6 preceding and current row) as xs from filled)
select customer, date, unnest(generate_series(1, len(xs))) as i, unnest(xs) as x from rolled where len(xs) >= 4""")
def rolling_windows(spark, sf_dir):
    lagged = sequence.leak_safe_lag(customer_spine(spark, sf_dir), KEYS)
    rolled = sequence.rolling_windows(lagged, KEYS)
    return rolled.select("customer", "date", F.posexplode("xs").alias("i", "x")).withColumn("i", F.col("i") + 1)


# Month values of each nation; January has no figure of its own where its status is open.
_NATION_MONTHS = """month_values as (
  select c_nationkey as nation, {date} as date,
    case when month(o_orderdate) = 1 and o_orderpriority like '%HIGH%' then null else o_totalprice end as value
  from orders join customer on o_custkey = c_custkey),
summed as (
  select nation, date, cast(sum(cast(value as decimal(18,2))) as double) as total, count(*) as n from month_values
  group by nation, date),
series as (select nation, date, case when month(date) = 1 and n % 3 = 0 then null when month(date) = 1 and n % 3 = 1
  then 0.0::double else total end as value from summed)"""

_SPLIT = """
select nation, date, case when {involved} and jan_n = 1 and feb_n = 1 and coalesce(jan, 0) = 0 and feb <> 0
  then feb / 2 else value end as value
from (select *,
    count(*) filter (month(date) = 1 and {involved}) over w as jan_n, count(*) filter (month(date) = 2 and {involved}) over w as feb_n,
    max(value) filter (month(date) = 1 and {involved}) over w as jan, max(value) filter (month(date) = 2 and {involved}) over w as feb
  from series window w as (partition by nation, year(date)))"""


def _nation_series(spark, sf_dir, date):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    held_back = (F.month("o_orderdate") == 1) & F.col("o_orderpriority").contains("HIGH")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), date.alias("date"), F.when(~held_back, F.col("o_totalprice")).alias("value")
    )
    summed = rows.groupBy("nation", "date").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    )
    january = F.month("date") == 1
    value = F.when(january & (F.col("n") % 3 == 0), F.lit(None)).when(january & (F.col("n") % 3 == 1), F.lit(0.0))
    return summed.select(
        "nation", F.lit("t").alias("table"), F.lit("m").alias("metric"), "date", value.otherwise(F.col("total")).alias("value")
    )


@query("jan_feb_split", "with " + _NATION_MONTHS.format(date="cast(date_trunc('month', o_orderdate) as date)")
       + _SPLIT.format(involved="(month(date) in (1, 2) and day(date) = 1)"))
def jan_feb_split(spark, sf_dir):
    series = _nation_series(spark, sf_dir, F.trunc(F.to_date("o_orderdate"), "MM"))
    return sequence.jan_feb_split(series, ["nation"]).select("nation", "date", "value")


@query("jan_feb_split_by_month", "with " + _NATION_MONTHS.format(date="last_day(o_orderdate)")
       + _SPLIT.format(involved="(month(date) in (1, 2))"))
def jan_feb_split_by_month(spark, sf_dir):
    series = _nation_series(spark, sf_dir, F.last_day("o_orderdate"))
    return sequence.jan_feb_split(series, ["nation"], mode="by_month").select("nation", "date", "value")
