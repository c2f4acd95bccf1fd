"""Registry and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from macropanel.operators.longform import to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same result."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(value: Column, digits: int = 4) -> Column:
    """Cut to a grid on which two engines do not differ by the last bit of a sum."""
    return F.floor(value * 10.0 ** digits + 0.3137) / 10.0 ** digits


def q_sql(expr: str, digits: int = 4) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.3137) / 1e{digits}"


# --- inputs: Spark on the left, the same as SQL in the constants below -------------------


def orders_by_priority(spark, sf_dir) -> DataFrame:
    """Daily order values, one metric per priority, as a long table."""
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("table"), F.concat(F.lit("price_"), first).alias("metric"),
        first.cast("int").alias("pos"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"), F.lit(False).alias("raw_null"), F.lit("daily").alias("freq"),
    )


def orders_by_customer(spark, sf_dir, freq: str = "monthly") -> DataFrame:
    """Order values per customer: many short series with gaps."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.lit("orders").alias("table"), F.lit("price").alias("metric"),
        F.lit(0).alias("pos"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"),
        F.lit(False).alias("raw_null"), F.lit(freq).alias("freq"),
    )


def lineitem_wide(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("ship"), "l_quantity", "l_extendedprice", "l_discount"
    )


def lineitem_long(spark, sf_dir, freq: str = "monthly") -> DataFrame:
    """Quantity, price and discount of all line items as a long table."""
    return to_long(lineitem_wide(spark, sf_dir), "ship", table="lineitem", freq=freq)


def events_long(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("value").alias("event_value"))
    return to_long(events, "day", table="events", freq="daily")


MEAN = "cast(sum(cast(value as decimal(18,2))) as double) / nullif(count(value), 0)"

# (metric, pos, date, value)
ORDERS_BY_PRIORITY = """orders_long as (
  select 'price_' || substr(o_orderpriority, 1, 1) as metric, cast(substr(o_orderpriority, 1, 1) as int) as pos,
         cast(o_orderdate as date) as date, o_totalprice as value from orders)"""

# (customer, date, value) per day
ORDERS_BY_CUSTOMER = """customer_long as (
  select o_custkey as customer, cast(o_orderdate as date) as date, o_totalprice as value from orders)"""

# (metric, pos, date, value)
LINEITEM_LONG = """lineitem_long as (
  select 'l_quantity' as metric, 0 as pos, cast(l_shipdate as date) as date, l_quantity as value from lineitem
  union all select 'l_extendedprice', 1, cast(l_shipdate as date), l_extendedprice from lineitem
  union all select 'l_discount', 2, cast(l_shipdate as date), l_discount from lineitem)"""

# (customer, date, value): month means with every month between first and last
CUSTOMER_SPINE = f"""{ORDERS_BY_CUSTOMER},
customer_month as (select customer, last_day(date) as date, {MEAN} as value from customer_long group by all),
customer_months as (
  select customer, last_day(cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
         interval 1 month)) as date)) as date from customer_month group by customer),
customer_spine as (
  select s.customer, s.date, m.value from customer_months s left join customer_month m using (customer, date))"""
