"""Queries on a catalog of indicators; parts stand in for indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from macropanel.operators import catalog as cat
from macropanel.operators.frequency import detect_frequency

from .base import query, table

_FREQ = "case p_type when 'ECONOMY' then 'daily' when 'SMALL' then 'quarterly' else 'monthly' end"

CATALOG = f"""catalog as (
  select cast(p_partkey as string) as id, p_name as name, {_FREQ} as freq, p_brand as indicator from part)"""


def part_catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.expr(_FREQ).alias("freq"),
        F.col("p_brand").alias("indicator"),
    )


@query("catalog_first_entry", """
select p_brand as id, arg_min(p_name, p_partkey) as name, min(p_partkey) as entry from part group by p_brand""")
def catalog_first_entry(spark, sf_dir):
    """Every brand has many entries; the first in the list counts."""
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("entry"))
    return cat.first_by_id(entries)


@query("catalog_search", f"""
with {CATALOG}
select * from catalog where contains(lower(id), 'red') or contains(lower(name), 'red') or contains(lower(indicator), 'red')""")
def catalog_search(spark, sf_dir):
    return cat.search(part_catalog(spark, sf_dir), " RED ", ("id", "name", "indicator"))


@query("catalog_search_blank", f"with {CATALOG} select * from catalog")
def catalog_search_blank(spark, sf_dir):
    return cat.search(part_catalog(spark, sf_dir), "  ")


def _selected(spark, sf_dir):
    """Ids of all parts ever sold, and of some that never existed."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    odd = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), F.col("l_partkey").cast("string")))
    return items.select(F.coalesce(odd, F.col("l_partkey").cast("string")).alias("id")).distinct()


_SELECTED = """selected as (
  select distinct case when l_linenumber = 7 then 'x' || cast(l_partkey as string) else cast(l_partkey as string) end as id
  from lineitem)"""


@query("catalog_lookup", f"with {CATALOG}, {_SELECTED} select c.* from catalog c semi join selected using (id)")
def catalog_lookup(spark, sf_dir):
    return cat.lookup(_selected(spark, sf_dir), part_catalog(spark, sf_dir))


@query("catalog_missing", f"with {CATALOG}, {_SELECTED} select id from selected anti join catalog using (id)")
def catalog_missing(spark, sf_dir):
    return cat.unknown_ids(_selected(spark, sf_dir), part_catalog(spark, sf_dir))


@query("catalog_failed", f"""
with {CATALOG}, {_SELECTED},
data as (select distinct cast(l_partkey as string) as id from lineitem where l_returnflag = 'R')
select id from selected where id not in (select id from catalog) or id not in (select id from data)""")
def catalog_failed(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("id"))
    return cat.failed_ids(_selected(spark, sf_dir), part_catalog(spark, sf_dir), returned)


@query("catalog_freq_count", f"""
with {CATALOG}, {_SELECTED}
select freq, count(*) as total, count(s.id) as selected from catalog c left join selected s using (id) group by freq""")
def catalog_freq_count(spark, sf_dir):
    return cat.count_by_freq(part_catalog(spark, sf_dir), _selected(spark, sf_dir))


@query("catalog_freq_override", f"""
with {CATALOG},
days as (select cast(l_partkey as string) as id, cast(l_shipdate as date) as date from lineitem),
gaps as (select id, date_diff('day', lag(date) over (partition by id order by date), date) as g from days),
found as (select id, floor(median(g)) as d from gaps group by id),
label as (select id, case when d <= 2 then 'daily' when d between 20 and 40 then 'monthly' when d between 80 and 100 then 'quarterly' end as freq from found)
select c.id, c.name, c.indicator, coalesce(l.freq, c.freq) as freq from catalog c left join label l using (id)""")
def catalog_freq_override(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"), F.to_date("l_shipdate").alias("date")
    )
    return cat.override_freq(part_catalog(spark, sf_dir), detect_frequency(days, ["id"]))


def _custom(spark, sf_dir, brand):
    return part_catalog(spark, sf_dir).filter(F.col("indicator") == brand).withColumn("name", F.upper("name"))


@query("catalog_override", f"with {CATALOG} select id, upper(name) as name, freq, indicator from catalog where indicator = 'Brand#1'")
def catalog_override(spark, sf_dir):
    return cat.effective_catalog(part_catalog(spark, sf_dir), _custom(spark, sf_dir, "Brand#1"))


@query("catalog_override_empty", f"with {CATALOG} select * from catalog")
def catalog_override_empty(spark, sf_dir):
    return cat.effective_catalog(part_catalog(spark, sf_dir), _custom(spark, sf_dir, "no such brand"))


@query("catalog_violations", f"""
with {CATALOG},
damaged as (select id, nullif(name, 'red widget') as name, nullif(freq, 'daily') as freq, indicator from catalog)
select id, array_to_string(list_filter([case when name is null then 'name' end, case when freq is null then 'freq' end],
  lambda x: x is not null), ',') as missing
from damaged where name is null or freq is null""")
def catalog_violations(spark, sf_dir):
    damaged = part_catalog(spark, sf_dir).withColumn("name", F.nullif("name", F.lit("red widget"))).withColumn(
        "freq", F.nullif("freq", F.lit("daily"))
    )
    return cat.violations(damaged).select("id", F.array_join("missing", ",").alias("missing"))
