"""A corpus of sheets made from the orders: 50 sheets in several layouts.

Each sheet has a date, a price, a count and a note column, one row per month. Layouts differ
in the spelling of the date column and of the dates, in metadata rows, and in header faults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from macropanel.config import FREQ, PanelConfig
from macropanel.operators import profile
from macropanel.plans.corpus import auto_parse, declared_parse, load_parse
from macropanel.plans.panel import monthly_panel
from macropanel.plans.pipeline import ordered_tables

from macropanel.functions.values import num
from macropanel.session import cut_lineage
from macropanel.sources.sheets import scan_files

from .base import q, q_sql, query, table

# Text of both engines. `p` numbers the sheet; row 0 is the header.
_MONTHS = """
  select o_custkey % 50 as p, year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n,
    cast(floor(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)) as bigint) as price
  from orders group by o_custkey % 50, year(o_orderdate), month(o_orderdate)"""
_MM = "lpad(cast(m as string), 2, '0')"
_DATE_TEXT = f"""case p % 4 when 0 then cast(y as string) || {_MM} || '01' when 1 then cast(y as string) || '-' || {_MM} || '-01'
  when 2 then cast(y as string) || '年' || {_MM} || '月' else cast(y as string) || '年' || {_MM} || '月01日' end"""
_DATE_NAME = "case p % 5 when 0 then '指标名称' when 1 then '日期' when 2 then 'Date' when 3 then 'foo' else 'trans_date' end"
# Header fault: names in the first data row, one name missing, a name given twice, or none.
_FAULT = "p % 7"
_LEAD = f"(case when {_FAULT} = 0 then 1 else 0 end + case when p % 2 = 1 then 2 else 0 end)"
_FREQ_CODE = "case p % 3 when 0 then '月' when 1 then '季' else '其他' end"
CORPUS = f"""
with months as ({_MONTHS}),
numbered as (select *, row_number() over (partition by p order by y, m) as r from months),
sheets as (select distinct p from months),
lines as (
  select p, cast(0 as bigint) as row_,
    case when {_FAULT} = 0 then 'Unnamed: 0' else {_DATE_NAME} end as c0,
    case when {_FAULT} = 0 then 'Unnamed: 1' else 'price' end as c1,
    case when {_FAULT} in (0, 1) then 'Unnamed: 2' when {_FAULT} = 2 then 'price' else 'orders' end as c2,
    case when {_FAULT} = 0 then '3' else 'note' end as c3 from sheets
  union all select p, cast(1 as bigint), {_DATE_NAME}, 'price', 'orders', 'note' from sheets where {_FAULT} = 0
  union all select p, cast({_LEAD} - 1 as bigint), '频率', {_FREQ_CODE}, {_FREQ_CODE}, '月' from sheets where p % 2 = 1
  union all select p, cast({_LEAD} as bigint), '单位', case when p % 3 = 0 then '元' end, '件', '件' from sheets where p % 2 = 1
  union all select p, cast(r + {_LEAD} as bigint), {_DATE_TEXT}, cast(price as string),
    case when n > 1 then cast(n as string) end, case when n > 3 then 'n/a' else 'x' || cast(n as string) end from numbered)
select concat('f', lpad(cast(p as string), 2, '0')) as path, p, row_ , c0, c1, c2, c3 from lines"""


def corpus(spark, sf_dir):
    lines = spark.sql(CORPUS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    # Decoded sheets are landed before they are profiled, as in a run on files.
    return cut_lineage(lines.select("path", F.col("row_").alias("row"), F.array("c0", "c1", "c2", "c3").alias("cells")))


_CTE = f"corpus as ({CORPUS})"


@query("corpus_date_by_name", f"""
with {_CTE},
heads as (select path, p, unnest([0, 1, 2, 3]) as col, unnest([c0, c1, c2, c3]) as name from corpus where row_ = 0)
select path, min(col) as date_idx from heads
where regexp_matches(lower(trim(name)), 'date|time|日期|时间|指标名称|trans_month|stat_month') group by path""")
def corpus_date_by_name(spark, sf_dir):
    return profile.date_column_by_keyword(profile.header_cells(corpus(spark, sf_dir)))


# Repaired names, offset and number of metadata rows of each sheet, as columns n0..n3.
_FIXED = f"""
fixed as (select p, max(path) as path, {_FAULT} as fault,
    case when {_FAULT} = 0 then 1 else 0 end as offset_, case when p % 2 = 1 then 2 else 0 end as metadata_rows,
    {_DATE_NAME} as n0, 'price' as n1,
    case {_FAULT} when 1 then coalesce(max(case when row_ = 1 then c2 end), 'col_2') when 2 then 'price' else 'orders' end as n2,
    'note' as n3
  from corpus group by p)"""


@query("corpus_header_fix", f"""
with {_CTE}, {_FIXED}
select path, offset_ as offset, unnest([0, 1, 2, 3]) as col, unnest([n0, n1, n2, n3]) as name from fixed""")
def corpus_header_fix(spark, sf_dir):
    fixed = profile.fixed_headers(corpus(spark, sf_dir))
    return fixed.select("path", "offset", F.posexplode("names").alias("col", "name"))


@query("corpus_dedupe_columns", f"""
with {_CTE}, {_FIXED},
names as (select path, unnest([0, 1, 2, 3]) as col, unnest([n0, n1, n2, n3]) as name from fixed)
select path, min(col) as col, name from names group by path, name""")
def corpus_dedupe_columns(spark, sf_dir):
    fixed = profile.fixed_headers(corpus(spark, sf_dir))
    names = fixed.select("path", F.posexplode("names").alias("col", "name"))
    return profile.first_of_duplicates(names)


_META = f"""
meta as (select path, metadata_rows,
    case when metadata_rows = 0 then 'unknown' when p % 3 = 0 then 'monthly' when p % 3 = 1 then 'quarterly' else 'monthly' end as freq,
    case when metadata_rows = 0 then null when p % 3 = 0 then '元' else '件' end as unit from fixed)"""


@query("corpus_metadata", f"with {_CTE}, {_FIXED}, {_META} select path, metadata_rows from meta")
def corpus_metadata(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return profile.sheet_metadata(rows, profile.fixed_headers(rows)).select("path", "metadata_rows")


@query("corpus_freq_unit", f"with {_CTE}, {_FIXED}, {_META} select path, freq, unit from meta")
def corpus_freq_unit(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return profile.sheet_metadata(rows, profile.fixed_headers(rows)).select("path", "freq", "unit")


@query("corpus_date_by_content", f"""
with {_CTE}, {_FIXED},
cells as (select c.path, unnest([0, 1, 2, 3]) as col, coalesce(trim(unnest([c0, c1, c2, c3])), 'nan') as text
  from corpus c join fixed f using (p) where row_ > offset_ + metadata_rows),
shares as (select path, col, count(*) as n,
    count(case when length(text) = 8 then try_strptime(text, '%Y%m%d') end) as n1, count(try_strptime(text, '%Y年%m月')) as n2,
    count(try_strptime(text, '%Y年%m月%d日')) as n3, count(try_strptime(text, '%Y-%m-%d')) as n4, count(distinct text) as d
  from cells where text <> '' group by path, col)
select path, min(col) as date_idx from shares
where n >= 2 and d >= 2 and greatest(n1, n2, n3, n4) / n >= 0.7 group by path""")
def corpus_date_by_content(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    headers = profile.fixed_headers(rows)
    found = headers.join(profile.sheet_metadata(rows, headers), "path")
    return profile.date_column_by_content(rows, found)


# Rows of each sheet whose date parses, in long form with one row per kept column.
_DATED = f"""
dated as (select c.path, p, fault, metadata_rows,
    cast(coalesce(try_strptime(c0, '%Y%m%d'), try_strptime(c0, '%Y-%m-%d'), try_strptime(c0, '%Y年%m月'), try_strptime(c0, '%Y年%m月%d日')) as date) as date,
    c1, c2, c3, n0, n2
  from corpus c join fixed f using (p, path) where row_ > offset_ + metadata_rows),
shares as (select path, count(*) as n, count(try_cast(c2 as double)) / count(*) as s2 from dated where date is not null group by path),
auto as (select path, p, 'price' as metric, 1 as pos, date, try_cast(c1 as double) as value from dated where date is not null
  union all select path, p, n2, 2, date, try_cast(c2 as double) from dated join shares using (path)
    where date is not null and fault <> 2 and s2 >= 0.5)"""

_DETECTED = """
gaps as (select path, date_diff('day', lag(date) over (partition by path order by date), date) as g
  from dated where date is not null),
freqs as (select path, case when floor(median(g)) <= 2 then 'daily' when floor(median(g)) between 20 and 40 then 'monthly'
  when floor(median(g)) between 80 and 100 then 'quarterly' else 'unknown' end as seen from gaps group by path)"""


@query("corpus_auto_parse", f"""
with {_CTE}, {_FIXED}, {_META}, {_DATED}, {_DETECTED}
select f.path, f.n0 as date_col, 0 as date_idx, coalesce(nullif(m.freq, 'unknown'), q.seen) as freq, m.unit, f.metadata_rows,
  (select count(*) from dated d where d.path = f.path and date is not null) as rows,
  (select string_agg(distinct metric, ',' order by metric) from auto a where a.path = f.path) as columns
from fixed f join meta m using (path) join freqs q using (path)""")
def corpus_auto_parse(spark, sf_dir):
    found = auto_parse(corpus(spark, sf_dir)).profiles
    return found.withColumn("columns", F.array_join(F.array_sort("data_cols"), ",")).drop("data_cols")


@query("corpus_auto_values", f"with {_CTE}, {_FIXED}, {_DATED} select path, metric, pos, date, value from auto")
def corpus_auto_values(spark, sf_dir):
    long = auto_parse(corpus(spark, sf_dir)).long
    return long.select(F.col("table").alias("path"), "metric", "pos", "date", "value")


@query("corpus_strict_rows", f"""
with {_CTE}, {_FIXED}
select path, count(*) as rows from (select path, case when p % 4 = 0 then try_strptime(c0, '%Y%m%d') end as date from corpus c join fixed using (p, path)
  where row_ > 0) where date is not null group by path""")
def corpus_strict_rows(spark, sf_dir):
    parsed = auto_parse(corpus(spark, sf_dir), fix_headers=False, free_dates=False, require_numeric=False)
    return parsed.profiles.filter("rows > 0").select("path", "rows")


@query("corpus_rejects", f"""
with {_CTE} select path, 'no date column found' as reason from corpus where row_ = 0
and not regexp_matches(lower(c0), 'date|日期|月份|季度|时间')""")
def corpus_rejects(spark, sf_dir):
    return declared_parse(corpus(spark, sf_dir), "monthly").rejects


# Declared frequency: every other column is kept as it is, text columns become empty.
_DECLARED = f"""
raw as (select c.path, p, fault, cast(coalesce(case when p % 4 = 0 and length(c0) = 8 then try_strptime(c0, '%Y%m%d') end,
      case when p % 4 = 1 then try_strptime(c0, '%Y-%m-%d') end, case when p % 4 = 2 then try_strptime(c0, '%Y年%m月') end,
      case when p % 4 = 3 then try_strptime(c0, '%Y年%m月%d日') end) as date) as date, c1, c2, c3, h.h2
  from corpus c join fixed f using (p, path) join (select path, c0 as h0, c2 as h2 from corpus where row_ = 0) h using (path)
  where row_ > 0 and regexp_matches(lower(h0), '{{keywords}}')),
long as (select path, 'price' as metric, date, try_cast(c1 as double) as value from raw where date is not null
  union all select path, h2, date, try_cast(c2 as double) from raw where date is not null and fault <> 2
  union all select path, 'note', date, null from raw where date is not null)"""


def _declared_sql(keywords: str) -> str:
    return f"with {_CTE}, {_FIXED}, {_DECLARED.replace('{keywords}', keywords)} select path, metric, date, value from long"


@query("corpus_declared_values", _declared_sql("date|日期|月份|季度|时间"))
def corpus_declared_values(spark, sf_dir):
    long = declared_parse(corpus(spark, sf_dir), "monthly").long
    return long.select(F.col("table").alias("path"), "metric", "date", "value")


@query("corpus_load_values", _declared_sql("date|time|日期|时间|指标名称"))
def corpus_load_values(spark, sf_dir):
    long = load_parse(corpus(spark, sf_dir)).long
    return long.select(F.col("table").alias("path"), "metric", "date", "value")


@query("run_auto_corpus", f"""
with {_CTE}, {_FIXED}, {_META}, {_DATED}, {_DETECTED},
named as (select path, path || '/' || metric as metric, date, value, coalesce(nullif(m.freq, 'unknown'), nullif(seen, 'unknown'), 'monthly') as freq
  from auto join meta m using (path) join freqs using (path)),
sparse as (select metric from named group by metric having count(*) filter (value is null) * 100.0 / count(*) < 60),
month_ as (select metric, any_value(freq) as freq, last_day(date) as date, avg(value) as value from named semi join sparse using (metric)
  group by metric, last_day(date)),
series as (select metric, any_value(freq) as freq, last_day(cast(unnest(generate_series(date_trunc('month', min(date)),
  date_trunc('month', max(date)), interval 1 month)) as date)) as date from month_ group by metric),
spine as (select s.metric, s.freq, s.date, m.value, row_number() over (partition by s.metric order by s.date) as i
  from series s left join month_ m using (metric, date)),
around as (select *, last_value(value ignore nulls) over before as pv, first_value(value ignore nulls) over after as nv,
    last_value(case when value is not null then i end ignore nulls) over before as pi,
    first_value(case when value is not null then i end ignore nulls) over after as ni from spine
  window before as (partition by metric order by date rows between unbounded preceding and current row),
         after as (partition by metric order by date rows between current row and unbounded following)),
resampled as (select metric, date, case when freq <> 'quarterly' or value is not null then value when pi is null then null when ni is null then pv
  else pv + (nv - pv) * (i - pi) / (ni - pi) end as value from around),
grid as (select metric, date from (select distinct metric from resampled), (select distinct date from resampled)),
panel as (select g.metric, g.date, r.value from grid g left join resampled r using (metric, date))
select metric, date, coalesce(
    last_value(value ignore nulls) over (partition by metric order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by metric order by date rows between unbounded preceding and unbounded following)) as value
from panel""")
def run_auto_corpus(spark, sf_dir):
    parsed = auto_parse(corpus(spark, sf_dir)).long
    known = F.coalesce(F.nullif(FREQ, F.lit("unknown")), F.lit("monthly"))
    # Sheets share column names, which a merge does not allow; the sheet name tells them apart.
    named = parsed.withColumn(FREQ, known).withColumn("metric", F.concat("table", F.lit("/"), "metric"))
    panel = monthly_panel(ordered_tables(named), PanelConfig(missing_threshold=60.0))
    return panel.select(F.regexp_replace("metric", "_[月季日]度$", "").alias("metric"), "date", "value")


@query("scan_order_cells", f"""
select 'o_orderkey' as name, count(*) as rows, count(o_orderkey) as filled, {q_sql("sum(o_orderkey)", 2)} as total from orders
union all select 'o_custkey', count(*), count(o_custkey), {q_sql("sum(o_custkey)", 2)} from orders
union all select 'o_orderstatus', count(*), count(o_orderstatus), null from orders
union all select 'o_totalprice', count(*), count(o_totalprice), {q_sql("cast(sum(cast(o_totalprice as decimal(18,2))) as double)", 2)} from orders
union all select 'o_orderdate', count(*), count(o_orderdate), null from orders
union all select 'o_orderpriority', count(*), count(o_orderpriority), null from orders""")
def scan_order_cells(spark, sf_dir):
    """A Parquet file as cells under the names of its header row."""
    cells = scan_files(spark, f"{sf_dir}/orders.parquet").where("error is null").select("path", "row", F.posexplode("cells").alias("col", "cell"))
    names = cells.where("row = 0").select("path", "col", F.col("cell").alias("name"))
    # Cells are added up by file and column before they get their names, so that no column's cells meet in one task.
    by_column = cells.where("row > 0").groupBy("path", "col").agg(
        F.count("*").alias("rows"), F.count("cell").alias("filled"), F.sum(num(F.col("cell")).cast("decimal(18,2)")).alias("total")
    )
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    total = F.sum("total").cast("double")
    return by_column.join(names, ["path", "col"]).groupBy("name").agg(whole("rows"), whole("filled"), q(total, 2).alias("total"))
