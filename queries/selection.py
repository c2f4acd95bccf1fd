"""Feature selection and reduction, on monthly series of brands and suppliers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from macropanel.config import PanelConfig
from macropanel.functions.association import kendall_p as kendall_p_udf, kendall_tau as kendall_tau_udf
from macropanel.operators import columns, reduce, select
from macropanel.operators.merge import merge_panel
from macropanel.operators.target import join_target
from macropanel.plans.panel import monthly_panel
from macropanel.plans.training import train_components
from macropanel.session import cut_lineage

from .base import q, q_sql, query, table
from .panels import CFG, segment_tables, tax_target, three_tables

# Month mean of the quantity of each part brand, gaps filled, next to the month's mean tax.
SERIES = """known as (
  select p_brand as feature, last_day(l_shipdate) as date,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*) as value
  from lineitem join part on l_partkey = p_partkey group by all),
series as (select feature, date, coalesce(
    last_value(value ignore nulls) over (partition by feature order by date rows between unbounded preceding and current row),
    first_value(value ignore nulls) over (partition by feature order by date rows between unbounded preceding and unbounded following)) as value
  from (select feature, date from (select distinct feature from known), (select distinct date from known)) left join known using (feature, date)),
target as (select last_day(l_shipdate) as date, cast(sum(cast(l_tax as decimal(18,2))) as double) / count(*) as y from lineitem group by all),
points as (select feature, date, value, y from series join target using (date))"""


def brand_columns(spark, sf_dir):
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    series = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("metric"), F.last_day("l_shipdate").alias("date")
    ).agg(mean("l_quantity").alias("value")).withColumn("table", F.col("metric"))
    y = items.groupBy(F.last_day("l_shipdate").alias("date")).agg(mean("l_tax").alias("y"))
    return columns.pack(join_target(merge_panel(cut_lineage(series)), y))


@query("kendall_tau", f"""
with {SERIES},
pairs as (select a.feature, sign(a.value - b.value) as sx, sign(a.y - b.y) as sy from points a join points b on a.feature = b.feature and a.date < b.date)
select feature, {q_sql('sum(sx * sy) / sqrt(sum(sx * sx) * sum(sy * sy))', 6)} as tau from pairs group by feature""")
def kendall_tau(spark, sf_dir):
    return brand_columns(spark, sf_dir).select("feature", q(kendall_tau_udf("xs", "ys"), 6).alias("tau"))


# The normal tail is summed as the power series of the error function.
@query("kendall_p", f"""
with {SERIES},
pairs as (select a.feature, sign(a.value - b.value) as sx, sign(a.y - b.y) as sy from points a join points b on a.feature = b.feature and a.date < b.date),
score as (select feature, abs(sum(sx * sy)) as s from pairs group by feature),
ties as (select feature, sum(c * (c - 1) / 2) as t, sum(c * (c - 1) * (c - 2)) as t0, sum(c * (c - 1) * (2 * c + 5)) as t1
  from (select feature, value, count(*)::double as c from points group by feature, value) group by feature),
yties as (select feature, sum(c * (c - 1) / 2) as u, sum(c * (c - 1) * (c - 2)) as u0, sum(c * (c - 1) * (2 * c + 5)) as u1
  from (select feature, y, count(*)::double as c from points group by feature, y) group by feature),
size as (select feature, count(*)::double as n from points group by feature),
z as (select feature, s / sqrt((n * (n - 1) * (2 * n + 5) - t1 - u1) / 18 + 2 * t * u / (n * (n - 1))
    + t0 * u0 / (9 * n * (n - 1) * (n - 2))) / sqrt(2) as x
  from score join ties using (feature) join yties using (feature) join size using (feature))
select feature, {q_sql("""1 - case when x = 0 then 0 else 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k:
    case when k % 2 = 0 then 1 else -1 end * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1))) end""", 6)} as p from z""")
def kendall_p(spark, sf_dir):
    return brand_columns(spark, sf_dir).select("feature", q(kendall_p_udf("xs", "ys"), 6).alias("p"))


# A made p-value per customer, many of them equal, and none for some.
_P = "case when o_custkey % 10 = 3 then null else (o_custkey % 997) * (o_custkey % 89) / 2000000.0 end"


@query("by_select", f"""
with tested as (select distinct o_custkey as feature, ({_P})::double as p from orders),
size as (select count(p) as m, list_sum(list_transform(range(1, count(p) + 1), lambda i: 1 / i::double)) as h from tested),
ranked as (select p, count(*) over (order by p) as k from tested where p is not null),
cut as (select max(p) as cut from ranked, size where p <= k / m::double * 0.05::double / h)
select feature, p from tested, cut where p <= cut""")
def by_select(spark, sf_dir):
    tested = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("feature"), F.expr(f"cast({_P} as double)").alias("p")
    ).distinct()
    return select.select_by_fdr(tested)


@query("by_select_by_entity", f"""
with tested as (select distinct c_nationkey as nation, o_custkey as feature, ({_P})::double as p from orders join customer on o_custkey = c_custkey),
size as (select nation, count(p) as m, list_sum(list_transform(range(1, count(p) + 1), lambda i: 1 / i::double)) as h from tested group by nation),
ranked as (select nation, p, count(*) over (partition by nation order by p) as k from tested where p is not null),
cut as (select nation, max(p) as cut from ranked join size using (nation) where p <= k / m::double * 0.2::double / h group by nation)
select nation, feature, p from tested join cut using (nation) where p <= cut""")
def by_select_by_entity(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tested = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("feature"), F.expr(f"cast({_P} as double)").alias("p")
    ).distinct()
    return select.select_by_fdr(tested, ["nation"], fdr_level=0.2)


# The cut is low, so that series that are only noise fall under it too.
@query("corr_filter", f"""
with {SERIES},
pairs as (select a.feature as i, b.feature as j, corr(a.value, b.value) as r
  from series a join series b on a.date = b.date and a.feature < b.feature group by a.feature, b.feature)
select distinct feature from series where feature not in (select j from pairs where abs(r) > 0.2)""")
def corr_filter(spark, sf_dir):
    return select.drop_correlated(brand_columns(spark, sf_dir), cut=0.2).select("feature")


# Month mean of the quantity of each supplier: the number of series grows with the tables.
MANY = SERIES.replace("p_brand as feature", "'s' || cast(l_suppkey as string) as feature").replace(" join part on l_partkey = p_partkey", "")


def supplier_columns(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    series = items.groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("metric"), F.last_day("l_shipdate").alias("date")
    ).agg(mean("l_quantity").alias("value")).withColumn("table", F.col("metric"))
    y = items.groupBy(F.last_day("l_shipdate").alias("date")).agg(mean("l_tax").alias("y"))
    return columns.pack(join_target(merge_panel(cut_lineage(series)), y))


@query("corr_filter_suppliers", f"""
with {MANY},
pairs as (select a.feature as i, b.feature as j, corr(a.value, b.value) as r
  from series a join series b on a.date = b.date and a.feature < b.feature group by a.feature, b.feature)
select distinct feature from series where feature not in (select j from pairs where abs(r) > 0.4)""")
def corr_filter_suppliers(spark, sf_dir):
    return select.drop_correlated(supplier_columns(spark, sf_dir), cut=0.4).select("feature")


# Lattice paths to (n, m) that stay below the statistic, one diagonal a step.
@query("two_sample_p", f"""
with recursive {MANY},
flagged as (select feature, case when value > 25.5 then 1 else 0 end as x, y from points),
size as (select feature, count(*) filter (x = 1) as n, count(*) filter (x = 0) as m from flagged group by feature),
gaps as (select feature, abs(count(*) filter (x = 1) over upto * m - count(*) filter (x = 0) over upto * n) as gap
  from flagged join size using (feature) window upto as (partition by feature order by y)),
stat as (select feature, n, m, max(gap) as reach from gaps join size using (feature) group by feature, n, m),
steps as (
  select feature, n, m, reach, 0::bigint as t, list_transform(range(0, n + 1), lambda i: 0::double) as share from stat where n > 0 and m > 0
  union all
  select feature, n, m, reach, t + 1, list_transform(range(0, n + 1), lambda i: case when t + 1 - i < 0 or t + 1 - i > m then 0
      when abs(i * m - (t + 1 - i) * n) >= reach then 1
      else (case when i > 0 then share[i] * i else 0 end + share[i + 1] * (t + 1 - i)) / (t + 1) end)
  from steps where t < n + m)
select feature, case when reach = 0 then 1 when n > 0 and m > 0 then {q_sql('share[n + 1]', 9)} end as p
from stat left join (select feature, share from steps where t = n + m) using (feature)""")
def two_sample_p(spark, sf_dir):
    found = supplier_columns(spark, sf_dir)
    halved = found.withColumn("xs", F.transform("xs", lambda x: F.when(x > 25.5, 1.0).otherwise(0.0)))
    return select.p_values(halved).select("feature", q(F.col("p"), 9).alias("p"))


@query("variance_top_k", f"""
with {SERIES},
size as (select count(distinct date) as n from series),
ranked as (select feature, var_samp(value) as v, row_number() over (order by var_samp(value) desc, feature) as rank from series group by feature)
select feature, {q_sql('v', 6)} as variance, rank from ranked, size where rank <= floor(n * 0.2)""")
def variance_top_k(spark, sf_dir):
    top = select.top_variance(brand_columns(spark, sf_dir), max_feature_ratio=0.2)
    return top.select("feature", q(F.col("variance"), 6).alias("variance"), "rank")


@query("standardise", f"""
with {SERIES},
stats as (select feature, avg(value) as m, stddev_pop(value) as s from series group by feature)
select feature, date, {q_sql('(value - m) / case when s = 0 then 1 else s end', 6)} as value from series join stats using (feature)""")
def standardise(spark, sf_dir):
    scaled = columns.unpack(columns.standardise(brand_columns(spark, sf_dir)))
    return scaled.select("feature", "date", q(F.col("value"), 6).alias("value"))


@query("pca_explained")
def pca_explained(spark, sf_dir):
    """Shares of variance of the kept components; checked against an SVD in the tests."""
    explained = reduce.pca(brand_columns(spark, sf_dir)).explained
    return explained.select("component", q(F.col("ratio"), 6).alias("ratio"), q(F.col("cumulative"), 6).alias("cumulative"))


@query("pca_scores")
def pca_scores(spark, sf_dir):
    scores = reduce.pca(brand_columns(spark, sf_dir)).scores
    return scores.select("date", "component", q(F.col("score")).alias("score"), "y")


_Z = f"""{SERIES},
stats as (select feature, avg(value) as m, stddev_pop(value) as s from series group by feature),
z as (select feature, date, (value - m) / case when s = 0 then 1 else s end as z from series join stats using (feature))"""


def _all_scores(spark, sf_dir):
    """Scores of all components, from which the features' inner products follow."""
    return reduce.pca(brand_columns(spark, sf_dir), variance=2.0, max_ratio=1.0).scores


@query("pca_gram", f"""
with {_Z}
select a.date as date, b.date as other, {q_sql('sum(a.z * b.z)')} as product from z a join z b on a.feature = b.feature and a.date <= b.date group by a.date, b.date""")
def pca_gram(spark, sf_dir):
    """Scores give the inner products of the standardised features back, date by date."""
    scores = cut_lineage(_all_scores(spark, sf_dir))
    a, b = scores.alias("a"), scores.alias("b")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.date") <= F.col("b.date")))
    return pairs.groupBy(F.col("a.date").alias("date"), F.col("b.date").alias("other")).agg(q(F.sum(F.col("a.score") * F.col("b.score"))).alias("product"))


@query("pca_trace", f"""
with {_Z}
select {q_sql('sum(z * z)')} as total, least(count(distinct feature), count(distinct date)) as components from z""")
def pca_trace(spark, sf_dir):
    return _all_scores(spark, sf_dir).agg(q(F.sum(F.col("score") * F.col("score"))).alias("total"), F.countDistinct("component").alias("components"))


def quantity_before(spark, sf_dir):
    """Mean quantity shipped in the month before: a target that some windows do tell."""
    items = table(spark, sf_dir, "lineitem")
    month = F.last_day(F.add_months("l_shipdate", 1))
    mean = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return items.groupBy(month.alias("date")).agg(mean.alias("y"))


@query("run_window_features")
def run_window_features(spark, sf_dir):
    """Scores of the three-table panel: window features, selection, components."""
    panel = monthly_panel(three_tables(spark, sf_dir), CFG)
    components, _ = train_components(panel, quantity_before(spark, sf_dir), CFG)
    return components.scores.select("date", "component", q(F.col("score")).alias("score"), "y")


@query("window_features_report")
def window_features_report(spark, sf_dir):
    """Counts of generated, selected and remaining features of the same run."""
    panel = monthly_panel(three_tables(spark, sf_dir), CFG)
    return train_components(panel, quantity_before(spark, sf_dir), CFG)[1]


@query("run_window_features_by_entity")
def run_window_features_by_entity(spark, sf_dir):
    """The same per market segment; each segment is selected and reduced on its own."""
    cfg: PanelConfig = replace(CFG, keys=("segment",))
    panel = monthly_panel(segment_tables(spark, sf_dir), cfg)
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    items = table(spark, sf_dir, "lineitem")
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    y = sold.groupBy(F.col("c_mktsegment").alias("segment"), F.last_day(F.add_months("l_shipdate", 1)).alias("date")).agg(
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("y")
    )
    components, _ = train_components(panel, y, cfg)
    return components.scores.select("segment", "date", "component", q(F.col("score")).alias("score"), "y")
