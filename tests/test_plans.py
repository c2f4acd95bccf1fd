"""What the physical plans must look like."""

import re

import pytest
from macropanel.config import PanelConfig
from macropanel.operators import resample, sequence
from macropanel.plans.panel import monthly_panel
from macropanel.plans.training import lagged_columns, window_vectors
from macropanel.session import cut_lineage
from queries.base import lineitem_long, orders_by_customer
from queries.panels import CFG, tax_target, three_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition", plan(df)))


def test_resampling_takes_two_exchanges(spark):
    """One combines months after map-side sums, one brings the months of a series together."""
    df = resample.resample_monthly(orders_by_customer(spark, SF), ["customer"], missing_threshold=20.0)
    assert shuffles(df) == 2
    assert "partial_sum" in plan(df) and "SortAggregate" not in plan(df)


def test_a_chain_along_a_series_adds_no_exchange(spark):
    monthly = resample.resample_monthly(orders_by_customer(spark, SF, "quarterly"), ["customer"])
    chain = sequence.rolling_windows(sequence.leak_safe_lag(sequence.fill_both(monthly, ["customer"]), ["customer"]), ["customer"])
    assert shuffles(chain) == 2


def test_scans_read_only_what_is_needed(spark):
    text = plan(resample.resample_monthly(lineitem_long(spark, SF)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}
    assert "IsNotNull(l_shipdate)" in text


def test_filters_reach_the_scan(spark):
    from macropanel.operators.clean import in_date_range

    events = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(in_date_range(events, "1996-01-01", "1996-12-31", date="o_orderdate"))
    assert re.search(r"DataFilters: .*o_orderdate#\d+ >= 1996-01-01", text) and "PushedFilters: [IsNotNull" in text


@pytest.mark.parametrize("build", [
    lambda s: monthly_panel(three_tables(s, SF), CFG),
    lambda s: lagged_columns(monthly_panel(three_tables(s, SF), CFG), tax_target(s, SF), CFG),
    lambda s: window_vectors(monthly_panel(three_tables(s, SF), CFG), PanelConfig(), ("moments",))[0],
])
def test_no_cross_join(spark, build):
    text = plan(build(spark))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_window_stage_keeps_its_partitions(spark):
    """The features are computed in the session's number of tasks, however few bytes there are."""
    panel = cut_lineage(monthly_panel(three_tables(spark, SF), CFG))
    vectors, _ = window_vectors(panel, CFG, ("moments",))
    assert "REPARTITION_BY_NUM" in plan(vectors)


def test_cells_of_a_column_do_not_meet_in_one_task(spark):
    """They are added up in the tasks that read them, before the join with their names."""
    from queries.sheets import scan_order_cells

    optimized = scan_order_cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(optimized) if "Join Inner" in line)
    assert "Aggregate" in "".join(optimized[joined + 1 : joined + 3])


def test_rows_of_a_long_series_are_dealt_over_tasks_when_sparse_ones_go(spark):
    from macropanel.operators import clean
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(
        F.lit("t").alias("table"), F.when(F.col("id") % 4 < 2, "full").when(F.col("id") % 4 == 2, "gappy").alias("metric"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("date"),
        F.when((F.col("id") % 4 < 2) | (F.col("id") % 3 > 0), F.col("id") % 7).cast("double").alias("value"),
    )
    kept = clean.drop_sparse(cut_lineage(rows), threshold=20.0)
    assert kept.columns == rows.columns
    assert [tuple(r) for r in kept.groupBy("metric").count().collect()] == [("full", 2000)]  # a series without a name goes as before
    joined = next(line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in line)
    assert "__slot" in joined
