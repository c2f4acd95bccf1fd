"""Monthly states that grow by batches."""

import glob

import numpy as np
import pytest
from macropanel.operators import resample
from macropanel.sources.months import MonthStates
from pyspark.sql import functions as F

KEYS = ["k"]


def rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    days = rng.integers(0, 200, n)
    values = [None if v < 20 else float(v) / 100 for v in rng.integers(0, 10_000, n)]
    data = [(f"k{i % 3}", "t", f"m{i % 2}", i % 2, int(d), v, v is None, "daily") for i, (d, v) in enumerate(zip(days, values))]
    df = spark.createDataFrame(data, "k string, table string, metric string, pos int, d int, value double, raw_null boolean, freq string")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).drop("d")


def collected(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_batches_add_up_to_one_aggregation(spark, tmp_path):
    options = {"carry": ["freq", "pos"], "exact_scale": 2, "first_days": True}
    parts = [rows(spark, 400, seed) for seed in (1, 2, 3)]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = collected(resample.monthly_state(everything, KEYS, **options))
    states = MonthStates(spark, str(tmp_path / "m"), KEYS, **options)
    for i, part in enumerate(parts):
        states.add(part, f"2024-{i}")
    states.add(parts[1], "2024-1")  # a repeated job changes nothing
    assert collected(states.read()) == want
    assert all(str(tmp_path) in f for f in states.read().inputFiles())
    small = states.compacted(str(tmp_path / "n"))
    assert collected(small.read()) == want
    assert len(glob.glob(f"{tmp_path}/n/batch=*")) == 1 and len(glob.glob(f"{tmp_path}/m/batch=*")) == 3
    # From the states on, the way to the panel is the same.
    got = resample.resample_state(small.read().drop("first_rows", "first_value", "first_empty"), KEYS)
    assert collected(got) == collected(resample.resample_monthly(everything, KEYS, exact_scale=2))


def test_an_empty_batch_and_bad_names(spark, tmp_path):
    states = MonthStates(spark, str(tmp_path / "m"), KEYS, exact_scale=2)
    states.add(rows(spark, 50, 4).limit(0), "none")
    assert states.read().count() == 0
    states.add(rows(spark, 50, 4), "some")
    assert collected(states.read()) == collected(resample.monthly_state(rows(spark, 50, 4), KEYS, exact_scale=2))
    for name in ("_hidden", "a/b", "", "../x"):
        with pytest.raises(ValueError):
            states.add(rows(spark, 1, 1), name)
