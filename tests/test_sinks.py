"""Written panels."""

import glob

import pytest
from helpers import day
from macropanel.operators.longform import to_wide
from macropanel.sources.sinks import write_csv, write_wide_csv
from pyspark.sql import functions as F

LONG = "k string, table string, metric string, pos int, date date, value double"
ROWS = [
    ("a", "t", "m0", 0, day("2024-01-31"), 1.0), ("a", "t", "m1", 1, day("2024-01-31"), None), ("a", "t", "m,2", 2, day("2024-01-31"), 1e10),
    ("a", "t", "m1", 1, day("2024-02-29"), -0.25), ('b "x", y', "t", "m,2", 2, day("2024-01-31"), 2.0), ("", "t", "m0", 0, day("2024-03-31"), None),
    (" two\nlines, \\ # ", "t", "m0", 0, day("2024-03-31"), 1.5), ("# back", "t", "m0", 0, day("2024-03-31"), 2.5),
    (None, "t", "m,2", 2, day("2024-03-31"), float("nan")), ("a", "t", 'q"3', 3, day("2024-02-29"), 3.0),
]


def lines(folder):
    """Header and sorted lines of all files; every file has the header."""
    files = [open(f, encoding="utf-8").read().splitlines() for f in glob.glob(f"{folder}/part-*")]
    heads = {f[0] for f in files}
    assert len(heads) == 1
    return heads.pop(), sorted(line for f in files for line in f[1:])


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_wide_lines_equal_the_pivot(spark, tmp_path, keys, rows):
    long = spark.createDataFrame([r for r in rows if keys or r[0] == "a"], LONG)
    names = [] if not rows else None
    write_csv(to_wide(long, names, keys=keys), f"{tmp_path}/pivot", keys=keys)
    write_wide_csv(long, f"{tmp_path}/lines", keys=keys, names=names)
    assert lines(f"{tmp_path}/lines") == lines(f"{tmp_path}/pivot")
    whole = lambda folder: [open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/{folder}/part-*.csv"))]
    assert whole("lines") == whole("pivot") and len(whole("lines")) == 1


def test_keys_that_lines_cannot_hold_are_refused(spark, tmp_path):
    long = spark.createDataFrame([("a\rb", *ROWS[0][1:])], LONG)
    with pytest.raises(Exception, match="carriage return"):
        write_wide_csv(long, f"{tmp_path}/x", keys=["k"])
    with pytest.raises(ValueError, match="carriage return"):
        write_wide_csv(long, f"{tmp_path}/x", names=["a\rb"])


def test_many_columns_and_unlisted_metrics(spark, tmp_path):
    n = 20_000
    long = spark.range(3 * n).select(
        F.lit("t").alias("table"), F.concat(F.lit("m"), F.col("id") % n).alias("metric"), (F.col("id") % n).cast("int").alias("pos"),
        F.last_day(F.add_months(F.lit("2024-01-01").cast("date"), (F.col("id") / n).cast("int"))).alias("date"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 2).alias("value"),
    )
    write_wide_csv(long, f"{tmp_path}/all")
    head, body = lines(f"{tmp_path}/all")
    assert head.split(",") == ["date", *[f"m{i}" for i in range(n)]]
    for month, line in enumerate(body):
        want = [str((month * n + i) / 2) if (month * n + i) % 7 else "" for i in range(n)]
        assert line.split(",") == [f"2024-0{month + 1}-{(31, 29, 31)[month]}", *want]
    write_wide_csv(long, f"{tmp_path}/some", names=["m5", "gone", "m1"])
    assert lines(f"{tmp_path}/some") == ("date,m5,gone,m1", ["2024-01-31,2.5,,0.5", "2024-02-29,10002.5,,10000.5", "2024-03-31,,,20000.5"])
