"""Writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import DATE, METRIC, VALUE
from ..operators.longform import metric_names


def write_parquet(df: DataFrame, path: str, *, date: str = DATE, mode: str = "overwrite") -> None:
    """The primary form: Parquet by year, so date filters prune folders.

    Rows of a year are brought together, but a year too large for one task is split again.
    """
    (
        df.withColumn("year", F.year(date))
        .hint("rebalance", "year")
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def write_csv(df: DataFrame, path: str, *, keys: Sequence[str] = (), date: str = DATE, mode: str = "overwrite") -> None:
    """CSV with a header, sorted by entity and date over the files; a small panel is one file."""
    out = df.repartitionByRange(*keys, date).sortWithinPartitions(*keys, date)
    out.write.mode(mode).option("header", True).csv(path)


def write_wide_csv(
    long: DataFrame, path: str, *, keys: Sequence[str] = (), names: Sequence[str] | None = None, mode: str = "overwrite"
) -> None:
    """The lines that `write_csv` writes of the pivoted panel (`to_wide`), from long rows and without a pivot.

    The cells of a line meet as a list in the order of the columns, where commas stand for the missing ones; so the
    plan does not grow with the number of columns. Only the header goes over the driver. Where a metric
    has several values on a date, the least stays. Keys or names with carriage returns or U+0001 are an error; use
    `write_csv` for those.
    """
    spark = long.sparkSession
    names = metric_names(long) if names is None else list(names)
    places = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{METRIC}` string, at int")
    cell = F.when(F.col("at").isNotNull() & F.col(VALUE).isNotNull(), F.struct("at", VALUE))
    lines = long.select(*keys, METRIC, DATE, VALUE).join(places, METRIC, "left").groupBy(*keys, DATE).agg(F.array_sort(F.collect_list(cell)).alias("sorted"))
    before = lambda i: F.when(i > 0, F.get("sorted", i - 1)["at"])
    lines = lines.select(*keys, DATE, F.filter("sorted", lambda c, i: ~c["at"].eqNullSafe(before(i))).alias("cells"))
    gap = lambda c, i: F.repeat(F.lit(","), c["at"] - F.when(i > 0, F.get("cells", i - 1)["at"]).otherwise(0))
    last = F.coalesce(F.get("cells", F.size("cells") - 1)["at"], F.lit(0))
    start = F.to_csv(F.struct(*keys, DATE))
    start = F.when(start.rlike("[\r\x01]"), F.raise_error(F.lit("a key holds a carriage return or U+0001"))).otherwise(start)
    line = F.concat(
        start, F.lit("," if names else ""),
        F.array_join(F.transform("cells", lambda c, i: F.concat(gap(c, i), c[VALUE].cast("string"))), ""),
        F.repeat(F.lit(","), F.lit(max(0, len(names) - 1)) - last),
    )
    titles = spark.createDataFrame([([*keys, DATE, *names],)], "titles array<string>").coalesce(1)
    header = titles.select(F.array_join(F.transform("titles", lambda t: F.to_csv(F.struct(t))), ",")).first()[0]

    if re.search("[\r\x01]", header):
        raise ValueError("a name holds a carriage return or U+0001")

    def headed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
            yield batch

    if long.isEmpty():
        out = titles.select(F.lit(header).alias("value"))
    else:
        ordered = lines.select(*keys, DATE, line.alias("value")).repartitionByRange(*keys, DATE).sortWithinPartitions(*keys, DATE)
        # A line break inside quotes ends a row here, as the writer below may see none.
        out = ordered.select(F.explode(F.split("value", "\n")).alias("value")).mapInArrow(headed, "value string")
    # The lines are ready: with a separator and a quote that they don't hold, the writer leaves them as they are.
    ready = {"sep": "\x01", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    out.write.mode(mode).options(**ready).csv(path)
