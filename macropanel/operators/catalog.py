"""The catalog of indicators: search, lookup, override, checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CATALOG_SCHEMA = (
    "id string, name string, freq string, source string, date_col string, "
    "columns array<string>, indicator string"
)
POSITION = "entry"
REQUIRED = ("id", "name", "freq", "indicator")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file, a JSON list of objects; `entry` is an entry's place in the list.

    The list is read as one text and unpacked by place, so the order does not depend on the reader.
    """
    kind = f"array<struct<{re.sub(r'(\w+) (\S+)', r'\1:\2', CATALOG_SCHEMA)}>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", kind)).alias(POSITION, "e")).select("e.*", POSITION)


def search(catalog: DataFrame, keyword: str = "", fields: Sequence[str] = ("id", "name")) -> DataFrame:
    """Entries with `keyword` in one of the fields, ignoring case; a blank keyword keeps all."""
    wanted = keyword.strip().lower()
    if not wanted:
        return catalog
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.contains(F.lower(field), F.lit(wanted)), F.lit(False))
    return catalog.filter(hit)


def selection(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    """The ids a user picked as `(id, table_pos)`; the place in the list orders the output."""
    return spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id string, table_pos int")


def first_by_id(catalog: DataFrame, order: str | None = None) -> DataFrame:
    """One entry per id: the first by `order`, which is the place in the file where that is known.

    Without either, all other columns decide, so that reruns agree.
    """
    by = [order] if order else [POSITION] if POSITION in catalog.columns else [c for c in catalog.columns if c != "id"]
    w = Window.partitionBy("id").orderBy(*by)
    return catalog.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def lookup(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog entries of the selected ids."""
    return catalog.join(selected, "id")


def unknown_ids(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected ids the catalog does not have."""
    return selected.join(catalog.select("id").distinct(), "id", "left_anti")


def failed_ids(selected: DataFrame, catalog: DataFrame, data: DataFrame) -> DataFrame:
    """Selected ids that are unknown or have no data."""
    served = catalog.select("id").join(data.select("id").distinct(), "id", "left_semi").distinct()
    return selected.join(served, "id", "left_anti")


def effective_catalog(default: DataFrame, custom: DataFrame) -> DataFrame:
    """The custom catalog when it has entries, else the default; they are never mixed."""
    some = custom.select(F.lit(1).alias("__some")).limit(1)
    kept = (
        default.withColumn("__some", F.lit(1))
        .join(F.broadcast(some), "__some", "left_anti")  # at most one row
        .drop("__some")
    )
    return custom.unionByName(kept)


def violations(catalog: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Entries that lack a required field, with the missing fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return catalog.withColumn("missing", missing).filter(F.size("missing") > 0)


def count_by_freq(catalog: DataFrame, selected: DataFrame) -> DataFrame:
    """Per frequency the number of entries and of selected ones."""
    picked = selected.select("id").distinct().withColumn("__picked", F.lit(True))
    return (
        catalog.join(picked, "id", "left")
        .groupBy("freq")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("__picked").alias("selected"))
    )


def override_freq(catalog: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected frequency instead of the declared one, unless it is unknown."""
    found = detected.select("id", F.nullif("freq", F.lit("unknown")).alias("__freq"))
    return (
        catalog.join(found, "id", "left")
        .withColumn("freq", F.coalesce("__freq", "freq"))
        .drop("__freq")
    )
