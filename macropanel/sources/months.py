"""Monthly states that are landed once and grow by batches of raw rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.resample import merge_states, monthly_state


class MonthStates:
    """The monthly states of series (see `monthly_state`) in a folder that all executors share, by batch of rows.

    A batch of new raw rows is aggregated by itself and written as `batch=<name>`: neither older raw rows nor
    older states are read for it. Reading adds up the states of all batches, some rows for each series and month,
    to what one aggregation over all rows gives; with `exact_scale` to the last bit, whatever the batches.

    A batch that is added again replaces itself, so a job that failed may simply be repeated. All batches must be
    made with the same keys and options. One writer a batch; while a batch is replaced, readers may miss it.
    """

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str] = (), *,
        carry: Sequence[str] = (), exact_scale: int | None = None, first_days: bool = False, table: bool = True,
    ):
        self.spark, self.folder, self.keys, self.table = spark, folder, list(keys), table
        self.carry, self.exact_scale, self.first_days = list(carry), exact_scale, first_days

    def add(self, rows: DataFrame, batch: str) -> None:
        """Land the states of a batch of long rows."""
        self._write(monthly_state(
            rows, self.keys, carry=self.carry, exact_scale=self.exact_scale, first_days=self.first_days,
            mergeable=True, table=self.table,
        ), batch)

    def _write(self, states: DataFrame, batch: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][\w.\-]*", batch):
            raise ValueError(f"no name of a batch: {batch!r}")
        states.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def _landed(self) -> DataFrame:
        landed = self.spark.read.option("recursiveFileLookup", "true").parquet(self.folder)
        return merge_states(landed, self.keys, carry=self.carry, table=self.table)

    def read(self) -> DataFrame:
        """The states of all batches together, as `monthly_state` over all rows gives them."""
        return self._landed().withColumn("total", F.col("total").cast("double"))

    def compacted(self, folder: str, batch: str = "all") -> MonthStates:
        """The same states as one batch of a new, empty folder; the old one stays until its owner drops it.

        What is in that batch can no longer be replaced by adding it again under its old name.
        """
        out = MonthStates(
            self.spark, folder, self.keys, carry=self.carry, exact_scale=self.exact_scale,
            first_days=self.first_days, table=self.table,
        )
        out._write(self._landed(), batch)
        return out
