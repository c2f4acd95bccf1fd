"""Merging selected catalog indicators from landed vendor data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..config import DATE, FREQ, METRIC, PanelConfig, POS, TABLE
from ..operators import catalog as cat
from ..operators.clean import choose_columns, in_date_range
from ..operators.merge import merge_panel, prefix_metrics, suffix_metrics
from ..operators.resample import monthly_state, resample_state, split_states
from ..session import cut_lineage
from ..sources.landed import normalise_landed
from ..sources.sinks import write_parquet


@dataclass(frozen=True)
class VendorPolicy:
    """How the tables of a vendor are read."""

    dates: str = "iso"          # chinese, coded or iso
    jan_feb: bool = False       # halve cumulated January-February values
    listed_only: bool = False   # keep the columns the catalog lists


# Vendors whose date columns hold Chinese spellings and whose catalog lists columns.
SPELLED = VendorPolicy(dates="chinese", jan_feb=True, listed_only=True)
# The same with dates coded by the name of the date column.
CODED = VendorPolicy(dates="coded", jan_feb=True, listed_only=True)
# Vendors that answer one indicator per request with plain dates.
SINGLE = VendorPolicy()


class CatalogPanel(NamedTuple):
    panel: DataFrame    # (metric, table_pos, pos, date, value)
    fetched: DataFrame  # (id)
    failed: DataFrame   # (id)
    selected: DataFrame  # (id, table_pos)

    def counts(self) -> DataFrame:
        """One row: selected, fetched and failed ids, months and metrics of the panel."""
        number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        shape = self.panel.agg(F.count_distinct(DATE).alias("months"), F.count_distinct(METRIC).alias("metrics"))
        return number(self.selected, "selected").join(number(self.fetched, "fetched")).join(number(self.failed, "failed")).join(shape)

    def write(self, folder: str) -> dict:
        """The panel and the lists of ids as Parquet under `folder`; the counts."""
        write_parquet(self.panel, f"{folder}/panel.parquet")
        self.fetched.write.mode("overwrite").parquet(f"{folder}/fetched.parquet")
        self.failed.write.mode("overwrite").parquet(f"{folder}/failed.parquet")
        return {**self.counts().first().asDict(), "output_files": [f"{folder}/{n}.parquet" for n in ("panel", "fetched", "failed")]}


def landed_series(
    selected: DataFrame,
    catalog: DataFrame,
    landed: DataFrame,
    policy: VendorPolicy,
    *,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Landed rows of the selected ids with parsed dates, in the date range, with `table`, `name`,
    `freq` and `table_pos` of their catalog entry."""
    dated_by = ["date_col"] if policy.dates == "coded" else []
    entries = cat.lookup(selected, catalog).select("id", "name", FREQ, "table_pos", *dated_by)
    carried = ["name", FREQ, "table_pos"]
    dated = normalise_landed(landed.join(entries, "id"), policy.dates, carry=carried)
    return in_date_range(dated, start, end).withColumn(TABLE, F.col("id"))


def merge_catalog(
    selected: DataFrame,
    catalog: DataFrame,
    landed: DataFrame,
    policy: VendorPolicy,
    cfg: PanelConfig = PanelConfig(),
    *,
    start: str | None = None,
    end: str | None = None,
) -> CatalogPanel:
    """All selected indicators as one monthly panel, in one plan.

    `selected` is `(id, table_pos)`, `landed` is `(id, raw_date, metric, pos, text)`. The
    declared frequency of the catalog is used. The landed rows are read once, to monthly
    states; the January-February split and the choice of columns work on those.
    """
    series = landed_series(selected, catalog, landed, policy, start=start, end=end)
    state = cut_lineage(monthly_state(
        series, carry=[FREQ, POS, "table_pos", "name"], exact_scale=cfg.exact_scale, first_days=policy.jan_feb
    ))
    served = state.select(F.col(TABLE).alias("id")).distinct()
    if policy.jan_feb:
        state = split_states(state, where=F.col(FREQ).isin("daily", "monthly"))
    if policy.listed_only:
        state = choose_columns(state, catalog, id_col=TABLE, numeric=F.col("not_number") == 0)
    monthly = resample_state(
        prefix_metrics(state), missing_threshold=cfg.missing_threshold, check_after_cast=cfg.check_after_cast,
        keep_empty=True,
    )
    panel = merge_panel(
        suffix_metrics(cut_lineage(monthly)), fill_single=cfg.fill_single, strict_past=cfg.strict_past
    )
    return CatalogPanel(panel, served, cat.failed_ids(selected, catalog, served).select("id"), selected)


def merge_selected(
    catalog: DataFrame, landed: DataFrame, ids: Sequence[str], policy: VendorPolicy, cfg: PanelConfig = PanelConfig(),
    **dates: str | None,
) -> CatalogPanel:
    """`merge_catalog` for a list of ids."""
    selected = cat.selection(catalog.sparkSession, ids)
    return merge_catalog(selected, cat.first_by_id(catalog), landed, policy, cfg, **dates)
