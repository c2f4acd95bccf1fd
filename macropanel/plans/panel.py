"""Building the monthly panel from long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..config import FREQ, PanelConfig, POS
from ..operators.longform import to_wide, union_long
from ..operators.merge import merge_panel, suffix_metrics
from ..operators.resample import monthly_state, resample_state, split_states
from ..session import cut_lineage


def monthly_panel(tables: DataFrame | Sequence[DataFrame], cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Long tables to the merged monthly panel, as long rows.

    The source rows are read once, to month-end series; those are small and written down,
    because the merge needs them twice (the date axis of an entity and its series). The
    frequency of each series is in its `freq` column.
    """
    long = tables if isinstance(tables, DataFrame) else union_long(tables)
    carry = [c for c in (FREQ, POS, "table_pos") if c in long.columns]
    state = monthly_state(
        long, cfg.keys, carry=carry, exact_scale=cfg.exact_scale, first_days=cfg.jan_feb is not None
    )
    if cfg.jan_feb:
        state = split_states(state, cfg.keys, mode=cfg.jan_feb)
    monthly = resample_state(
        state, cfg.keys, missing_threshold=cfg.missing_threshold, check_after_cast=cfg.check_after_cast, keep_empty=True
    )
    return merge_panel(
        suffix_metrics(cut_lineage(monthly)), cfg.keys, fill_single=cfg.fill_single, strict_past=cfg.strict_past
    )


def merge_only(
    tables: DataFrame | Sequence[DataFrame], cfg: PanelConfig = PanelConfig(), names: Sequence[str] | None = None
) -> DataFrame:
    """The merged panel in wide form, one row per date."""
    return to_wide(monthly_panel(tables, cfg), names, keys=cfg.keys)
