"""Training tables: lagged panel, window features, selection and reduction against a target."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..config import DATE, FREQ, METRIC, PanelConfig, POS, VALUE
from ..functions.windows import GROUPS, with_features
from ..operators import columns as cols
from ..operators.clean import drop_all_null, target_series
from ..operators.frequency import detect_target_frequency
from ..operators.longform import attach, spread, to_wide
from ..operators.reduce import Components, pca
from ..operators.resample import monthly_state, resample_state
from ..operators.select import drop_correlated, p_values, select_by_fdr, top_variance
from ..operators.sequence import fill_both, fill_zero, leak_safe_lag, rolling_windows
from ..operators.target import attach_target, join_target, outer_concat
from ..session import cut_lineage


class Trained(NamedTuple):
    table: DataFrame
    metadata: DataFrame


def monthly_target(long: DataFrame, target_col: str = "y", cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """A target table in long form to `(keys, date, y)` at month ends, by its own frequency."""
    series = [*cfg.keys, "table", METRIC]
    freq = detect_target_frequency(long, series)
    # The frequency is joined to the months of a series, not to its rows.
    state = monthly_state(long.drop(FREQ), cfg.keys, carry=[POS], exact_scale=cfg.exact_scale).join(freq, series)
    monthly = resample_state(cut_lineage(state), cfg.keys, missing_threshold=cfg.missing_threshold)
    return target_series(monthly, target_col, cfg.keys)


def lagged_panel(panel: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The panel lagged by one period, gaps closed."""
    return leak_safe_lag(panel, cfg.keys, strict_past=cfg.strict_past, table=False)


def window_vectors(
    panel: DataFrame, cfg: PanelConfig = PanelConfig(), groups=GROUPS
) -> tuple[DataFrame, list[str]]:
    """Fill, lag, roll and describe each window by its features."""
    panel = spread(drop_all_null(panel, cfg.keys, table=False), *cfg.keys, METRIC)
    known = fill_zero(fill_both(panel, cfg.keys, table=False))
    rolled = rolling_windows(
        lagged_panel(known, cfg), cfg.keys,
        max_timeshift=cfg.max_timeshift, min_timeshift=cfg.min_timeshift, table=False,
    )
    return with_features(rolled, groups, max_timeshift=cfg.max_timeshift, prune_infeasible=cfg.prune_infeasible)


def feature_columns(
    panel: DataFrame, target: DataFrame, cfg: PanelConfig = PanelConfig(), groups=GROUPS
) -> DataFrame:
    """Imputed window features as feature columns over the dates of the target, with p-values.

    The panel is small next to its features and is written down first, which also lets the
    window stage choose its own number of tasks.
    """
    vectors, names = window_vectors(cut_lineage(panel), cfg, groups)
    columns = cols.transpose(attach_target(vectors, target, cfg.keys), names, cfg.keys)
    return p_values(cols.restrict_to_target(cols.impute(columns)))


def train_components(
    panel: DataFrame, target: DataFrame, cfg: PanelConfig = PanelConfig(), groups=GROUPS
) -> tuple[Components, DataFrame]:
    """Window features, false discovery filter, correlation filter and principal components.

    Returns the components and one row of counts per entity. The feature columns are used by
    several later steps and therefore written once. If nothing is selected for an entity, it
    has no components.
    """
    keys = list(cfg.keys)
    tested = cut_lineage(feature_columns(panel, target, cfg, groups))
    significant = select_by_fdr(tested, keys, fdr_level=cfg.fdr_level)
    survivors = cut_lineage(drop_correlated(significant, keys, cut=cfg.corr_cut))
    components = pca(survivors, keys, variance=cfg.pca_variance, max_ratio=cfg.pca_max_ratio)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    explained = components.explained.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("final_components"), F.max("cumulative").alias("explained_variance")
    )
    report = count(tested, "generated_features")
    for part in (count(significant, "passed_fdr"), count(survivors, "significant_features"), explained):
        report = report.join(part, keys, "left") if keys else attach(report, part)
    return components, report.fillna(0, ["passed_fdr", "significant_features", "final_components"])


def lagged_columns(panel: DataFrame, target: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The lagged panel as feature columns over the dates of the target."""
    return cols.pack(join_target(lagged_panel(panel, cfg), target, cfg.keys), cfg.keys)


def train_variance(panel: DataFrame, target: DataFrame, cfg: PanelConfig = PanelConfig()) -> Trained:
    """The lagged panel joined to the target, features limited by variance; long rows
    `(keys, feature, rank, date, value, y)` and one row of counts per entity."""
    keys = list(cfg.keys)
    columns = cut_lineage(lagged_columns(panel, target, cfg))
    chosen = top_variance(columns, keys, max_feature_ratio=cfg.max_feature_ratio)
    table = chosen.select(*keys, "feature", "rank", F.explode(F.arrays_zip("dates", "xs", "ys")).alias("p")).select(
        *keys, "feature", "rank", F.col("p.dates").alias(DATE), F.col("p.xs").alias(VALUE), F.col("p.ys").alias("y")
    )
    metadata = chosen.groupBy(*keys).agg(
        F.lit("variance").alias("method"),
        F.max("features").alias("original_features"),
        F.count(F.lit(1)).alias("final_features"),
        F.max("n").alias("n_samples"),
        F.lit(cfg.max_feature_ratio).alias("max_feature_ratio"),
    )
    return Trained(table, metadata)


def train_simple(
    panel: DataFrame, target: DataFrame, cfg: PanelConfig = PanelConfig(), names: list[str] | None = None
) -> DataFrame:
    """The lagged panel in wide form next to the target, all dates of both."""
    return outer_concat(to_wide(lagged_panel(panel, cfg), names, keys=cfg.keys), target, cfg.keys)


def wide_training(trained: Trained, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Training rows in wide form, features in rank order."""
    table = cut_lineage(trained.table)
    # One name for each column of the result, which has one column per feature by its nature.
    ranked = table.groupBy("feature").agg(F.min("rank").alias("rank")).orderBy("rank", "feature").collect()
    names = [r["feature"] for r in ranked]
    pivoted = table.groupBy(*cfg.keys, DATE).pivot("feature", names).agg(F.first(VALUE, ignorenulls=True).alias("v"), F.max("y").alias("y"))
    if not names:
        return pivoted.withColumn("y", F.lit(None).cast("double"))
    y = F.coalesce(*[F.col(f"`{n}_y`") for n in names]).alias("y")
    return pivoted.select(*cfg.keys, DATE, *[F.col(f"`{n}_v`").alias(n) for n in names], y)
