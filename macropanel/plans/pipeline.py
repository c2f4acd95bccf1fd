"""The whole run: files or tables in, merged panel and training tables out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FREQ, PanelConfig
from ..operators.longform import to_wide, union_long
from ..operators.reduce import scores_wide
from ..session import cut_lineage
from ..sources.sheets import quarantine, readable, scan_files
from ..sources.sinks import write_csv, write_parquet, write_wide_csv
from .corpus import Corpus, auto_parse, declared_parse, load_parse
from .panel import monthly_panel
from .training import monthly_target, train_components, train_variance, wide_training


class Run(NamedTuple):
    table: DataFrame
    metadata: dict
    rejects: DataFrame | None
    report: DataFrame | None = None  # counts of the training, a row per entity


def ingest(spark: SparkSession, path: str | Sequence[str], *, landing: str | None = None, recursive: bool = True) -> DataFrame:
    """Decode files once; profiling reads the decoded rows, not the files, again and again."""
    rows = scan_files(spark, path, recursive=recursive)
    if landing:
        rows.write.mode("overwrite").parquet(landing)
        return spark.read.parquet(landing)
    return cut_lineage(rows)


def _with_quarantine(corpus: Corpus, rows: DataFrame) -> Corpus:
    return corpus._replace(rejects=corpus.rejects.unionByName(quarantine(rows)))


def ingest_directory(spark: SparkSession, path, *, cfg: PanelConfig = PanelConfig(), landing: str | None = None) -> Corpus:
    """All files of a directory tree with plain headers, frequency from the dates."""
    rows = ingest(spark, path, landing=landing)
    return _with_quarantine(load_parse(readable(rows), cfg.date_keywords), rows)


def ingest_auto(spark: SparkSession, paths, *, landing: str | None = None) -> Corpus:
    """Automatic detection of header, dates, columns and frequency; an unknown one counts as monthly."""
    rows = ingest(spark, paths, landing=landing)
    corpus = auto_parse(readable(rows))
    known = F.coalesce(F.nullif(FREQ, F.lit("unknown")), F.lit("monthly"))
    return _with_quarantine(corpus._replace(long=corpus.long.withColumn(FREQ, known)), rows)


def ingest_manual(spark: SparkSession, paths: dict[str, list[str]], *, landing: str | None = None) -> Corpus:
    """Files whose frequency the user states: `{"daily": [...], "monthly": [...], ...}`."""
    parts = []
    for freq, files in paths.items():
        if files:
            rows = ingest(spark, files, landing=f"{landing}/{freq}" if landing else None)
            parts.append(_with_quarantine(declared_parse(readable(rows), freq), rows))
    if not parts:
        raise ValueError("no files given")
    unite = lambda field: _union([getattr(p, field) for p in parts])
    return Corpus(unite("profiles"), unite("long"), unite("rejects"))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ordered_tables(long: DataFrame) -> DataFrame:
    """Number tables by name, which fixes the column order of the panel.

    File systems list files in no fixed order; names do not depend on where a file lies.
    """
    if "table_pos" in long.columns:
        return long
    return long.withColumn("table_pos", F.col("table"))


def _stored(table: DataFrame, folder: str, name: str, keys: Sequence[str], as_csv: bool) -> list[str]:
    """Write a result of a run, as Parquet and maybe as CSV; the paths."""
    write_parquet(table, f"{folder}/{name}.parquet")
    if not as_csv:
        return [f"{folder}/{name}.parquet"]
    write_csv(table, f"{folder}/{name}.csv", keys=keys)
    return [f"{folder}/{name}.parquet", f"{folder}/{name}.csv"]


def run_pipeline(
    spark: SparkSession,
    *,
    cfg: PanelConfig = PanelConfig(),
    data_dir: str | None = None,
    tables: Sequence[DataFrame] | None = None,
    corpus: Corpus | None = None,
    target: DataFrame | None = None,
    target_path: str | None = None,
    target_col: str = "y",
    output_dir: str | None = None,
    window_features: bool = True,
    save_intermediate: bool = True,
    csv: bool = False,
) -> Run:
    """Load, clean, merge and, if there is a target, make the training table.

    `tables` are long tables (see `to_long`), `corpus` is what one of the ingest functions gave, otherwise
    `data_dir` is read. Without a target the merged panel is the result. With one: window features and
    components, or, with `window_features=False`, the lagged columns of largest variance. Results
    go to `output_dir` as Parquet: the merged panel in long form, the training table in wide form;
    with `csv` also both as wide CSV.
    """
    rejects = None
    if tables is not None:
        long = union_long(tables)
    elif corpus is not None or data_dir is not None:
        corpus = corpus or ingest_directory(spark, data_dir, cfg=cfg)
        long, rejects = corpus.long, corpus.rejects
    else:
        raise ValueError("data_dir, corpus or tables must be given")
    panel = cut_lineage(monthly_panel(ordered_tables(long), cfg))
    written = []
    has_target = target is not None or target_path is not None
    if output_dir and (save_intermediate or not has_target):
        written += _stored(panel, output_dir, "features_merged_long", cfg.keys, False)
        if csv:
            write_wide_csv(panel, f"{output_dir}/features_merged.csv", keys=cfg.keys)
            written.append(f"{output_dir}/features_merged.csv")
    if not has_target:
        return Run(to_wide(panel, keys=cfg.keys), {"mode": "merge_only", "output_files": written}, rejects)
    if target is None:
        target = ingest_directory(spark, target_path, cfg=cfg).long
    y = cut_lineage(monthly_target(target, target_col, cfg))
    if window_features:
        components, report = train_components(panel, y, cfg)
        table, name = scores_wide(components, cfg.keys), "train_pca"
    else:
        trained = train_variance(panel, y, cfg)
        table, report, name = wide_training(trained, cfg), trained.metadata, "train_no_pca"
    if output_dir:
        written += _stored(table, output_dir, name, cfg.keys, csv)
    metadata = {"mode": name, "output_files": written}
    if not cfg.keys:
        metadata.update(report.first().asDict())
    return Run(table, metadata, rejects, report)
