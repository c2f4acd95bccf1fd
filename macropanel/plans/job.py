"""Command line of a run: a script that calls `main()` goes to `spark-submit`.

The options follow from the fields of `PanelConfig` and the arguments of `run_pipeline`; their texts stand here once.
"""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from ..config import PanelConfig
from ..session import build_session
from .pipeline import Run, run_pipeline

# --- fixed values: spellings that existing calls use ---

# Argument of `run_pipeline`: option, default, help. An option without a value has a flag's meaning as its default.
RUN_OPTIONS = {
    "data_dir": ("--data-dir", MISSING, "folder with feature files: CSV, workbooks, Parquet"),
    "target_path": ("--target-file", None, "target file; without it the panel is merged only"),
    "target_col": ("--target-col", "y", "metric of the target file that is predicted"),
    "output_dir": ("--output-dir", "./output", "folder for results"),
}
# Field of `PanelConfig`: option and help; type and default are the field's.
CONFIG_OPTIONS = {
    "fdr_level": ("--fdr-level", "false discovery level of the selection"),
    "max_timeshift": ("--max-timeshift", "rows before a date that its window reaches back"),
    "min_timeshift": ("--min-timeshift", "rows before a date that its window needs"),
    "max_feature_ratio": ("--max-feature-ratio", "features kept per sample without window features"),
    "missing_threshold": ("--missing-value-threshold", "percentage of empty cells from which a column is dropped"),
}
NO_WINDOW_FEATURES = ("--no-tsfresh", "--no-window-features")

# --- own options ---

OWN_OPTIONS = {
    "keys": ("--keys", "columns that name an entity, separated by commas"),
    "jan_feb": ("--jan-feb", "how cumulated January values are split: exact_first_day or by_month"),
    "strict_past": ("--strict-past", "never fill a gap from later rows"),
    "prune_infeasible": ("--prune-infeasible", "leave out features that are constant for the window length"),
}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(description="Build a monthly panel and training table")
    for name, (option, default, text) in RUN_OPTIONS.items():
        made.add_argument(option, dest=name, help=text, **({"required": True} if default is MISSING else {"default": default}))
    made.add_argument(*NO_WINDOW_FEATURES, dest="window_features", action="store_false", help="keep lagged columns of largest variance instead")
    made.add_argument("--csv", action="store_true", help="write results as CSV as well as Parquet")
    known = {f.name: f for f in fields(PanelConfig)}
    for name, (option, text) in (CONFIG_OPTIONS | OWN_OPTIONS).items():
        default = known[name].default
        if isinstance(default, bool):
            made.add_argument(option, dest=name, action="store_true", help=text)
        elif isinstance(default, tuple):
            made.add_argument(option, dest=name, type=lambda t: tuple(filter(None, t.split(","))), default=default, help=text)
        else:
            made.add_argument(option, dest=name, type=str if default is None else type(default), default=default, help=text)
    return made


def main(argv: list[str] | None = None) -> Run:
    given = vars(parser().parse_args(argv))
    cfg = PanelConfig(**{name: given.pop(name) for name in CONFIG_OPTIONS | OWN_OPTIONS})
    return run_pipeline(build_session(), cfg=cfg, **given)


if __name__ == "__main__":
    main()
