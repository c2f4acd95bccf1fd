"""Fixed values and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass

# Canonical columns of the long form.
TABLE = "table"
METRIC = "metric"
POS = "pos"
DATE = "date"
VALUE = "value"
FREQ = "freq"

# --- fixed values (must equal the files and vendor tables this engine reads) ---

# Name every vendor table gives its date column.
VENDOR_DATE_COL = "指标名称"

# Header spellings that mark a date column, tested as lower-case substrings.
DATE_KEYWORDS = (
    "date", "time", "日期", "时间", "指标名称",
    "DATA_DATE", "trans_month", "stat_month", "trans_date", "stat_date",
)

# The shorter list used when the sampling frequency is declared by the caller.
DECLARED_DATE_KEYWORDS = ("Date", "date", "日期", "月份", "季度", "时间")

# Exact header spellings accepted when profiling a corpus of sheets.
SHEET_DATE_NAMES = ("日期", "date", "Date", "时间")

# Metadata labels and frequency codes in the first rows of a sheet.
FREQ_LABEL = "频率"
UNIT_LABEL = "单位"
FREQ_CODES = {"日": "daily", "月": "monthly", "季": "quarterly", "年": "yearly", "周": "weekly"}

# Column name suffix per frequency in a merged panel.
FREQ_SUFFIX = {"daily": "日度", "monthly": "月度", "quarterly": "季度"}

# Texts a CSV reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CORRELATION_CUT = 0.85

# --- end of fixed values ---


@dataclass(frozen=True)
class PanelConfig:
    """All knobs of a run; the defaults are the engine's documented defaults."""

    keys: tuple[str, ...] = ()
    missing_threshold: float = 20.0
    fdr_level: float = 0.05
    max_timeshift: int = 6
    min_timeshift: int = 3
    pca_variance: float = 0.95
    pca_max_ratio: float = 0.8
    max_feature_ratio: float = 0.6
    corr_cut: float = CORRELATION_CUT
    date_keywords: tuple[str, ...] = DATE_KEYWORDS
    # Fill a panel made of one table too (the default leaves it unfilled).
    fill_single: bool = False
    # Count a text cell as missing when it does not parse as a number.
    check_after_cast: bool = False
    # Fill lag gaps from the past only, never from later rows.
    strict_past: bool = False
    # Decimal digits for order-independent sums; None sums doubles.
    exact_scale: int | None = None
    # "exact_first_day", "by_month" or None.
    jan_feb: str | None = None
    # Leave out window features that no window of the configured length can tell from a constant.
    prune_infeasible: bool = False
