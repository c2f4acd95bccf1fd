"""Time the headline queries; prints one JSON line.

Every query runs once, to completion and without collecting its result, after a few have
warmed up the session. `--all` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from macropanel.session import build_session  # noqa: E402
from queries import QUERIES  # noqa: E402

HEADLINE = [
    "monthly_mean", "month_spine_gaps", "daily_trim_partial", "quarterly_interpolate",
    "detect_freq", "detect_freq_of_times", "numeric_coerce", "parse_chinese", "parse_by_column",
    "drop_sparse", "outer_merge_panel", "merge_fill", "merge_fill_by_entity", "leak_safe_lag",
    "rolling_windows", "jan_feb_split", "answer_flatten", "vendor_normalise", "catalog_merge_spelled",
    "corpus_auto_parse", "run_auto_corpus", "feat_moments", "feat_change", "feat_trend", "feat_spectral",
    "impute_features", "kendall_tau", "by_select", "corr_filter", "variance_top_k", "pca_scores",
    "run_variance", "run_window_features",
]

WARM_UP = ["monthly_mean", "merge_fill", "feat_moments"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    times = {}
    for name in [*WARM_UP, *names]:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    times = {name: times[name] for name in names}
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
