import csv
import datetime as dt
import glob

import numpy as np
import pytest
from macropanel.config import PanelConfig
from macropanel.operators import catalog as cat
from macropanel.plans import catalog_merge as cm
from macropanel.plans import job
from macropanel.plans.corpus import load_parse
from macropanel.plans.pipeline import run_pipeline
from macropanel.sources.sheets import readable
from pyspark.sql import functions as F


def month_starts(n):
    return [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(11)
    months = month_starts(72)
    driver = np.cumsum(rng.normal(size=73))
    with open(root / "monthly.csv", "w", encoding="utf-8") as f:
        f.write("日期,景气,噪声\n" + "".join(f"{d:%Y%m%d},{driver[i]:.6f},{rng.normal():.6f}\n" for i, d in enumerate(months)))
    with open(root / "quarterly.csv", "w", encoding="utf-8") as f:
        f.write("date,gdp\n" + "".join(f"{d:%Y-%m-%d},{rng.normal():.6f}\n" for d in months[::3]))
    (root / "out").mkdir()
    target = root.parent / "target.csv"
    with open(target, "w", encoding="utf-8") as f:  # follows the driver with one month of delay
        f.write("date,loans\n" + "".join(f"{d:%Y-%m-%d},{driver[i - 1]:.6f}\n" for i, d in enumerate(months) if i))
    return str(root), str(target)


def read_csv(path):
    (file,) = glob.glob(f"{path}/part-*.csv")
    with open(file, encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_merge_only(spark, folder, tmp_path):
    run = run_pipeline(spark, data_dir=folder[0], output_dir=str(tmp_path), csv=True)
    assert run.metadata["mode"] == "merge_only"
    assert run.table.columns == ["date", "景气_月度", "噪声_月度", "gdp_季度"]
    rows = read_csv(tmp_path / "features_merged.csv")
    assert len(rows) == 72 and list(rows[0]) == run.table.columns and rows[0]["date"] == "2015-01-31"


def test_variance_training_from_the_command_line(spark, folder, tmp_path):
    run = job.main(["--data-dir", folder[0], "--target-file", folder[1], "--output-dir", str(tmp_path), "--no-tsfresh", "--csv"])
    assert run.metadata["final_features"] == 3
    rows = read_csv(tmp_path / "train_no_pca.csv")
    assert len(rows) == 71
    # the feature is lagged like the target, so both show the same month
    assert all(float(r["景气_月度"]) == pytest.approx(float(r["y"])) for r in rows)
    assert {p.rsplit("/", 1)[-1] for p in run.metadata["output_files"]} == {
        "features_merged_long.parquet", "features_merged.csv", "train_no_pca.parquet", "train_no_pca.csv"
    }
    assert spark.read.parquet(f"{tmp_path}/train_no_pca.parquet").count() == 71


def test_window_feature_training(spark, folder, tmp_path):
    run = run_pipeline(spark, data_dir=folder[0], target_path=folder[1], output_dir=str(tmp_path), csv=True)
    m = run.metadata
    assert m["generated_features"] == 3 * 767
    assert m["generated_features"] > m["passed_fdr"] >= m["significant_features"] >= m["final_components"] >= 1
    assert 0 < m["explained_variance"] <= 1
    rows = read_csv(tmp_path / "train_pca.csv")
    # four rows are needed for the first window; the target lacks the first month
    assert len(rows) == 72 - 3
    assert list(rows[0])[0] == "date" and list(rows[0])[-1] == "y"
    again = np.corrcoef([float(r["PCA_1"]) for r in rows], [float(r["y"]) for r in rows])[0, 1]
    assert abs(again) > 0.7


def test_large_csv_and_parquet_as_input(spark, folder, tmp_path):
    """The same panel from a folder whose CSV is split over tasks, in GBK, and whose other table is Parquet."""
    import shutil

    from macropanel.sources.sheets import quarantine, scan_files

    with open(f"{folder[0]}/monthly.csv", encoding="utf-8") as f:
        lines = f.read()
    (tmp_path / "monthly.csv").write_bytes(lines.encode("gbk") + "20210101,1,2,77\n".encode())
    spark.read.option("header", True).csv(f"{folder[0]}/quarterly.csv").coalesce(1).write.parquet(str(tmp_path / "q"))
    (part,) = glob.glob(f"{tmp_path}/q/part-*.parquet")
    shutil.copy(part, tmp_path / "quarterly.parquet")
    names = [str(tmp_path / "monthly.csv"), str(tmp_path / "quarterly.parquet")]
    rows = scan_files(spark, names, bulk_bytes=100)
    assert "more cells than the header" in quarantine(rows).first()["reason"]
    corpus = load_parse(readable(rows))
    got = run_pipeline(spark, corpus=corpus).table
    want = run_pipeline(spark, data_dir=folder[0]).table
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_selected_gives_an_empty_table(spark, folder):
    run = run_pipeline(spark, data_dir=folder[0], target_path=folder[1], cfg=PanelConfig(fdr_level=1e-300))
    assert run.metadata["significant_features"] == 0
    assert run.table.count() == 0


def test_input_is_required(spark):
    with pytest.raises(ValueError):
        run_pipeline(spark)


# --- catalogs -----------------------------------------------------------------------------------


def landed(spark, rows):
    """(id, raw date, column, pos, text)."""
    return spark.createDataFrame(rows, "id string, raw_date string, metric string, pos int, text string")


CATALOG = "id string, name string, freq string, date_col string, columns array<string>, indicator string"


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([
        ("cpi", "CPI", "monthly", "month", ["yoy", "gone"], "M1"), ("ppi", "PPI", "monthly", "month", ["gone"], "M2"),
        ("fx", "FX", "daily", "trade_date", [], "M3"), ("empty", "Empty", "monthly", "month", [], "M4"),
    ], CATALOG)


def panel_rows(out):
    return {(r["metric"], str(r["date"])): r["value"] for r in out.panel.collect()}


def test_catalog_merge(spark, catalog):
    rows = []
    for m, (jan, other) in {"2024年01月份": ("0", "1"), "2024年02月份": ("8", "2"), "2024年03月份": ("5", "3")}.items():
        rows += [("cpi", m, "yoy", 0, jan), ("cpi", m, "mom", 1, other), ("ppi", m, "v", 0, other), ("ppi", m, "text", 1, "x")]
    rows += [("ppi", "2024年", "v", 0, "99"), ("other", "2024年01月份", "v", 0, "1")]
    out = cm.merge_selected(catalog, landed(spark, rows), ["cpi", "ppi", "empty", "nobody"], cm.SPELLED)
    got = panel_rows(out)
    assert {k[0] for k in got} == {"CPI_yoy_月度", "PPI_v_月度"}  # listed columns; else numeric ones
    assert [got["CPI_yoy_月度", d] for d in ("2024-01-31", "2024-02-29", "2024-03-31")] == [4.0, 4.0, 5.0]
    assert {r["id"] for r in out.fetched.collect()} == {"cpi", "ppi"}
    assert {r["id"] for r in out.failed.collect()} == {"empty", "nobody"}


def test_catalog_merge_coded_dates_and_range(spark, catalog):
    rows = [("fx", "20240131", "bid", 0, "7.1"), ("fx", "20240229", "bid", 0, "7.2"), ("fx", "20240331", "bid", 0, "7.3"),
            ("cpi", "202402", "yoy", 0, "1"), ("cpi", "202403", "yoy", 0, "2")]
    out = cm.merge_selected(catalog, landed(spark, rows), ["fx", "cpi"], cm.CODED, start="2024-02-01", end="2024-03-31")
    got = panel_rows(out)
    assert got[("FX_bid_日度", "2024-02-29")] == 7.2 and ("FX_bid_日度", "2024-01-31") not in got
    assert got[("CPI_yoy_月度", "2024-03-31")] == 2.0


def test_catalog_merge_single_indicators(spark, catalog, tmp_path):
    rows = [(i, d, "value", 0, v) for i in ("cpi", "ppi") for d, v in (("2026-01-01", "0"), ("2026-02-01", "8"))]
    out = cm.merge_selected(catalog, landed(spark, rows), ["cpi", "ppi"], cm.SINGLE)
    got = panel_rows(out)
    assert got[("CPI_value_月度", "2026-01-31")] == 0.0 and len(got) == 4  # no January split
    assert out.failed.count() == 0
    counts = out.write(str(tmp_path))
    assert {k: counts[k] for k in ("selected", "fetched", "failed", "months", "metrics")} == {"selected": 2, "fetched": 2, "failed": 0, "months": 2, "metrics": 2}
    assert spark.read.parquet(f"{tmp_path}/panel.parquet").count() == 4


def test_search_and_override(spark, catalog):
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(cat.search(catalog, " PI ")) == {"cpi", "ppi"}
    assert ids(cat.search(catalog, "m3")) == set()
    assert ids(cat.search(catalog, "m3", ("id", "name", "indicator"))) == {"fx"}
    assert ids(cat.search(catalog)) == {"cpi", "ppi", "fx", "empty"}
    custom = catalog.filter("id = 'fx'").withColumn("name", F.lit("mine"))
    assert [r["name"] for r in cat.effective_catalog(catalog, custom).collect()] == ["mine"]
    assert ids(cat.effective_catalog(catalog, custom.limit(0))) == {"cpi", "ppi", "fx", "empty"}


def test_violations_counts_and_detected_frequency(spark, catalog):
    broken = catalog.withColumn("name", F.when(F.col("id") != "fx", F.col("name")))
    assert [(r["id"], r["missing"]) for r in cat.violations(broken).collect()] == [("fx", ["name"])]
    counts = {r["freq"]: (r["total"], r["selected"]) for r in cat.count_by_freq(catalog, cat.selection(spark, ["fx", "cpi"])).collect()}
    assert counts == {"monthly": (3, 1), "daily": (1, 1)}
    seen = spark.createDataFrame([("fx", "monthly"), ("cpi", "unknown")], "id string, freq string")
    assert {r["id"]: r["freq"] for r in cat.override_freq(catalog, seen).collect()} == {
        "fx": "monthly", "cpi": "monthly", "ppi": "monthly", "empty": "monthly"
    }


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('[{"id": "a", "name": "A", "freq": "daily", "indicator": "X1"},\n {"id": "a", "name": "B", "freq": "daily"}]')
    entries = cat.read_catalog(spark, str(path))
    assert cat.first_by_id(entries.orderBy("id"), "name").first()["name"] == "A"
    assert cat.first_by_id(entries).first()["name"] == "A" and cat.first_by_id(entries.repartition(5)).first()["name"] == "A"
    assert cat.unknown_ids(cat.selection(spark, ["a", "z"]), entries).first()["id"] == "z"
