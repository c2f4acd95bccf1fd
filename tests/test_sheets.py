import datetime as dt
import io
import json
import zipfile

import pytest
from macropanel.operators import profile
from macropanel.plans.corpus import auto_parse, declared_parse
from macropanel.plans.pipeline import ingest_auto, ingest_directory, ingest_manual
from macropanel.sources import sheets
from macropanel.sources.landed import flatten_answers, normalise_table
from pyspark.sql import functions as F

ROWS = "path string, row long, cells array<string>"


def corpus(spark, *grids):
    rows = [(f"f{i}", r, list(cells)) for i, grid in enumerate(grids) for r, cells in enumerate(grid)]
    return spark.createDataFrame(rows, ROWS)


def profile_of(parsed, path="f0"):
    return parsed.profiles.filter(F.col("path") == path).first()


def date_idx(spark, grid):
    rows = corpus(spark, grid)
    headers = profile.plain_headers(rows)
    found = profile.date_column(rows, headers, profile.sheet_metadata(rows, headers)).first()
    return found and found["date_idx"]


@pytest.mark.parametrize("grid, expected", [
    ([("指标名称", "CPI"), ("20260101", "1"), ("20260201", "2")], 0),
    ([("CPI", "日期"), ("1", "20260101"), ("2", "20260201")], 1),
    ([("A", "B"), ("20260101", "1.0"), ("20260201", "2.0"), ("20260301", "3.0")], 0),
    ([("col1", "col2"), ("2026-01-01", "100"), ("2026-02-01", "200"), ("2026-03-01", "300")], 0),
    ([("a", "b"), ("2026年01月", "100"), ("2026年02月", "200"), ("2026年03月", "300")], 0),
    ([("foo", "bar"), ("频率", "月"), ("单位", "%"), ("20260101", "1.0"), ("20260201", "2.0")], 0),
    ([("x", "y"), ("1.0", "4.0"), ("2.0", "5.0"), ("3.0", "6.0")], None),
    ([("x", "y"), ("20260101", "4.0"), ("20260101", "5.0")], None),  # one date only
    ([("x", "y"), ("20260101", "a"), ("20260201", "b"), (None, "c")], None),  # a missing cell counts against
    ([("x", "y"), ("频率", "20260101"), ("20260101", "20260201")], 1),  # too short: metadata rows count again
])
def test_date_column(spark, grid, expected):
    assert date_idx(spark, grid) == expected


@pytest.mark.parametrize("rows, expected", [
    ([("频率", "月"), ("单位", "%"), ("20260101", "1.0")], (2, "monthly", "%")),
    ([("频率", "日"), ("单位", "元"), ("20260101", "1.0")], (2, "daily", "元")),
    ([("频率", "季"), ("20260101", "1.0")], (1, "quarterly", None)),
    ([("20260101", "1.0"), ("20260102", "2.0")], (0, "unknown", None)),
    ([("20260101", "1.0"), ("频率", "年")], (0, "yearly", None)),  # not leading, still read
    ([("单位", None), ("频率", "周"), ("20260101", "1.0")], (2, "weekly", None)),
])
def test_metadata(spark, rows, expected):
    sheet = corpus(spark, [("指标名称", "a"), *rows])
    found = profile.sheet_metadata(sheet, profile.plain_headers(sheet)).first()
    assert (found["metadata_rows"], found["freq"], found["unit"]) == expected


@pytest.mark.parametrize("grid, names, offset", [
    ([("Unnamed: 0", "Unnamed: 1", "Unnamed: 2"), ("指标名称", "CPI", None), ("20260101", "1", "2")], ["指标名称", "CPI", "col_2"], 1),
    ([("指标名称", "CPI", "GDP", "Unnamed: 3"), ("20260101", "1", "2", "备注"), ("20260201", "3", "4", "x")], ["指标名称", "CPI", "GDP", "备注"], 0),
    ([("指标名称", "CPI"), ("20260101", "1")], ["指标名称", "CPI"], 0),
    ([("0", "1.5", "x"), ("a", "b", "c")], ["a", "b", "c"], 1),
])
def test_header_repair(spark, grid, names, offset):
    found = profile.fixed_headers(corpus(spark, grid)).first()
    assert (found["names"], found["offset"]) == (names, offset)


def test_keyword_columns(spark):
    headers = profile.header_cells(corpus(spark, [("id", "update_flag", "Trade_DATE")], [("x", "y")], [(" 时间 ", "date")]))
    found = {r["path"]: r["date_idx"] for r in profile.date_column_by_keyword(headers).collect()}
    assert found == {"f0": 1, "f2": 0}  # `update_flag` contains `date`


def test_first_of_duplicates(spark):
    kept = profile.first_of_duplicates(profile.header_cells(corpus(spark, [("a", "b", "a")])))
    assert sorted((r["col"], r["name"]) for r in kept.collect()) == [(0, "a"), (1, "b")]


def test_auto_parse(spark):
    parsed = auto_parse(corpus(
        spark,
        [("指标名称", "CPI同比"), ("频率", "月"), ("单位", "%"), ("20260331", "3.3"), ("20260228", "2.4"), ("20260131", "2.4")],
        [("指标名称", "CPI", "备注", "地区"), ("20260101", "1.0", "x", "a"), ("20260102", "2.0", "y", "b"), ("20260103", None, "z", "c")],
        [("Unnamed: 0", "Unnamed: 1"), ("日期", "GDP"), ("2026-01-01", "1"), ("2026-04-01", "2"), ("2026-07-01", "3")],
        [("p", "q"), ("1", "2"), ("3", "4")],
        [("日期", "note"), ("20260101", "x"), ("20260201", "y")],
    ))
    first = profile_of(parsed)
    assert (first["date_col"], first["data_cols"], first["freq"], first["unit"], first["rows"]) == ("指标名称", ["CPI同比"], "monthly", "%", 3)
    assert (profile_of(parsed, "f1")["data_cols"], profile_of(parsed, "f1")["freq"]) == (["CPI"], "daily")
    third = profile_of(parsed, "f2")
    assert (third["data_cols"], third["rows"], third["freq"]) == (["GDP"], 2 + 1, "quarterly")
    assert {r["path"]: r["reason"] for r in parsed.rejects.collect()} == {
        "f3": "no date column found", "f4": "no numeric data columns found"
    }
    rows = parsed.long.filter("table = 'f1'").orderBy("date").collect()
    assert [r["value"] for r in rows] == [1.0, 2.0, None]


def test_strict_parse(spark):
    parsed = auto_parse(
        corpus(spark, [("日期", "note"), ("20260101", "x"), ("20260201", "y")], [("日期", "v"), ("2026-01-01", "1")]),
        fix_headers=False, free_dates=False, require_numeric=False,
    )
    assert (profile_of(parsed)["data_cols"], profile_of(parsed)["rows"]) == ([], 2)
    assert profile_of(parsed, "f1")["rows"] == 0
    assert parsed.rejects.count() == 0


def test_declared_parse_keeps_text_columns_and_first_duplicates(spark):
    parsed = declared_parse(corpus(spark, [("月份", "v", "v", "t"), ("2026年1月", "1", "9", "x"), ("2026年2月", "2", "9", "y")]), "monthly")
    got = sorted((r["metric"], str(r["date"]), r["value"]) for r in parsed.long.filter("metric != 't'").collect())
    assert got == [("v", "2026-01-01", 1.0), ("v", "2026-02-01", 2.0)]
    assert [r["value"] for r in parsed.long.filter("metric = 't'").collect()] == [None, None]


# --- files ---------------------------------------------------------------------------------


def workbook(cells, styles=None, strings=(), broken=False):
    """A minimal workbook; `cells` maps references to (type, style, text)."""
    rows = {}
    for ref, cell in cells.items():
        rows.setdefault(int("".join(c for c in ref if c.isdigit())), []).append((ref, *cell))
    body = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{ref}" t="{t}" s="{s}"><v>{v}</v></c>' if v is not None else f'<c r="{ref}"/>' for ref, t, s, v in cs) + "</row>"
        for r, cs in sorted(rows.items())
    )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        if styles or broken:
            z.writestr("xl/styles.xml", "<styleSheet><broken" if broken else f"<styleSheet {ns}>{styles}</styleSheet>")
    return out.getvalue()


CELLS = {
    "A1": ("s", 0, 0), "B1": ("s", 0, 1), "C1": ("s", 0, 1), "A2": ("n", 1, 45292), "B2": ("n", 0, "1.5"),
    "A3": ("n", 1, 45323), "B3": ("n", 0, "2"), "C3": ("str", 0, "x"), "AB3": ("n", 0, "7"),
}
DATED = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'


def test_workbook_cells():
    grid = sheets.decode_xlsx(workbook(CELLS, DATED, ["日期", "v"]))
    assert grid[0][:3] == ["日期", "v", "v.1"] and len(grid[0]) == 28
    assert grid[1][:3] == ["2024-01-01", "1.5", None]
    assert (grid[2][0], grid[2][1], grid[2][2], grid[2][27]) == ("2024-02-01", "2", "x", "7")


def test_damaged_styles_do_not_matter():
    grid = sheets.decode_xlsx(workbook(CELLS, None, ["日期", "v"], broken=True))
    assert grid[1][:2] == ["45292", "1.5"]


def test_csv_encodings():
    text = "日期,值\n20240101,1\n\n20240201,NA\n20240301\n"
    want = [["日期", "值"], ["20240101", "1"], ["20240201", None], ["20240301", None]]
    assert sheets.decode_csv(text.encode("utf-8")) == want
    assert sheets.decode_csv(text.encode("gbk")) == want


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    months = [f"{y}{m:02d}01" for y in (2022, 2023) for m in range(1, 13)]
    lines = lambda name, scale: f"日期,{name}\n" + "".join(f"{d},{i * scale}\n" for i, d in enumerate(months))
    (tmp_path / "a.csv").write_bytes(lines("甲", 1).encode("gbk"))
    (tmp_path / "sub" / "b.csv").write_text(lines("乙", 2), encoding="utf-8")
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    cells = {"A1": ("s", 0, 0), "B1": ("s", 0, 1)}
    for i, d in enumerate(days, 2):
        cells[f"A{i}"], cells[f"B{i}"] = ("n", 0, d.strftime("%Y%m%d")), ("n", 0, i)
    (tmp_path / "sub" / "c.xlsx").write_bytes(workbook(cells, None, ["date", "rate"], broken=True))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "old.xls").write_bytes(b"BIFF")
    (tmp_path / "nodate.csv").write_text("a,b\n1,2\n")
    (tmp_path / "readme.txt").write_text("ignored")
    return tmp_path


def names(frame, column="path"):
    return {r[column].rsplit("/", 1)[-1]: r for r in frame.collect()}


def test_directory(spark, folder):
    found = ingest_directory(spark, str(folder))
    freqs = {k: r["freq"] for k, r in names(found.profiles).items()}
    assert freqs == {"a.csv": "monthly", "b.csv": "monthly", "c.xlsx": "daily"}
    rejects = {k: r["reason"] for k, r in names(found.rejects).items()}
    assert set(rejects) == {"bad.xlsx", "old.xls", "nodate.csv"}
    assert rejects["nodate.csv"] == "no date column found" and "unsupported" in rejects["old.xls"]


def test_upload_flows(spark, folder, tmp_path):
    auto = ingest_auto(spark, str(folder), landing=str(tmp_path / "landing"))
    assert {k: r["freq"] for k, r in names(auto.profiles).items()} == {"a.csv": "monthly", "b.csv": "monthly", "c.xlsx": "daily"}
    manual = ingest_manual(spark, {"daily": [str(folder / "sub" / "c.xlsx")], "monthly": [str(folder / "a.csv")], "quarterly": []})
    assert {k: r["freq"] for k, r in names(manual.profiles).items()} == {"a.csv": "monthly", "c.xlsx": "daily"}
    with pytest.raises(ValueError):
        ingest_manual(spark, {"daily": []})


def test_bulk_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("d,v,v\n20240101,1,2\n20240102,,NA\n20240103,1,2,77\n")
    rows = sheets.scan_bulk_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [r["cells"] for r in rows if r["error"] is None] == [["d", "v", "v.1"], ["20240101", "1", "2"], ["20240102", None, None]]
    assert [r["row"] for r in rows if r["error"]] == [-1]


@pytest.mark.parametrize("split", ["7", "40"])
def test_odd_csv_is_the_same_at_every_size(spark, tmp_path, split):
    """Whether a file is decoded by one task or split, also inside quoted cells."""
    odd = {
        "breaks": 'd,"a\nb",c\r\n1,"x\n\ny ""z"", \n",2\r\n\r\n2,q"r,"s"t\r\n3,"",\n' + '4,"' + "line\n" * 30 + '",5\n6,7,8',
        "ragged": 'd,v\n1,2,\n1,2,,x\n3,4\n5\n6,"7\n8",9\n',
        "open": 'd,v\n1,2\n3,"4\n5,6\n', "unended": 'd,v\n1,"2\n3', "bom": '\ufeff"d\n",v\n1,2\n', "blank": "\n\n\r\n",
        "returns": "d,v\r1,2\r3,4\r", "long": 'd,v\n1,"' + "x\n" * 70_000 + '"\n2,3\n', "gbk": '日期,"值\n一"\n1,二\n',
    }
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, text in odd.items():
            path = tmp_path / f"{name}.csv"
            path.write_bytes(text.encode("gbk" if name == "gbk" else "utf-8"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000" if name == "long" else split)
            small, large = (sorted(((r["row"], r["cells"], r["error"]) for r in sheets.scan_files(spark, str(path), bulk_bytes=b).collect()), key=str) for b in (1 << 20, 0))
            assert small == large, name
            assert name in ("blank", "long") or any(r[1] for r in small), name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bulk_csv_of_carriage_returns_is_split_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_LINE", 30)
    content = 'd,v\r' + '1,"a\rb"\r' * 20 + "2,3"
    (tmp_path / "x.csv").write_bytes(content.encode())
    small, large = (sorted(((r["row"], r["cells"], r["error"]) for r in sheets.scan_files(spark, str(tmp_path), bulk_bytes=b).collect()), key=str) for b in (1000, 0))
    assert small == large and len(small) == 22


def test_a_cell_too_many_puts_the_file_aside():
    with pytest.raises(ValueError, match="line 3 has 3 cells, the header 2"):
        sheets.decode_csv(b"date,a\n2024-01-01,1\n2024-01-02,1,77\n")
    assert sheets.decode_csv(b"a,a,,a,a.1\n1,2,3,4,5\n")[0] == ["a", "a.2", "", "a.3", "a.1"]


# --- landed vendor data ------------------------------------------------------------------------


def test_answers(spark):
    table = [["2026-01-01", "1.0"], ["2026-02-01", "2.0"], ["bad", "3"]]
    payloads = [
        ("nested", json.dumps({"errorcode": 0, "tables": [{"header": ["时间", "CPI"], "table": table}]})),
        ("flat", json.dumps({"errorcode": 0, "header": ["时间", "CPI"], "tables": [["2026-01-01", 5]]})),
        ("error", json.dumps({"errorcode": -4318, "errmsg": "denied"})),
        ("code", json.dumps({"code": 7, "message": "old"})),
        ("empty", json.dumps({"errorcode": 0, "tables": []})),
    ]
    out = flatten_answers(spark.createDataFrame(payloads, "id string, payload string"))
    got = sorted((r["id"], str(r["date"]), r["metric"], r["value"]) for r in out.long.collect())
    assert got == [("flat", "2026-01-01", "CPI", 5.0), ("nested", "2026-01-01", "CPI", 1.0), ("nested", "2026-02-01", "CPI", 2.0)]
    assert {r["id"]: r["reason"] for r in out.errors.collect()} == {"error": "-4318: denied", "code": "7: old", "empty": "empty answer"}


def test_vendor_table(spark):
    raw = spark.createDataFrame([("2026年04月份", 1.0), ("2026年", 2.0)], "`月份` string, v double")
    got = normalise_table(raw, "月份", "chinese").collect()
    assert [(str(r["指标名称"]), r["v"]) for r in got] == [("2026-04-01", 1.0)]
    coded = spark.createDataFrame([("2026Q2", 1.0)], "quarter string, v double")
    assert str(normalise_table(coded, "quarter", "coded").first()["指标名称"]) == "2026-04-01"
    with pytest.raises(ValueError, match="not found"):
        normalise_table(raw, "gone", "chinese")


def test_parquet_and_csv_have_the_same_missing_cells(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 10
    values, texts = [1.5, 2.5] + [float("nan")] * (n - 2), ["x", "y"] + ["NA"] * 4 + ["", "null", "None", None]
    pq.write_table(pa.table({"日期": [f"2024-01-{i + 1:02d}" for i in range(n)], "number": values, "text": texts}), tmp_path / "a.parquet")
    lines = ["日期,number,text"] + [f"2024-01-{i + 1:02d},{v},{t or ''}" for i, (v, t) in enumerate(zip(values, texts))]
    (tmp_path / "b.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = sheets.scan_files(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.csv")]).where("error is null").collect()
    by_file = {end: [r.cells for r in sorted(rows, key=lambda r: r.row) if r.path.endswith(end)] for end in (".parquet", ".csv")}
    assert by_file[".parquet"] == by_file[".csv"] and len(by_file[".csv"]) == n + 1
    assert [sum(r[c] is None for r in by_file[".parquet"]) for c in (0, 1, 2)] == [0, 8, 8]


def test_parquet_files_of_one_layout_share_a_scan(spark, tmp_path):
    """Many small files in a plan of constant size, with names of all kinds; damaged ones are put aside."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def fill(folder, count):
        folder.mkdir()
        for i in range(count):
            name = f"数据 {i}+%20" if i % 2 else f"t-{i}"
            dates = [f"2024-{m:02d}-01" for m in (1, 2, 3)]
            columns = {"日期": dates, "a": [i, None, i + 1]} if i % 3 else {"日期": dates, "b": [0.5, float("nan"), i / 4], "c": ["x", "NA", ""]}
            pq.write_table(pa.table(columns), folder / f"{name}.parquet")
        return sheets.scan_files(spark, str(folder))

    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    few, many = fill(tmp_path / "few", 6), fill(tmp_path / "many", 400)
    assert size(few) == size(many)
    assert many.where("error is null").count() == 400 * 4
    (tmp_path / "few" / "bad.parquet").write_bytes(b"PAR1 no footer")
    by_size = []
    for bulk in (sheets.BULK_BYTES, 100):  # layouts from tasks, or from the driver
        if bulk == 100:
            (tmp_path / "few" / "bad.parquet").unlink()
        rows = sheets.scan_files(spark, str(tmp_path / "few"), bulk_bytes=bulk).collect()
        assert sum(r.error is not None for r in rows) == (bulk > 100)
        by_size.append(sorted((r.path, r.row, r.cells) for r in rows if r.error is None))
    assert by_size[0] == by_size[1] and len(by_size[0]) == 6 * 4
    of = {(p.rsplit("/", 1)[1], row): cells for p, row, cells in by_size[0]}
    assert of["数据 1+%20.parquet", 0] == ["日期", "a"] and of["数据 1+%20.parquet", 2] == ["2024-02-01", None]
    assert of["t-0.parquet", 1] == ["2024-01-01", "0.5", "x"] and of["t-0.parquet", 2] == ["2024-02-01", None, None]


def test_no_files(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("x")
    assert sheets.scan_files(spark, str(tmp_path)).count() == 0
