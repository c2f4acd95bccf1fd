"""CSV files and workbooks as a corpus of rows, and plain bulk CSV."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import NA_TOKENS
from ..functions.values import missing, na_to_null

# CSV files above this size are split over tasks.
BULK_BYTES = 128 * 1024 * 1024
ROWS_SCHEMA = "path string, row long, cells array<string>, error string"
_MISSING = frozenset(NA_TOKENS)
# Built-in number formats of a workbook that show a date.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def scan_sheets(
    spark: SparkSession, path: str | list[str], *, recursive: bool = True, pattern: str = "*.{csv,xlsx,xls}", smaller_than: int | None = None
) -> DataFrame:
    """All CSV files and workbooks under `path` as `(path, row, cells, error)`.

    One task decodes one file, so a file must fit into a task; `smaller_than` leaves larger CSV files
    to `scan_bulk_csv`. A file that cannot be read gives one row with `error` set, and so does each CSV line
    with more cells than the header.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    if smaller_than is not None:
        files = files.filter((F.col("length") <= smaller_than) | ~F.lower("path").endswith(".csv"))
    return files.select("path", "content").mapInPandas(_decode_files, ROWS_SCHEMA)


def readable(rows: DataFrame) -> DataFrame:
    """The corpus without unreadable files."""
    return rows.filter("error is null").drop("error")


def quarantine(rows: DataFrame) -> DataFrame:
    """`(path, reason)` of unreadable files."""
    return rows.filter("error is not null").select("path", F.col("error").alias("reason"))


def scan_files(spark: SparkSession, path: str | list[str], *, recursive: bool = True, bulk_bytes: int = BULK_BYTES) -> DataFrame:
    """`scan_sheets`, with CSV files above `bulk_bytes` and Parquet files split over tasks.

    Only names and sizes are looked at to tell them apart. Parquet files of one layout share a scan; each large
    CSV file has its own.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{csv,parquet}").load(path)
    )
    is_csv = F.lower("path").endswith(".csv")
    large = [r["path"] for r in listed.filter(is_csv & (F.col("length") > bulk_bytes)).select("path").collect()]
    rows = scan_sheets(spark, path, recursive=recursive, smaller_than=bulk_bytes)
    for one in large:
        rows = rows.unionByName(scan_bulk_csv(spark, one))
    columnar = scan_parquet(spark, listed.filter(~is_csv), bulk_bytes=bulk_bytes)
    return rows if columnar is None else rows.unionByName(columnar)


# A record that a split cuts goes over the driver; a file with a longer one is put aside.
MOST_CUT = 16 * 1024 * 1024
# A file with longer lines between line feeds is split at bare carriage returns.
MOST_LINE = 64 * 1024 * 1024
# A line after which a quoted cell goes on: a quote counts at the start of a cell only, a doubled one inside is a letter.
_GOES_ON = re.compile(rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+)?+[,\r\n])*+"[^"]*+(?:""[^"]*+)*+\Z')


def _goes_on(line: bytes, inside: bool) -> bool:
    if b'"' not in line:
        return inside
    return _GOES_ON.match(b'"' + line if inside else line) is not None


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    pairs = (pair for batch in batches for pair in zip(batch.column("block").to_pylist(), batch.column("raw").to_pylist()))
    for block, group in itertools.groupby(pairs, lambda pair: pair[0]):
        yield block, (raw for _, raw in group)


def _records(block: int, lines: Iterable[bytes], inside: bool, cut: list[tuple[bool, bytes]], mark: bytes) -> Iterator[bytes]:
    """The whole records of a split; into `cut` what belongs to records that other splits begin or end."""
    held, begun = [], not inside
    for number, line in enumerate(lines):
        if block == number == 0:
            line = line.removeprefix(codecs.BOM_UTF8)
        held.append(line)
        inside = _goes_on(line, inside)
        if not inside:
            record = mark.join(held) + mark
            if begun:
                yield record
            else:
                cut.append((False, record[: MOST_CUT + 1]))
            held, begun = [], True
    if held:
        cut.append((begun, (mark.join(held) + mark)[: MOST_CUT + 1]))


def _grid(records: Iterable[bytes], encoding: str) -> Iterator[list[str]]:
    lines = (line for record in records for line in io.StringIO(record.decode(encoding), newline=""))
    return (line for line in csv.reader(lines) if line)


def scan_bulk_csv(spark: SparkSession, path: str) -> DataFrame:
    """A large CSV file with a header as the rows of `scan_sheets`, split over tasks.

    A split may begin inside a quoted cell. So each split first tells where it ends if it begins inside and if
    not; then the splits count their rows, and give the records they cut, one each at most, to the driver.
    Splits are cut at line feeds, or at carriage returns if line feeds are too rare.
    """
    text = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", MOST_LINE)
    cut_at = lambda mark: text.option("lineSep", mark.decode()).text(path).select(F.col("value").cast("binary").alias("raw"), F.input_file_block_start().alias("block"))
    aside = lambda reason: spark.createDataFrame([(path, -1, None, reason)], ROWS_SCHEMA)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _by_block(batches):
            outside, inside, utf8, size = False, True, True, 0
            for line in group:
                outside, inside, size = _goes_on(line, outside), _goes_on(line, inside), size + len(line) + 1
                if utf8 and not line.isascii():
                    try:
                        line.decode("utf-8")
                    except UnicodeDecodeError:
                        utf8 = False
            yield pa.RecordBatch.from_pydict({"block": [block], "outside": [outside], "inside": [inside], "utf8": [utf8], "size": [size]})

    length = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    for mark in (b"\n", b"\r"):
        lines = cut_at(mark)
        blocks = sorted(map(tuple, lines.mapInArrow(ends, "block long, outside boolean, inside boolean, utf8 boolean, size long").collect()))
        size = sum(b[4] for b in blocks)
        if length - len(codecs.BOM_UTF8) <= size <= length + 1:  # the reader left no line out
            break
    else:
        return aside(f"ValueError: a line of more than {MOST_LINE} bytes")
    encoding = "utf-8" if all(b[3] for b in blocks) else "gbk"
    begins, inside = {}, False
    for block, after_outside, after_inside, *_ in blocks:
        begins[block] = inside
        inside = after_inside if inside else after_outside

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _by_block(batches):
            cut, first, n, error = [], None, 0, None
            try:
                for line in _grid(_records(block, group, begins[block], cut, mark), encoding):
                    first, n = first or line, n + 1
            except (csv.Error, UnicodeDecodeError) as exc:
                error = f"{type(exc).__name__}: {exc}"
            rows = [pa.array([x], t) for x, t in ((block, pa.int64()), (n, pa.int64()), (first, pa.list_(pa.string())), (error, pa.string()), ([c[0] for c in cut], pa.list_(pa.bool_())), ([c[1] for c in cut], pa.list_(pa.binary())))]
            yield pa.RecordBatch.from_arrays(rows, names=["block", "n", "first", "error", "begun", "cut"])

    counted = sorted(lines.mapInArrow(counts, "block long, n long, first array<string>, error string, begun array<boolean>, cut array<binary>").collect(), key=lambda r: r["block"])
    if inside:  # the last cell is not closed: its text ends as the file does
        unended = size not in (length, length - len(codecs.BOM_UTF8))
    base, joined, header, total = {}, [], None, 0
    for at, r in enumerate(counted):
        if r["error"]:
            return aside(r["error"])
        base[r["block"]] = total
        header = header or r["first"]
        total += r["n"]
        if not any(r["begun"]):
            continue
        parts = [bytes(r["cut"][-1])]
        for later in counted[at + 1 :]:
            parts += [bytes(c) for c, begun in zip(later["cut"], later["begun"]) if not begun]
            if later["n"] or any(later["begun"]) or not later["cut"]:
                break
        record = b"".join(parts)
        if len(record) > MOST_CUT:
            return aside(f"ValueError: a record of more than {MOST_CUT} bytes, or a quote that is not closed")
        if inside and at + len(parts) == len(counted) and unended:
            record = record[:-1]
        try:
            found = list(_grid([record], encoding))
        except (csv.Error, UnicodeDecodeError) as exc:
            return aside(f"{type(exc).__name__}: {exc}")
        joined += [(total + i, line) for i, line in enumerate(found)]
        header = header or (found[0] if found else None)
        total += len(found)
    if not header:
        return aside("ValueError: empty file")
    width = len(header)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _by_block(batches):
            numbered = enumerate(_grid(_records(block, group, begins[block], [], mark), encoding), base[block])
            while some := list(itertools.islice(numbered, 10_000)):
                made = [_row(path, number, line, width) for number, line in some if number]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()))], names=["path", "row", "cells", "error"])

    head = [(path, 0, distinct_names(header), None)] + [_row(path, number, line, width) for number, line in joined if number]
    return spark.createDataFrame(head, ROWS_SCHEMA).unionByName(lines.mapInArrow(rows, ROWS_SCHEMA))


def scan_parquet(spark: SparkSession, files: DataFrame, *, bulk_bytes: int = BULK_BYTES) -> DataFrame | None:
    """Parquet files of plain columns as rows like those of `scan_sheets`; dates and numbers as text. None without files.

    `files` is `(path, length, content)` as the binary reader gives it. Files of equal columns and types, in equal
    order, share one scan, so the plan grows with the number of layouts and not with that of files. Layouts
    of files up to `bulk_bytes` are read in tasks; of a larger one only its footer is, by the driver. What has no
    footer gives a row with `error` set.

    The same cells are empty as in a CSV file of the same values: NaN, and the texts that stand for missing ones.
    """
    small = files.filter(F.col("length") <= bulk_bytes).select("path", "content")
    found = small.mapInArrow(_layouts, "path string, layout string, names array<string>, error string").collect()
    layouts: dict[str, list[str]] = {}
    heads = []
    for path, layout, names, error in found:
        heads.append((path, 0, names, None) if error is None else (path, -1, None, error))
        if names:
            layouts.setdefault(layout, []).append(path)
    for (path,) in files.filter(F.col("length") > bulk_bytes).select("path").collect():
        schema = spark.read.parquet(path).schema
        heads.append((path, 0, schema.names, None))
        layouts.setdefault(f"large {schema.simpleString()}", []).append(path)
    if not heads:
        return None
    rows = spark.createDataFrame(heads, ROWS_SCHEMA)
    # Parquet rows name their file as a URL, the binary reader by its plain path.
    plain_path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    for paths in layouts.values():
        df = spark.read.parquet(*paths)
        of = {f.name: f.dataType for f in df.schema.fields}
        cells = F.array(*[F.when(~missing(F.col(f"`{c}`"), of[c]), na_to_null(F.col(f"`{c}`").cast("string"))) for c in df.columns])
        rows = rows.unionByName(df.select(
            plain_path.alias("path"), (F.col("_metadata.row_index") + 1).alias("row"),
            cells.alias("cells"), F.lit(None).cast("string").alias("error"),
        ))
    return rows


def _layouts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names and types of the columns of Parquet files, from their footers."""
    for batch in batches:
        out = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                schema = pq.read_schema(pa.BufferReader(content.as_buffer()))
                out.append((path, "; ".join(f"{f.name}: {f.type}" for f in schema), schema.names, None))
            except (pa.ArrowException, OSError) as exc:
                out.append((path, None, None, f"{type(exc).__name__}: {exc}"))
        if out:
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["path", "layout", "names", "error"])


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            yield _decode_file(path, bytes(content))


def _decode_file(path: str, content: bytes) -> pd.DataFrame:
    try:
        if path.lower().endswith(".csv"):
            return _decode_csv_file(path, content)
        if path.lower().endswith(".xlsx"):
            grid = decode_xlsx(content)
        else:
            raise ValueError("unsupported file format")
        if not grid:
            raise ValueError("empty file")
    except Exception as exc:  # a bad file must not stop the job
        return pd.DataFrame({"path": [path], "row": [-1], "cells": [None], "error": [f"{type(exc).__name__}: {exc}"]})
    return pd.DataFrame({"path": path, "row": range(len(grid)), "cells": grid, "error": None})


def _decode_csv_file(path: str, content: bytes) -> pd.DataFrame:
    lines = _csv_lines(content)
    if not lines:
        raise ValueError("empty file")
    rows = [(path, 0, distinct_names(lines[0]), None)] + [_row(path, n, line, len(lines[0])) for n, line in enumerate(lines[1:], 1)]
    return pd.DataFrame(rows, columns=["path", "row", "cells", "error"])


def _row(path: str, number: int, line: list[str], width: int) -> tuple:
    """A row of `scan_sheets`; a line with more cells than the header is an error row of its own."""
    try:
        return path, number, _cells(number, line, width), None
    except ValueError as exc:
        return path, -1, None, f"ValueError: {exc}"


def decode_text(content: bytes) -> str:
    """UTF-8, else GBK."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gbk")


def distinct_names(names: list[str | None]) -> list[str | None]:
    """Later ones of equal names as `name.1`, `name.2`, as table readers number them; empty ones stay."""
    taken, out = {n for n in names if n}, []
    seen: dict[str, int] = {}
    for name in names:
        if not name:
            out.append(name)
            continue
        number = seen.get(name, -1) + 1
        fresh = name
        while number and (fresh := f"{name}.{number}") in taken:
            number += 1
        seen[name] = number
        taken.add(fresh)
        out.append(fresh)
    return out


def _csv_lines(content: bytes) -> list[list[str]]:
    return [line for line in csv.reader(io.StringIO(decode_text(content), newline="")) if line]


def _cells(number: int, line: list[str], width: int) -> list[str | None]:
    if len(line) > width:
        raise ValueError(f"line {number + 1} has {len(line)} cells, the header {width}: more cells than the header")
    return [None if c in _MISSING else c for c in line] + [None] * (width - len(line))


def decode_csv(content: bytes) -> list[list[str | None]]:
    """Header and data rows, all of the header's width; blank lines are skipped.

    A line with more cells than the header is an error: which of them belong to which name is not known.
    Lines are counted without the blank ones.
    """
    lines = _csv_lines(content)
    if not lines:
        return []
    return [distinct_names(lines[0])] + [_cells(number, line, len(lines[0])) for number, line in enumerate(lines[1:], 1)]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node, name: str):
    return (c for c in node if _local(c.tag) == name)


def _all(node, name: str):
    return (c for c in node.iter() if _local(c.tag) == name)


def _column_index(ref: str) -> int:
    index = 0
    for letter in re.match(r"[A-Za-z]+", ref).group().upper():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _optional_part(book: zipfile.ZipFile, name: str):
    """A part that may be missing or damaged; the values do not depend on it."""
    try:
        return ElementTree.fromstring(book.read(name))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile):
        return None


def _damaged(book: zipfile.ZipFile, name: str) -> bool:
    return name in book.namelist() and _optional_part(book, name) is None


def _first_sheet(book: zipfile.ZipFile) -> str:
    workbook = _optional_part(book, "xl/workbook.xml")
    links = _optional_part(book, "xl/_rels/workbook.xml.rels")
    if workbook is not None and links is not None:
        sheet = next(_all(workbook, "sheet"), None)
        if sheet is not None:
            wanted = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            for link in links:
                if link.get("Id") == wanted:
                    target = posixpath.normpath(posixpath.join("/xl", link.get("Target"))).lstrip("/")
                    if target in book.namelist():
                        return target
    return "xl/worksheets/sheet1.xml"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    styles = _optional_part(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))
        for f in _all(styles, "numFmt")
    }
    formats = next(_all(styles, "cellXfs"), None)
    dated = set()
    for i, xf in enumerate(_children(formats, "xf") if formats is not None else ()):
        code = int(xf.get("numFmtId", 0))
        if code in _DATE_FORMATS or re.search(r"[yd]", custom.get(code, ""), re.IGNORECASE):
            dated.add(i)
    return dated


def _number_text(text: str, as_date: bool) -> str | None:
    value = float(text)
    if as_date:
        moment = datetime(1899, 12, 30) + timedelta(days=value)
        return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def decode_xlsx(content: bytes) -> list[list[str | None]]:
    """First sheet of a workbook. Only strings and cells are needed, so a workbook whose styles
    or other parts are damaged is still read."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            table = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in _all(si, "t")) for si in _children(table, "si")]
        dated = _date_styles(book)
        # A workbook whose styles cannot be read keeps equal names, of which the first one counts later.
        renamed = not _damaged(book, "xl/styles.xml")
        sheet = ElementTree.fromstring(book.read(_first_sheet(book)))
    cells: dict[tuple[int, int], str | None] = {}
    for row in _all(sheet, "row"):
        for cell in _children(row, "c"):
            ref = cell.get("r")
            raw = next((v.text for v in _children(cell, "v")), None)
            kind = cell.get("t", "n")
            if kind == "s":
                at = int(raw) if raw else 0
                value = strings[at] if 0 <= at < len(strings) else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in _all(cell, "t"))
            elif kind == "n":
                value = _number_text(raw, int(cell.get("s", 0)) in dated) if raw else None
            elif kind == "b":
                value = "True" if raw == "1" else "False"
            else:
                value = raw or ""
            number = int(re.search(r"\d+", ref).group()) if ref else int(row.get("r"))
            cells[number, _column_index(ref)] = value
    if not cells:
        return []
    height = max(r for r, _ in cells)
    width = max(c for _, c in cells) + 1
    grid = [[cells.get((r, c)) for c in range(width)] for r in range(1, height + 1)]
    names = distinct_names(grid[0]) if renamed else grid[0]
    return [names] + [[None if v in _MISSING else v for v in line] for line in grid[1:]]
