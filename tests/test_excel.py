"""Workbooks: dates, sheets, missing references, several workbooks by name."""

import datetime
import io
import zipfile

from tabsynth.plans.catalog import _xlsx_bytes
from tabsynth.sources import excel as X
from tabsynth.sources.load import load_dataset

D = datetime.datetime


def test_dates_sheets_and_column_order(spark, tmp_path):
    one = {"A": [["Report"], [], ["id", None, "date", "name"], [1, "x", D(2024, 1, 5), "a"], [2, "y", D(2024, 1, 6, 12, 30), None]], "B": [["id", "value"], [1, 2.5]]}
    two = {"A": [["name", "id", "date"], ["b", 3, None]], "B": [["value", "id"], ["n/a", 7]]}
    (tmp_path / "1.xlsx").write_bytes(_xlsx_bytes(one))
    (tmp_path / "2.xlsx").write_bytes(_xlsx_bytes(two))
    df, diag = load_dataset(spark, f"file:{tmp_path}", fmt="excel")
    assert df.dtypes == [("id", "bigint"), ("date", "timestamp_ntz"), ("name", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, D(2024, 1, 5), "a"), (2, D(2024, 1, 6, 12, 30), None), (3, None, "b")]
    assert diag.detected_header_row == 2 and [r["header"] for r in diag.files.orderBy("file").collect()] == [2, 0]
    by_name = load_dataset(spark, f"file:{tmp_path}", fmt="excel", sheet="B")[0]
    assert sorted(map(tuple, by_name.collect())) == [(1, 2.5), (7, None)]


def test_a_date_among_text_is_text(spark, tmp_path):
    (tmp_path / "1.xlsx").write_bytes(_xlsx_bytes({"A": [["id", "note"], [1, D(2024, 1, 5)], [2, "later"], [3, D(2024, 1, 5, 6)]]}))
    df = load_dataset(spark, f"file:{tmp_path}/1.xlsx", fmt="excel", header_override=0)[0]
    assert [r["note"] for r in df.orderBy("id").collect()] == ["2024-01-05", "later", "2024-01-05 06:00:00"]


def test_cells_without_references():
    data = _xlsx_bytes({"A": [["id", "name"], [1, "a"], [2, "b"]]})
    source, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in source.namelist():
            text = source.read(n).decode()
            if "sheet1" in n:
                for ref in ('r="A1" ', 'r="B1" ', 'r="A2"', ' r="B2" ', ' r="1"', ' r="2"'):
                    text = text.replace(ref, " ")
            z.writestr(n, text)
    assert [(r, c) for _, _, r, c in X.sheet_rows(out.getvalue())] == [(0, ["id", "name"]), (1, ["1", "a"]), (2, ["2", "b"])]


def test_date_codes():
    assert [X._is_date_code(c) for c in ("yyyy\\-mm\\-dd", "0.00", '#,##0 "days"', "[Red]0", "h:mm", "General", "[$-409]d/m")] == [True, False, False, False, True, False, True]


def _resheet(data, change):
    source, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in source.namelist():
            z.writestr(n, change(source.read(n)) if "sheet1" in n else source.read(n))
    return out.getvalue()


def test_sheets_in_pieces_and_unusual_ones(monkeypatch):
    rows = [["id", "name"], *[[i, f"a & <{i}>"] for i in range(300)]]
    data = _xlsx_bytes({"A": rows})
    want = [[str(c) for c in r] for r in rows]
    changes = [
        lambda b: b,
        lambda b: b.replace(b"<row", b"<!-- </row> --><row", 250),
        lambda b: b.replace(b"<row r=\"200\"", b"<!-- </sheetData> --><row r=\"200\""),
        lambda b: b.replace(b"UTF-8", b"UTF-16").decode().encode("utf-16"),
        lambda b: b.replace(b"xmlns=", b"xmlns:x=").replace(b"<", b"<x:").replace(b"<x:/", b"</x:").replace(b"<x:?", b"<?"),
        lambda b: b"\xef\xbb\xbf" + b.replace(b"<sheetData>", b"<cols><col min=\"1\"/></cols><sheetData >"),
    ]
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(X, "PIECE", size)
        for change in changes:
            assert [c for _, _, _, c in X.sheet_rows(_resheet(data, change))] == want


def test_workbooks_grow_in_number(spark, monkeypatch):
    """Four workbooks of any size once made the memory of a task grow with the table."""
    from tabsynth.plans import catalog

    monkeypatch.setattr(catalog, "WORKBOOK_ROWS", 200)
    path = catalog.orders_workbooks(spark, "/root/testdata/sf0.001")
    assert spark.read.format("binaryFile").load(path).count() == 8
    df = load_dataset(spark, path, fmt="excel")[0]
    assert df.select("id").distinct().count() == df.count() == 1500
