"""Workbooks (S5, S5b), re-aimed as a many-workbook job.

``spark.read.format("binaryFile")`` lists the workbooks; ``mapInArrow`` reads each one (a zip
of XML parts -- standard library only) as a stream and gives its cells in slices of rows
(file, sheet index, sheet name, row number, cells).  Everything after that -- sheet choice,
header detection on the left-filled head of each workbook (S6), columns by name, typing and
post-processing -- is ordinary DataFrame work.  A workbook is one binary file, so one task
reads one workbook; many workbooks are read in parallel.  Legacy ``.xls`` is not read.

A number whose style is a date becomes a time: the reader marks it, and a column whose cells
are all marked is a timestamp column.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import sys
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.kernels import quoted
from ..session import ensure_checkpoint_dir, written
from .csv import HEADER_SCAN, IngestionDiagnostics, by_name, detect_headers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library installed

# Fixed values of the workbook format: name spaces, ids of the built-in date formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
CELLS = "file string, sheet int, sheet_name string, rec bigint, cells array<string>"
SLICE = 4096
MARK = "\x1e"  # before a cell that is a time


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _elements(book: zipfile.ZipFile, part: str, tag: str):
    """The elements ``tag`` of a part one by one; each is dropped before the next."""
    with book.open(part) as f:
        parents = []
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == MAIN + tag:
                yield e
                parents[-1].clear()


PIECE = 1 << 20  # bytes of a sheet that are parsed at once
PLAIN = re.compile(rb'\s*(?:<\?xml(?:(?!encoding)[^>])*(?:encoding=["\'](?i:utf-8)["\'][^>]*)?>\s*)?(<worksheet\s[^>]*>)')


def _plain_rows(book: zipfile.ZipFile, part: str):
    """The rows of a sheet as programs write it (UTF-8, no prefixes, no comments or CDATA), cut
    after ends of rows and parsed in pieces; None where the sheet turns out to be another."""
    with book.open(part) as f:
        rest = f.read(PIECE)
        root = PLAIN.match(rest.removeprefix(b"\xef\xbb\xbf"))
        start = re.search(rb"<sheetData\s*>", rest)
        if not root or not start or b' xmlns="' + MAIN[1:-1].encode() + b'"' not in root[1] or b"<!" in rest[:start.start()]:
            yield None
            return
        rest = rest[start.end():]
        while True:
            more, end = f.read(PIECE), rest.find(b"</sheetData")
            if b"<!" in (rest[:end] if end >= 0 else rest):
                yield None
                return
            cut = end if end >= 0 else rest.rfind(b"</row>") + 6
            if cut >= 6:
                yield from ET.fromstring(root[1] + rest[:cut] + b"</worksheet>").findall(MAIN + "row")
                rest = rest[cut:]
            if end >= 0:
                return
            if not more:
                yield None
                return
            rest += more


def _rows(book: zipfile.ZipFile, part: str):
    """The rows of a sheet one by one: in pieces where that is sure to be right, which is several
    times as fast, else from the first row that is not by an event for each element."""
    done = 0
    for row in _plain_rows(book, part):
        if row is None:
            yield from itertools.islice(_elements(book, part, "row"), done, None)
            return
        done += 1
        yield row


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(MAIN + "t"))


def _is_date_code(code: str) -> bool:
    """Whether a format code shows a date or time: a d, m, y, h or s outside quotes, brackets
    and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
    formats = [int(x.get("numFmtId", 0)) for group in root.findall(MAIN + "cellXfs") for x in group.findall(MAIN + "xf")]
    return {i for i, f in enumerate(formats) if (_is_date_code(custom[f]) if f in custom else f in DATE_FORMATS)}


def _moment(serial: str, base: datetime) -> str | None:
    """Days since ``base`` as a marked time; None if it is no number or out of range."""
    try:
        return MARK + (base + timedelta(seconds=round(float(serial) * 86_400, 6))).isoformat(" ", "microseconds")
    except (ValueError, OverflowError):
        return None


def sheet_rows(data: bytes):
    """(sheet index, sheet name, row number from 0, cells) of one workbook, row by row.  A row
    or cell without a reference stands after the one before it."""
    # cached here and not by decorators, since those would be looked up in the library on executors
    column, moment = functools.cache(_column), functools.lru_cache(1 << 16)(_moment)  # days repeat
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
    dates = _date_styles(book)
    workbook = ET.fromstring(book.read("xl/workbook.xml"))
    properties = workbook.find(MAIN + "workbookPr")
    base = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(PACKAGE + "Relationship")}
    for index, sheet in enumerate(workbook.iter(MAIN + "sheet")):
        part = target[sheet.get(RELATION)].lstrip("/")
        at = -1
        for row in _rows(book, part if part.startswith("xl/") else f"xl/{part}"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            cells: dict[int, str | None] = {}
            place = -1
            for c in row.findall(MAIN + "c"):
                ref = c.get("r")
                place = column(ref.rstrip("0123456789")) if ref else place + 1
                kind = c.get("t")
                v = None if kind == "inlineStr" else c.find(MAIN + "v")
                if kind == "inlineStr":
                    value = _text(c)
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "b":
                    value = "true" if v.text == "1" else "false"
                elif kind in (None, "n") and int(c.get("s", 0)) in dates:
                    value = moment(v.text, base) or v.text
                else:
                    value = v.text
                cells[place] = value
            yield index, sheet.get("name"), at, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _read(batches):
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string())]

    def out(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "sheet", "sheet_name", "rec", "cells"])
        rows.clear()
        return batch
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for row in sheet_rows(content.as_py()):
                rows.append((path.as_py(), *row))
                if len(rows) == SLICE:
                    yield out(rows)
            if rows:
                yield out(rows)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_name, rec, cells) for every row of every sheet of every workbook
    under ``path`` (file, glob or folder)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, CELLS)


def _typed_times(df: DataFrame) -> DataFrame:
    """Columns whose cells are all marked become times; in other columns the mark goes."""
    row = df.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (
        ("n", F.count(quoted(c))), ("t", F.count(F.when(quoted(c).startswith(MARK), 1))))]).first()
    out = []
    for i, c in enumerate(df.columns):
        bare = F.regexp_replace(quoted(c), MARK, "")
        if row[f"t{i}"] and row[f"t{i}"] == row[f"n{i}"]:
            out.append(bare.try_cast("timestamp_ntz").alias(c))
        else:
            # a time among other values: without the zeros that say nothing
            out.append((F.when(quoted(c).startswith(MARK), F.regexp_replace(F.regexp_replace(bare, r"\.0+$", ""), " 00:00:00$", "")).otherwise(quoted(c)) if row[f"t{i}"] else quoted(c)).alias(c))
    return df.select(*out)


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0, header_row: int | None = None,
               variant: bool = False) -> tuple[DataFrame, IngestionDiagnostics]:
    """The chosen sheet (by place or name) of every workbook, columns by name; each
    workbook's header is found on its left-filled first 15 rows (S6), blank header cells become
    ``Unnamed: i``.  Columns are text, or times where every cell is a date."""
    ensure_checkpoint_dir(spark)
    cells = workbook_cells(spark, path)
    cells = written(cells.where(F.col("sheet") == sheet if isinstance(sheet, int) else F.col("sheet_name") == sheet), "workbook-cells")  # read once
    bare = cells.withColumn("cells", F.transform("cells", lambda c: F.nullif(c, F.lit(""))))
    last = HEADER_SCAN if header_row is None else header_row + 1
    # S6, for the search only: a missing cell takes the last one to its left
    filled = F.transform("cells", lambda c, i: F.coalesce(c, F.try_element_at(F.array_compact(F.slice("cells", F.lit(1), i + 1)), F.lit(-1))))
    head = bare.where(F.col("rec") < last)
    if header_row is None:
        found = detect_headers(head.where(F.size(F.array_compact("cells")) > 0).select("file", "rec", filled.alias("cells")), variant)
    else:
        found = head.select("file").distinct().withColumn("header", F.lit(header_row))
    header = head.select("file", F.col("rec").cast("int").alias("header"), "cells")
    sizes = bare.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
    files = sizes.join(found.join(header, ["file", "header"]), "file").select("file", "header", "cells", "width").checkpoint()
    first = files.orderBy("file").first()
    if first is None:
        raise ValueError(f"{path} has no header row")
    data = bare.join(files.select("file", "header"), "file").where(F.col("rec") > F.col("header")).select("file", "cells")
    df, layouts = by_name(data, files)
    diag = IngestionDiagnostics(path.rstrip("/").split("/")[-1], "excel", first["header"], files=files)
    diag.notes.append(f"Sheet {sheet!r}, header at row {first['header']}" + (f", {layouts} different headers joined by name." if layouts > 1 else "."))
    diag.raw_preview = cells.select("file", "rec", "cells").orderBy("file", "rec").limit(10)
    return _typed_times(df), diag
