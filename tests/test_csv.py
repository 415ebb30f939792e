"""Delimited files: each file by its own shape, quoted line breaks over lines and splits."""

import csv
import io
import random

import pytest

from tabsynth.sources import csv as C
from tabsynth.sources import records as R
from tabsynth.sources.load import load_dataset


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_files_of_different_shape_load_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("report,,\nid,name,value\n1,a,10\n2,b,20\n")
    (tmp_path / "b.csv").write_text("report;;\nof;the;day\n\nVALUE;id;note\n30;3;c\n40;4;\n")
    (tmp_path / "c.csv").write_text("id|name|value\n5|x|50|more\n")
    df, diag = load_dataset(spark, f"file:{tmp_path}", fmt="csv")
    assert df.columns == ["id", "name", "value", "note", "extra_3"]
    assert rows_of(df) == rows_of(spark.createDataFrame(
        [(1, "a", 10, None, None), (2, "b", 20, None, None), (3, None, 30, "c", None), (4, None, 40, None, None), (5, "x", 50, None, "more")],
        "id bigint, name string, value bigint, note string, extra_3 string"))
    found = [(r["delimiter"], r["header"], r["over"]) for r in diag.files.orderBy("file").collect()]
    assert found == [(",", 1, 0), (";", 2, 0), ("|", 0, 1)]
    assert [r["value"] for r in diag.raw_preview.collect()][:2] == ["report,,", "id,name,value"] and diag.cleaned_preview.count() == 5


def test_one_file_without_a_header_line_is_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a\n")
    (tmp_path / "b.csv").write_text("id,name\n")
    with pytest.raises(ValueError, match="b.csv"):
        C.read_csv(spark, f"file:{tmp_path}", header_row=1)
    (tmp_path / "empty.csv").write_text("\n \n")
    assert C.read_csv(spark, f"file:{tmp_path}")[0].count() == 1  # a file of blank lines is no file


CELLS = ["", "a", "b c", 'say "hi"', "x,y", "line\nbreak", "\n", "two\n\nbreaks, \"and\"\nmore", '"', "''", "é\nü", " pad ", "1.5", ";", '",\n"']


def written_csv(rows, sep=",", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n", quoting=quoting).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("split_bytes", [60, 1000, 1 << 26])
def test_quoted_breaks_across_splits(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    want = []
    for f, sep in enumerate([",", ";", "|", "\t", ","]):
        rows = [[f"{f}-plain{i}", "n", "v"] for i in range(8)] + [[f"{f}-{i}", *(rng.choice(CELLS if f < 4 else CELLS[:5]) for _ in range(2))] for i in range(25)]
        rows.append([f"{f}-long", "word\n" * 60, "end"])
        (tmp_path / f"{f}.csv").write_text(written_csv([["id", "name", "value"], *rows], sep, rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])))
        want += [tuple(c or None for c in r) for r in rows]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df, diag = C.read_csv(spark, f"file:{tmp_path}")
        assert df.columns == ["id", "name", "value"]
        assert rows_of(df) == sorted(want, key=repr)
        if split_bytes == 60:
            assert R.physical_lines(spark, f"file:{tmp_path}").select("file", "split").distinct().count() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,size,name\n1,5" pipe,a\n2,6",b\n3,"quoted" tail,c\n4,"""x""",d\n')
    assert rows_of(C.read_csv(spark, f"file:{tmp_path}")[0]) == [("1", '5" pipe', "a"), ("2", '6"', "b"), ("3", "quoted tail", "c"), ("4", '"x"', "d")]


def test_a_quote_that_never_closes_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"open\n2,b\n')
    with pytest.raises(ValueError, match="inside a quoted cell"):
        C.read_csv(spark, f"file:{tmp_path}")


def test_line_codes_follow_the_csv_module(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    lines = sorted({"".join(rng.choice(['"', ",", "a", '""', ' ']) for _ in range(rng.randint(0, 9))) for _ in range(400)})
    df = spark.createDataFrame([(x,) for x in lines], "value string")

    def state(text):
        inside, i, start = False, 0, True
        while i < len(text):
            c = text[i]
            if inside:
                if c == '"':
                    if text[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif c == '"' and start:
                inside = True
            start = c == "," and not inside
            i += 1
        return int(inside)
    for r in df.select("value", R.line_code(F.col("value"), ",").alias("code")).collect():
        assert r["code"] == state(r["value"]) + 2 * state('"' + r["value"]) or not r["value"]
    closed = [x for x in lines if state(x) == 0 and x]
    got = {r["value"]: r["cells"] for r in spark.createDataFrame([(x,) for x in closed], "value string").select("value", R.split_cells(F.col("value"), ",").alias("cells")).collect()}
    for x in closed:
        assert got[x] == [c or None for c in next(csv.reader([x]))], x


def test_states_of_lines_follow_their_codes_one_by_one():
    import numpy as np

    rng = random.Random(5)
    for n in (1, 2, 7, 60):
        codes = [rng.choice([0, 1, 2, 2, 3]) for _ in range(n)]
        for state in (0, 1):
            got, want = R._states(np.array(codes, np.int32), state).tolist(), []
            for code in codes:
                state = code >> state & 1
                want.append(state)
            assert got == want


def test_records_are_not_dealt_by_file(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.csv").write_text(f"id,{'nmo'[f]},value\n" + "".join(f'{f}{i},"a\nb",1\n' for i in range(50)))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "-1")
        df, _ = C.read_csv(spark, f"file:{tmp_path}")
        assert df.count() == 150
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(file" not in plan
    finally:
        spark.conf.set(conf, before)
