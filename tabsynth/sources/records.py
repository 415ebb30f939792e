"""Physical lines of delimited files, and the records that they make up.

A quoted cell may hold line breaks, so a record can span lines, and lines of one record can be
in several splits of a file.  A line is a function of the quote state before it (outside or
inside a quoted cell) to the state after it; two regular expressions give it in the scan.
Files without a line that leaves a quote open have one record a line and need nothing more.
For the others each split reduces its lines to one function, the functions are chained over
the splits of a file (one row a split), and every split then assembles its own records, which
are written once; only the pieces of records that cross a split are shuffled, and joined again
in split order.  No file is read by one task alone, and what is known of each file is joined to
its lines without dealing them by file."""

from __future__ import annotations

import re
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library installed

FEW_FILES = 10_000
SAME = 2  # code of a line that keeps the state: outside -> outside, inside -> inside (bit 1)


def one_a_file(files: DataFrame) -> DataFrame:
    """A checkpoint of one row a file, to be joined to lines or records.  Spark does not see how
    small a checkpoint is and would deal all lines by file, a task for each; so up to
    ``FEW_FILES`` rows are broadcast (the driver holds the name of each file anyway)."""
    return F.broadcast(files) if files.count() <= FEW_FILES else files


def by_delimiter(delimiter: Column, seps: list[str], of) -> Column:
    """``of(separator)`` for the separator of the line's file, one of ``seps``."""
    if len(seps) == 1:
        return of(seps[0])
    return reduce(lambda c, s: c.when(delimiter == s, of(s)), seps[1:], F.when(delimiter == seps[0], of(seps[0])))


def _cell(sep: str) -> str:
    """One cell: quoted (a doubled quote stands for one; what follows the end up to the
    separator belongs to it), or plain, or empty.  Possessive, so matching is linear."""
    d = re.escape(sep)
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^"{d}][^{d}]*+|)'


def line_code(value: Column, sep: str) -> Column:
    """State after the line, as bits: bit 0 if it starts outside a quoted cell, bit 1 if it
    starts inside one."""
    d, cell = re.escape(sep), _cell(sep)
    closed = value.rlike(rf"\A{cell}(?:{d}{cell})*+\z")
    closes = value.rlike(rf'\A[^"]*+(?:""[^"]*+)*+"[^{d}]*+(?:{d}{cell})*+\z')
    code = F.when(closed, 0).otherwise(1) + F.when(closes, 0).otherwise(2)
    return F.when(F.contains(value, F.lit('"')), code).otherwise(SAME)


def split_cells(value: Column, sep: str) -> Column:
    """Cells of a record, quotes taken off; an empty cell is NULL."""
    d = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), value), F.lit(f"{d}({_cell(sep)})"), F.lit(1))

    def bare(cell: Column) -> Column:
        inner = F.regexp_extract(cell, r'\A"([^"]*+(?:""[^"]*+)*+)"', 1)
        quoted = F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.substring(cell, F.length(inner) + 3, F.length(cell)))
        return F.when(cell.isin("", '""'), F.lit(None)).when(cell.startswith('"'), quoted).otherwise(cell)  # each cell unquoted once
    return F.transform(raw, bare)


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, value) of every line, in file order within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def numbered(lines: DataFrame) -> DataFrame:
    """(file, rec, value) of the lines that are not blank; ``rec`` counts those of a file's
    first split from 0 and is NULL in later splits, which hold neither junk nor header."""
    rows = lines.where(F.trim(F.col("value")) != "").withColumn("_at", F.monotonically_increasing_id())
    first = one_a_file(rows.where(F.col("split") == 0).groupBy("file").agg(F.min("_at").alias("_base")).checkpoint())
    return rows.join(first, "file", "left").select(
        "file", F.when(F.col("split") == 0, F.col("_at") - F.col("_base")).alias("rec"), "value")


def files_with_open_lines(lines: DataFrame, sep_of: DataFrame, seps: list[str]) -> dict[str, list[str]]:
    """Files in which a line leaves a quoted cell open, by separator.  ``sep_of`` is (file,
    delimiter).  Within a file all lines before the first such line are whole records."""
    own = by_delimiter(F.col("delimiter"), seps, lambda s: line_code(F.col("value"), s))
    opened = lines.where(F.contains("value", F.lit('"'))).join(sep_of, "file")
    opened = opened.groupBy("file", "delimiter").agg(F.max(own.bitwiseAND(1)).alias("open"))
    out: dict[str, list[str]] = {s: [] for s in seps}
    for r in opened.where("open = 1").select("file", "delimiter").orderBy("file").collect():
        out[r["delimiter"]].append(r["file"])
    return out


def _runs(batches):
    """(file, split), columns of the run, whether a new split starts, in order."""
    before = None
    for batch in batches:
        ends = [pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in (0, 1)] if batch.num_rows else [[], []]
        at = 0
        for stop in np.union1d(*ends).astype(int).tolist():
            key = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            yield key, batch.slice(at, stop - at), key != before
            before, at = key, stop


def _states(codes: np.ndarray, state: int) -> np.ndarray:
    """Quote state after each line: that of the last line which sets it (codes 0 and 3), or the
    one before them all, turned by every line since that swaps the two states (code 1)."""
    swaps = np.cumsum(codes == 1)
    sets = np.maximum.accumulate(np.where((codes == 0) | (codes == 3), np.arange(len(codes)), -1))
    return np.where(sets >= 0, codes[sets] & 1, state) ^ ((swaps - np.where(sets >= 0, swaps[sets], 0)) & 1)


def _split_functions(batches):
    rows = []
    for key, run, new in _runs(batches):
        if new:
            rows.append([*key, 0, 1, False])  # state after the split from outside, from inside; whether the latter ever closes
        row = rows[-1]
        codes = run.column(2).to_numpy(zero_copy_only=False)
        inside = _states(codes, row[3])
        row[4] |= not inside.all()
        row[2], row[3] = int(_states(codes, row[2])[-1]), int(inside[-1])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()])],
                                     names=["file", "split", "outside", "inside", "closes"])


def split_states(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """For each split of (file, split, code): the quote state it starts in, and the split in
    which the record that is open at its start began.  One entry a split, as many as the
    scheduler has tasks.  A file that ends inside a quoted cell raises."""
    functions = lines.mapInArrow(_split_functions, "file string, split bigint, outside int, inside int, closes boolean")
    states, file, state, began = {}, None, 0, -1
    for r in sorted(functions.collect(), key=lambda r: (r["file"], r["split"])):  # sorted by Spark, the lines would be read twice
        if r["file"] != file:
            if state:
                raise ValueError(f"{file} ends inside a quoted cell")
            file, state, began = r["file"], 0, -1
        states[file, r["split"]] = (state, began)
        if state == 0 or r["closes"]:  # a record that is open at the end then began in this split
            began = r["split"]
        state = r["inside"] if state else r["outside"]
    if state:
        raise ValueError(f"{file} ends inside a quoted cell")
    return states


PIECE = "file string, rec bigint, began bigint, split bigint, value string"
_PIECE = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _assembler(shared):
    def run(batches):
        held, state, began, rec, last = [], 0, -1, 0, None
        own = True  # whether the open record began in this split

        def out(key, first, values):
            """Records that end in the split; ``first``, if any, is the one that was open."""
            nonlocal rec
            whole = [] if first is None else [first]
            n = len(whole) + len(values)
            recs = pa.array(np.arange(rec, rec + n)) if key[1] == 0 else pa.nulls(n, pa.int64())
            rec += n
            crossed = pa.array([None if own else began] * len(whole) + [None] * len(values), pa.int64())
            values = pa.concat_arrays([pa.array(whole, pa.string()), values])
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0], pa.string()), n), recs, crossed, pa.repeat(pa.scalar(key[1], pa.int64()), n), values], names=names)

        def rest():
            """The record that is open at the end of a split."""
            row = (last[0], rec if own and last[1] == 0 else None, last[1] if own else began, last[1], "\n".join(held))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _PIECE)], names=names)

        for key, part, new in _runs(batches):
            if new:
                if held:
                    yield rest()
                if key not in shared.value:
                    raise RuntimeError(f"the splits of {key[0]} changed between two reads")
                held, (state, began), rec, last, own = [], shared.value[key], 0, key, False
            values = part.column(3).cast(pa.string())
            after = _states(part.column(2).to_numpy(zero_copy_only=False), state)
            ends = np.flatnonzero(after == 0) + 1  # behind the last line of each record
            first, at = None, 0
            if state and len(ends):  # the open record ends here
                at = int(ends[0])
                first, held, ends = "\n".join([*held, *values[:at].to_pylist()]), [], ends[1:]
            if len(ends) or first is not None:
                starts = np.concatenate([[at], ends]).astype(np.int32)
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), values), "\n")
                single = np.diff(starts) == 1
                blank = pc.equal(pc.utf8_trim(whole, " "), "").to_numpy(zero_copy_only=False)
                yield out(key, first, whole.filter(pa.array(~(single & blank))))
                at = int(starts[-1])
                own = True  # what is open from here on began here
            elif not state:
                own = True
            held.extend(values[at:].to_pylist())
            state = int(after[-1])
        if held:
            yield rest()
    names = ["file", "rec", "began", "split", "value"]
    return run


def assembled(lines: DataFrame, files_of: dict[str, list[str]]) -> DataFrame:
    """(file, rec, value): the records of (file, split, value) in the files with quoted line
    breaks, by separator.  Blank lines outside a quoted cell are dropped, inside they stay; line
    ends become ``\\n``.  No join gives a line its separator, as lines must stay in order."""
    whens = [(F.col("file").isin(files), line_code(F.col("value"), sep)) for sep, files in files_of.items() if files]
    lines = lines.where(F.col("file").isin([f for files in files_of.values() for f in files]))
    code = whens[0][1] if len(whens) == 1 else reduce(lambda c, w: c.when(*w), whens[1:], F.when(*whens[0]))
    coded = lines.select("file", "split", code.alias("code"), "value")
    shared = lines.sparkSession.sparkContext.broadcast(split_states(coded.select("file", "split", "code")))
    pieces = written(coded.mapInArrow(_assembler(shared), PIECE), "csv-records")  # assembled once
    parts = F.array_sort(F.collect_list(F.struct("split", "value")))  # of one record
    crossing = pieces.where("began is not null").groupBy("file", "began").agg(
        F.min("rec").alias("rec"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    crossing = written(crossing.select("file", "rec", "value"), "csv-crossing")
    return pieces.where("began is null").select("file", "rec", "value").unionByName(crossing)


def records(spark: SparkSession, path: str | list[str], sep_of: DataFrame, seps: list[str]) -> DataFrame:
    """(file, rec, value) of every record of every file."""
    lines = physical_lines(spark, path)
    opened = files_with_open_lines(lines, sep_of, seps)
    several = [f for files in opened.values() for f in files]
    if not several:
        return numbered(lines)
    plain = numbered(lines.where(~F.col("file").isin(several)))
    return written(plain, "csv-lines").unionByName(assembled(lines, opened))
