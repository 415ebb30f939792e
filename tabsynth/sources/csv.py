"""Messy delimited files.

Every file is judged on its own: its separator from its first lines, its header row from its
first records, its column names from that header.  The findings are a small table (one row a
file) that is joined back to the records, and the cells of each file are put under the columns
of all files by name.  So files with other junk lines, another separator or another column
order load into one table.

* ``records`` gives the records of all files, with quoted line breaks kept.
* Cells are split by one regular expression a separator (quotes honoured, a doubled quote is
  one), all as text; strict type inference follows (P9).
* The driver sees one entry for each distinct header, never a record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import HEADER_HINTS, HEADER_HINTS_VARIANT, normalize_token
from ..functions.names import make_unique
from ..session import ensure_checkpoint_dir, written
from .records import by_delimiter, numbered, one_a_file, physical_lines, records, split_cells

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 10
HEADER_SCAN = 15
PREVIEW = 10


@dataclass
class IngestionDiagnostics:
    """What was found out about a load; separator and header row are those of the first file,
    ``files`` has them for every file, the previews are the first records raw and cleaned."""

    file_name: str
    file_type: str
    detected_header_row: int | None = None
    detected_delimiter: str = ","
    notes: list[str] = field(default_factory=list)
    files: DataFrame | None = None
    raw_preview: DataFrame | None = None
    cleaned_preview: DataFrame | None = None

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.file_name, self.file_type, self.detected_delimiter, self.detected_header_row, " | ".join(self.notes))],
            "file_name string, file_type string, delimiter string, header_row int, notes string",
        )


def _regex_quote(d: str) -> str:
    return {"|": r"\|", "\t": "\t"}.get(d, d)


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """(file, delimiter) from (file, rec, value) of the first lines: among , ; tab |, the one
    whose count a line is non-zero and most consistent (lowest deviation, then highest mean,
    then list order); ``,`` where none occurs.  Quoted cells, over several lines or cut off at
    the end, are taken out first."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec", "value"))), lambda x: x["value"]), "\n")  # a few lines
    bare = F.regexp_replace(whole, r'(?m)(^|[,;\t|])"[^"]*+(?:""[^"]*+)*+(?:"|\z)', "$1")
    lines = lines.groupBy("file").agg(bare.alias("bare")).select("file", F.explode(F.split("bare", "\n")).alias("value"))
    aggs, found = [], []
    for i, d in enumerate(DELIMITERS):
        n = F.size(F.split("value", _regex_quote(d))) - 1
        aggs += [F.avg(n).alias(f"m{i}"), F.stddev_pop(n).alias(f"s{i}")]
        found.append(F.when(F.col(f"m{i}") > 0, F.struct(F.col(f"s{i}").alias("s"), (-F.col(f"m{i}")).alias("m"), F.lit(i).alias("i"), F.lit(d).alias("d"))))
    return lines.groupBy("file").agg(*aggs).select("file", F.coalesce(F.least(*found)["d"], F.lit(",")).alias("delimiter"))


def cells_of(value: Column, delimiter: Column, seps: list[str]) -> Column:
    """Cells by the separator of the record's file, one of ``seps``."""
    return by_delimiter(delimiter, seps, lambda s: split_cells(value, s))


def detect_headers(head: DataFrame, variant: bool = False) -> DataFrame:
    """(file, header) from (file, rec, cells) of the first records: the record with the
    most hint words (first on ties); without any, the one with the most cells that are not
    blank if there are two or more; else 0."""
    hints = HEADER_HINTS_VARIANT if variant else HEADER_HINTS
    full = F.filter("cells", lambda c: F.trim(c) != "")
    hits = F.size(F.filter(full, lambda c: normalize_token(c, variant=variant).isin(*hints)))
    rows = head.select("file", "rec", F.size(full).alias("full"), hits.alias("hits"))
    best = rows.groupBy("file").agg(F.max(F.struct("hits", (-F.col("rec")).alias("r"))).alias("by_hint"), F.max(F.struct("full", (-F.col("rec")).alias("r"))).alias("by_size"))
    return best.select("file", F.when(F.col("by_hint.hits") > 0, -F.col("by_hint.r")).when(F.col("by_size.full") >= 2, -F.col("by_size.r")).otherwise(0).cast("int").alias("header"))


def _as_file(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([("", i, x) for i, x in enumerate(lines)], "file string, rec bigint, value string")


def detect_delimiter_from_lines(spark: SparkSession, lines: list[str]) -> str:
    """S2 for the lines of one file; ``,`` without any."""
    return detect_delimiters(_as_file(spark, lines)).select("delimiter").first()[0] if lines else ","


def detect_header_row_from_lines(spark: SparkSession, lines: list[str], sep: str, variant: bool = False,
                                 scan: int = HEAD_LINES) -> int | None:
    """S3/S3b for the lines of one file; no lines -> None (variant: 0)."""
    if not lines:
        return 0 if variant else None
    head = _as_file(spark, lines[:scan]).select("file", "rec", split_cells(F.col("value"), sep).alias("cells"))
    return detect_headers(head, variant).select("header").first()[0]


def header_names(cells: list[str | None], width: int) -> list[str]:
    """Names from header cells; blank cells become ``Unnamed: i`` (dropped later as unnamed),
    cells beyond the header ``extra_i``."""
    names = [(c or "").strip() or f"Unnamed: {i}" for i, c in enumerate(cells)]
    return make_unique(names + [f"extra_{i}" for i in range(len(names), width)])


@dataclass
class Scan:
    """Records of all files with what is known of each file: (file, rec, value) and (file,
    delimiter, header, cells)."""

    records: DataFrame
    heads: DataFrame
    seps: list[str]

    def with_cells(self) -> DataFrame:
        """(file, rec, cells ...) of the records below the headers."""
        rows = self.records.join(self.heads.drop("cells"), "file")
        rows = rows.where(F.col("rec").isNull() | (F.col("rec") > F.col("header")))
        return rows.withColumn("cells", cells_of(F.col("value"), F.col("delimiter"), self.seps))


def scan_files(spark: SparkSession, path: str | list[str], sep: str | None = None, header_row: int | None = None, variant: bool = False) -> Scan:
    """Find separator and header of every file that has a line that is not blank."""
    ensure_checkpoint_dir(spark)
    lines = physical_lines(spark, path)
    if sep:
        sep_of = lines.where(F.trim("value") != "").select("file").distinct().withColumn("delimiter", F.lit(sep))
    else:
        sep_of = detect_delimiters(numbered(lines).where(F.col("rec") < HEADER_SCAN))
    sep_of = one_a_file(sep_of.checkpoint())
    seps = sorted(r[0] for r in sep_of.select("delimiter").distinct().collect())
    if not seps:
        raise ValueError(f"{path} has no header line")
    recs = records(spark, path, sep_of, seps)
    last = HEAD_LINES if header_row is None else header_row + 1
    head = recs.where(F.col("rec") < last).join(sep_of, "file")
    head = head.select("file", "rec", "delimiter", cells_of(F.col("value"), F.col("delimiter"), seps).alias("cells")).checkpoint()
    found = head.select("file").distinct().withColumn("header", F.lit(header_row)) if header_row is not None else detect_headers(head, variant)
    heads = sep_of.join(found, "file").join(head.select("file", F.col("rec").cast("int").alias("header"), "cells"), ["file", "header"], "left")
    heads = one_a_file(heads.select("file", "delimiter", "header", "cells").checkpoint())
    short = heads.where("cells is null").select(F.min("file")).first()[0]
    if short is not None:
        raise ValueError(f"{short} has no header line")
    return Scan(recs, heads, seps)


def by_name(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, int]:
    """The cells of (file, cells) under the columns of all files, from (file, cells: the
    header's, width), and the number of distinct headers."""
    spark = parsed.sparkSession
    # one entry for each distinct header, in the order of the files
    layouts = files.groupBy("cells", "width").agg(F.min("file").alias("first")).orderBy("first").collect()
    columns: dict[str, str] = {}
    named = [header_names(r["cells"], r["width"]) for r in layouts]
    for names in named:
        for n in names:
            columns.setdefault(n.lower(), n)
    at = [{n.lower(): i for i, n in enumerate(names)} for names in named]
    places = [(r["cells"], r["width"], [place.get(c, -1) for c in columns]) for r, place in zip(layouts, at)]
    places = spark.createDataFrame(places, "cells array<string>, width int, places array<int>")
    if len(layouts) == 1:  # all files alike: nothing to join
        rows, cells = parsed, [F.get("cells", F.lit(i)) for i in range(len(columns))]
    else:
        # a header without cells is an empty array, never null, so the join by value is safe
        place_of = files.join(places, ["cells", "width"]).select("file", "places").checkpoint()
        place_of = one_a_file(place_of)
        rows = parsed.join(place_of, "file")
        cells = [F.when(F.col("places")[i] >= 0, F.get("cells", F.col("places")[i])) for i in range(len(columns))]
    return rows.select(*[c.alias(n) for c, n in zip(cells, columns.values())]), len(layouts)


def read_csv(spark: SparkSession, path: str | list[str], sep: str | None = None, header_row: int | None = None,
             variant: bool = False) -> tuple[DataFrame, IngestionDiagnostics]:
    """S1 + S2 + S3 + S4: every file by its own (or the given) separator and header row, the
    columns of all files by name without regard to case: those of the first file by name, then
    further ones of the next.  Cells a file does not have are NULL; columns are text here --
    type inference and post-processing follow in ``load``."""
    scan = scan_files(spark, path, sep, header_row, variant)
    parsed = written(scan.with_cells().select("file", "cells"), "csv-cells")  # split once, read by every later pass
    sizes = parsed.select("file", F.size("cells").alias("n")).join(scan.heads.select("file", F.size("cells").alias("own")), "file")
    sizes = sizes.groupBy("file").agg(F.max("n").alias("most"), F.count(F.when(F.col("n") > F.col("own"), 1)).alias("over"))
    width = F.greatest(F.size("cells"), F.coalesce("most", F.lit(0)))
    files = scan.heads.join(sizes, "file", "left").select(
        "file", "delimiter", "header", "cells", width.alias("width"), F.coalesce("over", F.lit(0)).alias("over")).checkpoint()
    df, layouts = by_name(parsed, files)
    first = files.orderBy("file").first()
    name = path if isinstance(path, str) else path[0]
    diag = IngestionDiagnostics(name.rstrip("/").split("/")[-1], "csv", first["header"], first["delimiter"], files=files)
    over = files.agg(F.sum("over")).first()[0]
    if over:
        diag.notes.append(f"{over} lines have more cells than the header; they are in extra_* columns.")
    diag.notes.append(f"Read with separator {first['delimiter']!r}, header at row {first['header']}.")
    if layouts > 1:
        diag.notes.append(f"{files.count()} files with {layouts} headers were joined by column name.")
    diag.raw_preview = scan.records.where(F.col("rec") < PREVIEW).select("file", "rec", "value").orderBy("file", "rec").limit(PREVIEW)
    return df, diag


def row_ffill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill missing cells left to right within each row (used for header scans of
    sheets with merged cells)."""
    out = []
    for i, c in enumerate(cols):
        out.append(F.coalesce(*[F.col(f"`{cols[j]}`") for j in range(i, -1, -1)]).alias(c))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*keep, *out)
