"""Profiles and aggregates.

Per-column statistics are computed on the long (column, value) form: one grouped job
whose partial aggregation runs map-side, instead of one job per column.  Results are
small DataFrames (one row per column / class / pair); dataclass views collect them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import typeclass as tc
from ..functions.columns import DATETIME_FORMATS, epoch_micros, parse_datetime, r6
from ..plans import kernels as K


@dataclass
class DataProfile:
    rows: int
    columns: int
    numerical_columns: list[str]
    categorical_columns: list[str]
    datetime_columns: list[str]
    missing_cells: int
    missing_percent: float


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN folded to NULL for float types (pandas counts NaN as missing)."""
    c = F.col(_q(name))
    if tc.is_float(tc.field_type(df, name)):
        return F.nanvl(c, F.lit(None).cast("double")).alias(name)
    return c


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing_count, rows): NULL (and NaN) cells per column, one pass."""
    cols = df.columns
    agg = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(present(df, c)).alias(f"__n{i}") for i, c in enumerate(cols)],
    )
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', __rows - __n{i}" for i, c in enumerate(cols))
    return agg.selectExpr("__rows AS rows", f"stack({len(cols)}, {stack}) AS (column, missing_count)")


def profile_frame(df: DataFrame) -> DataFrame:
    """A1: one row (rows, columns, numeric/datetime/categorical column lists and counts,
    missing_cells, missing_percent)."""
    num = tc.numeric_columns(df)
    dts = tc.datetime_columns(df)
    cat = tc.categorical_columns(df)
    ncols = len(df.columns)
    counts = [F.count(present(df, c)) for c in df.columns]
    filled = sum(counts[1:], counts[0]) if counts else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("rows"), filled.alias("_filled"))
    cells = F.col("rows") * F.lit(ncols)
    return row.select(
        F.col("rows"),
        F.lit(ncols).alias("columns"),
        F.lit(",".join(num)).alias("numerical_columns"),
        F.lit(",".join(cat)).alias("categorical_columns"),
        F.lit(",".join(dts)).alias("datetime_columns"),
        F.lit(len(num)).alias("n_numerical"),
        F.lit(len(cat)).alias("n_categorical"),
        F.lit(len(dts)).alias("n_datetime"),
        (cells - F.col("_filled")).alias("missing_cells"),
        F.when(cells > 0, (cells - F.col("_filled")) / cells * 100.0).otherwise(0.0).alias("missing_percent"),
    )


def build_profile(df: DataFrame) -> DataProfile:
    r = profile_frame(df).first()
    if r is None or r["rows"] == 0:
        raise ValueError("there are no rows to profile")
    return DataProfile(
        rows=r["rows"], columns=r["columns"],
        numerical_columns=tc.numeric_columns(df),
        categorical_columns=tc.categorical_columns(df),
        datetime_columns=tc.datetime_columns(df),
        missing_cells=r["missing_cells"], missing_percent=r["missing_percent"],
    )


def dt_seconds(df: DataFrame, name: str) -> Column:
    """Date/time as epoch seconds (double, microsecond fraction) so it shares the numeric
    statistics path; whole seconds keep sums exact in double arithmetic."""
    tz = df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
    return epoch_micros(F.col(f"`{name}`"), tc.field_type(df, name), tz).cast("double") / 1000000.0


def summary_statistics(df: DataFrame, include: str = "all") -> DataFrame:
    """A2 (``include='all'``) / A3 (``'number'``): one row per column with count, unique,
    top, freq, mean, std, min, p25, p50, p75, max.  Date/time statistics are epoch
    seconds; text/boolean columns get count/unique/top/freq only."""
    num = tc.numeric_columns(df)
    dts = tc.datetime_columns(df) if include == "all" else []
    cat = [c for c in tc.categorical_columns(df) if not tc.is_nested(tc.field_type(df, c))] if include == "all" else []
    if include != "all" and not num:
        return summary_statistics(df, "all")
    order = [c for c in df.columns if c in set(num) | set(dts) | set(cat)]
    spark = df.sparkSession
    schema = (
        "column string, count long, unique long, top string, freq long, mean double, std double, "
        "min double, p25 double, p50 double, p75 double, max double"
    )
    parts = []
    numlike = num + dts
    if numlike:
        wide = df.select(
            *[present(df, c).cast("double").alias(c) for c in num],
            *[dt_seconds(df, c).alias(c) for c in dts],
        )
        aggs = [f(K.quoted(c)).alias(f"{k}{i}") for i, c in enumerate(numlike) for k, f in (
            ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
        stats = wide.agg(*aggs).select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), *[F.col(f"{k}{i}").alias(k) for k in ("mean", "std", "min", "max")])
            for i, c in enumerate(numlike)])).alias("x")).select("x.*")
        q = K.exact_quantiles(wide, numlike, [0.25, 0.5, 0.75])
        qw = q.groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
        qw = qw.toDF("column", "p25", "p50", "p75")
        s = stats.join(qw, "column", "left").withColumn(
            "std", F.when(F.col("column").isin(*dts), F.lit(None).cast("double")).otherwise(F.col("std"))
        )
        parts.append(s.select(
            "column", "count", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), "mean", "std", "min", "p25", "p50", "p75", "max",
        ))
    if cat:
        vc = K.value_counts_long(df, cat, "string")
        per = vc.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), F.sum("cnt").alias("count"), F.max("cnt").alias("freq")
        )
        top = vc.join(per, "column").where(F.col("cnt") == F.col("freq")).groupBy("column").agg(
            F.min("value").alias("top")
        )
        c = per.join(top, "column")
        # columns with no value at all still get a row (count 0)
        allcat = spark.createDataFrame([(x,) for x in cat], "column string")
        c = allcat.join(c, "column", "left").fillna(0, subset=["count", "unique"])
        parts.append(c.select(
            "column", "count", "unique", "top", "freq",
            *[F.lit(None).cast("double").alias(x) for x in ("mean", "std", "min", "p25", "p50", "p75", "max")],
        ))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pos = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return out.withColumn("_o", pos[F.col("column")]).orderBy("_o").drop("_o")


def missing_values_table(df: DataFrame) -> DataFrame:
    """A4: (column, missing_count, missing_pct) for columns with missing cells, % desc."""
    mc = missing_counts(df)
    return (
        mc.where(F.col("missing_count") > 0)
        .select("column", "missing_count", (F.col("missing_count") / F.col("rows") * 100.0).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column")
    )


def class_distribution(df: DataFrame, target: str, dropna: bool = False) -> DataFrame:
    """A5 (missing is the class ``nan``, % of all rows) / A5b (``dropna``: missing
    excluded, % of non-missing rows).  Count descending, class as tie-break."""
    t = present(df, target)
    base = df.select(t.alias("_t"))
    if dropna:
        base = base.where(F.col("_t").isNotNull())
    counts = base.groupBy(F.coalesce(F.col("_t").cast("string"), F.lit("nan")).alias("class")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = base.select(F.count(F.lit(1))).scalar()  # scalar subquery, one number
    return counts.select("class", "count", (F.col("count") / total * 100.0).alias("pct")).orderBy(
        F.desc("count"), "class"
    )


def imbalance_ratio_frame(df: DataFrame, target: str, dropna: bool = False, binary_only: bool = False) -> DataFrame:
    """A6 (missing counts as a class) / A6b (``dropna`` and ``binary_only``): one row with
    n_classes, minority, majority, imbalance_ratio (NULL if fewer than 2 classes)."""
    t = present(df, target)
    base = df.select(t.alias("_t"))
    if dropna:
        base = base.where(F.col("_t").isNotNull())
    counts = base.groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
    agg = counts.agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("_c").alias("minority"), F.max("_c").alias("majority")
    )
    ok = (F.col("n_classes") == 2) if binary_only else (F.col("n_classes") >= 2)
    return agg.select(
        "n_classes", "minority", "majority",
        F.when(ok & (F.col("majority") > 0), F.col("minority") / F.col("majority")).alias("imbalance_ratio"),
    )


def imbalance_ratio(df: DataFrame, target: str | None, dropna: bool = False, binary_only: bool = False) -> float | None:
    if not target or target not in df.columns:
        return None
    r = imbalance_ratio_frame(df, target, dropna, binary_only).first()
    return None if r is None else r["imbalance_ratio"]


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, chunk: int = 400) -> DataFrame:
    """Long Pearson matrix (col_a, col_b, r) over numeric columns, pairwise-complete
    rows, diagonal included; NULL where undefined (constant column, fewer than 2 pairs).

    Plain SUM aggregates only (codegen-friendly, map-side partial sums): a first pass gets
    counts and means, the second sums mean-shifted cross products.  Pairs of columns
    without missing values share per-column sums; pairs touching a column with missing
    values use sums masked to the pair's complete rows.  Only the sums (O(d^2) numbers)
    reach the driver, where r = cov / sqrt(var var) is formed (NULL when a variance is 0)."""
    spark = df.sparkSession
    cols = cols if cols is not None else tc.numeric_columns(df)
    if len(cols) < 2:
        return spark.createDataFrame([], "col_a string, col_b string, r double")
    base = df.select(*[present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    first = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"v{i}").alias(f"c{i}") for i in range(len(cols))],
                     *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(cols))]).first()  # 2d+1 numbers
    n = first["n"]
    full = [first[f"c{i}"] == n for i in range(len(cols))]
    mean = [first[f"m{i}"] or 0.0 for i in range(len(cols))]
    d = [F.col(f"v{i}") - F.lit(mean[i]) for i in range(len(cols))]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    out_rows = []
    for part in K.chunked(pairs, chunk):
        aggs: dict[str, Column] = {}
        plan = []

        def add(name: str, e: Column) -> str:
            if name not in aggs:
                aggs[name] = F.sum(e).alias(name)
            return name

        for (i, j) in part:
            if full[i] and full[j]:
                keys = ("_n", add(f"s{i}", d[i]), add(f"s{j}", d[j]), add(f"q{i}", d[i] * d[i]),
                        add(f"q{j}", d[j] * d[j]))
            else:
                both = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
                keys = (add(f"n_{i}_{j}", F.when(both, F.lit(1)).otherwise(F.lit(0))),
                        add(f"s{i}_{j}", F.when(both, d[i])), add(f"s{j}_{i}", F.when(both, d[j])),
                        add(f"q{i}_{j}", F.when(both, d[i] * d[i])), add(f"q{j}_{i}", F.when(both, d[j] * d[j])))
            plan.append((i, j, keys, add(f"x{i}_{j}", d[i] * d[j])))
        row = base.agg(F.count(F.lit(1)).alias("_n"), *aggs.values()).first()  # one row of sums
        for (i, j, (kn, ksx, ksy, ksxx, ksyy), kxy) in plan:
            nn = row[kn] or 0
            r = None
            if nn >= 2:
                sx, sy = row[ksx] or 0.0, row[ksy] or 0.0
                cxy = (row[kxy] or 0.0) - sx * sy / nn
                cxx = (row[ksxx] or 0.0) - sx * sx / nn
                cyy = (row[ksyy] or 0.0) - sy * sy / nn
                if cxx > 0 and cyy > 0:
                    r = max(-1.0, min(1.0, cxy / math.sqrt(cxx * cyy)))
            out_rows.append((cols[i], cols[j], r))
            if i != j:
                out_rows.append((cols[j], cols[i], r))
    return spark.createDataFrame(out_rows, "col_a string, col_b string, r double")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row (rows, distinct_rows, duplicate_rows); missing equals missing."""
    distinct = df.distinct().select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", distinct.alias("distinct_rows"), (F.col("rows") - distinct).alias("duplicate_rows")
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """One row (rows, columns, missing_cells, missing_pct of all cells)."""
    p = profile_frame(df)
    return p.select("rows", "columns", "missing_cells", F.col("missing_percent").alias("missing_pct"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """A10: (column, n_unique) ignoring missing; ``approx`` uses HyperLogLog++ (one pass,
    no shuffle of values) for very wide/high-cardinality tables."""
    cols = cols if cols is not None else df.columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d{i}") for i, c in enumerate(cols)])
        stack = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
        return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column, n_unique)")
    wide = df.select(*[present(df, c).alias(c) for c in cols])
    vc = K.value_counts_long(wide, cols, "string")
    got = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    allc = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return allc.join(got, "column", "left").select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """(value, count) count descending."""
    base = df.select(present(df, col).alias("value"))
    if dropna:
        base = base.where(F.col("value").isNotNull())
    return base.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def time_trend(df: DataFrame, time_col: str, value_col: str | None = None) -> DataFrame:
    """Per timestamp the mean of a numeric ``value_col`` (else the row count);
    unparseable or missing times dropped; ascending time."""
    dt = tc.field_type(df, time_col)
    time = K.quoted(time_col)
    t = time.cast("timestamp_ntz") if tc.is_datetime(dt) else F.coalesce(*[parse_datetime(time, f) for f in DATETIME_FORMATS])
    averaged = bool(value_col) and value_col in df.columns and tc.is_numeric(tc.field_type(df, value_col))
    base = df.select(t.alias("_t"), *([present(df, value_col).alias("_v")] if averaged else [])).where(F.col("_t").isNotNull())
    found = base.groupBy("_t").agg((F.avg("_v") if averaged else F.count(F.lit(1))).alias("_r")).orderBy("_t")
    return found.select(F.col("_t").alias(time_col), F.col("_r").alias(value_col if averaged else "count"))


_FIXED_WIDTH = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def _cell_bytes(df: DataFrame, f: T.StructField) -> Column:
    c = K.quoted(f.name)
    dt = f.dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(dt, T.ArrayType) and type(dt.elementType) in _FIXED_WIDTH:
        return F.coalesce(F.size(c), F.lit(0)) * _FIXED_WIDTH[type(dt.elementType)]
    width = _FIXED_WIDTH.get(type(dt))
    if width is None:  # map/struct/other: text size of its JSON form
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return F.when(c.isNull(), 0).otherwise(width)


def table_bytes(df: DataFrame) -> DataFrame:
    """A13 (re-aimed): data size in bytes, fixed width per non-missing cell plus the UTF-8
    length of text; one row (rows, bytes)."""
    total = None
    for f in df.schema.fields:
        b = F.sum(_cell_bytes(df, f).cast("long"))
        total = b if total is None else total + b
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).alias("bytes"))


def column_type_counts(df: DataFrame) -> DataFrame:
    """(type_class, n_columns)."""
    classes = [tc.type_class(f.dataType) for f in df.schema.fields]
    rows = [(k, classes.count(k)) for k in ("numeric", "datetime", "categorical")]
    return df.sparkSession.createDataFrame(rows, "type_class string, n_columns long")


def metadata_frame(df: DataFrame) -> DataFrame:
    """A1b (variant): rows, columns, missing, missing_percentage, and column lists where a
    text column whose name has 'date'/'time' counts as date/time if any value parses;
    booleans are categorical there, and ``types`` lists name:type."""
    num = tc.numeric_columns(df)
    cat = [f.name for f in df.schema.fields if tc.is_text(f.dataType) or tc.is_bool(f.dataType)]
    dts = tc.datetime_columns(df)
    cand = [c for c in cat if tc.is_text(tc.field_type(df, c)) and ("date" in c.lower() or "time" in c.lower())]
    p = profile_frame(df)
    checks = [
        F.max(F.coalesce(*[parse_datetime(F.col(f"`{c}`"), f) for f in DATETIME_FORMATS]).isNotNull().cast("int"))
        for c in cand
    ]
    flags = checks or None
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    out = p.select(
        "rows", "columns", F.col("missing_cells").alias("missing"),
        F.col("missing_percent").alias("missing_percentage"), F.lit(types).alias("types"),
    )
    if flags is None:
        return out.select(
            "*", F.lit(",".join(num)).alias("numerical_columns"),
            F.lit(",".join(cat)).alias("categorical_columns"), F.lit(",".join(dts)).alias("datetime_columns"),
        )
    every = df.select(F.struct(*[check.alias(f"k{i}") for i, check in enumerate(checks)])).scalar()
    hit = {c: every.getField(f"k{i}") == 1 for i, c in enumerate(cand)}
    dt_list = F.concat_ws(",", *[F.lit(c) for c in dts], *[F.when(hit[c], F.lit(c)) for c in cand])
    cat_list = F.concat_ws(",", *[F.when(~hit[c], F.lit(c)) if c in hit else F.lit(c) for c in cat])
    return out.select(
        "rows", "columns", "missing", "missing_percentage", "types",
        F.lit(",".join(num)).alias("numerical_columns"), cat_list.alias("categorical_columns"),
        dt_list.alias("datetime_columns"),
    )


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (result tables are compared at this precision)."""
    return df.select(*[
        (F.round(K.quoted(f.name), digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else K.quoted(f.name)).alias(f.name)
        for f in df.schema.fields
    ])


__all__ = [
    "DataProfile", "build_profile", "profile_frame", "summary_statistics", "missing_values_table",
    "class_distribution", "imbalance_ratio", "imbalance_ratio_frame", "correlation_matrix", "duplicate_rows",
    "missing_cells", "distinct_counts", "value_counts", "time_trend", "table_bytes", "column_type_counts",
    "metadata_frame", "missing_counts", "present", "round_doubles", "r6",
]
