"""Numbers behind each chart (V1-V7); drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import typeclass as tc
from ..functions.columns import missing_flag
from . import profile as P

HIST_BINS = 50
TOP_CATEGORIES = 25
HEATMAP_ROWS = 300


def missing_values_chart(df: DataFrame, ascending: bool = False) -> DataFrame:
    """V1: (column, missing_count) for columns with missing cells (variant: ascending)."""
    mc = P.missing_counts(df).where(F.col("missing_count") > 0).select("column", "missing_count")
    return mc.orderBy(F.col("missing_count").asc() if ascending else F.col("missing_count").desc(), "column")


def missing_heatmap(df: DataFrame, order_cols: list[str], max_rows: int = HEATMAP_ROWS) -> DataFrame:
    """V2: missing flags of the first ``max_rows`` rows (by ``order_cols``), long form
    (row, column, missing).  The head is a top-k, so only ``max_rows`` rows move."""
    head = df.orderBy(*order_cols).limit(max_rows)
    flags = head.select(*order_cols, *[missing_flag(P.present(df, c)).alias(f"_m_{i}") for i, c in enumerate(df.columns)])
    w = Window.orderBy(*order_cols)  # at most max_rows rows
    flags = flags.withColumn("row", (F.row_number().over(w) - 1).cast("long"))
    stack = ", ".join(f"'{c}', _m_{i}" for i, c in enumerate(df.columns))
    return flags.selectExpr("row", f"stack({len(df.columns)}, {stack}) AS (column, missing)")


def _bin_expr(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    return F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width), F.lit(bins - 1))
    ).cast("int")


def histogram(df: DataFrame, column: str, bins: int = HIST_BINS, zero_missing: bool = False,
              bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """One-sided equal-width histogram (bin, bin_start, bin_end, count); the maximum goes
    into the last bin and a constant column is a single bin."""
    x = P.present(df, column).cast("double")
    if zero_missing:
        x = F.coalesce(x, F.lit(0.0))
    base = df.select(x.alias("x")).where(F.col("x").isNotNull())
    if bounds is None:
        mm = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    else:
        lo, hi = bounds
    width = (hi - lo) / bins
    return (
        base.select(_bin_expr(F.col("x"), lo, hi, bins).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_end"),
            "count",
        )
        .orderBy("bin")
    )


def distribution_comparison(real: DataFrame, synth: DataFrame, column: str, bins: int = HIST_BINS,
                            zero_missing: bool = False) -> DataFrame:
    """V5 / V5b (``zero_missing``): (side, bin, bin_start, bin_end, count) over bins shared
    by both sides (common min/max)."""
    def vals(df: DataFrame) -> Column:
        x = P.present(df, column).cast("double")
        return F.coalesce(x, F.lit(0.0)) if zero_missing else x

    both = real.select(vals(real).alias("x"), F.lit("real").alias("side")).unionByName(
        synth.select(vals(synth).alias("x"), F.lit("generated").alias("side"))
    ).where(F.col("x").isNotNull())
    mm = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    width = (hi - lo) / bins
    return (
        both.select("side", _bin_expr(F.col("x"), lo, hi, bins).alias("bin"))
        .groupBy("side", "bin").agg(F.count(F.lit(1)).alias("count"))
        .select(
            "side", "bin", (lo + F.col("bin") * width).alias("bin_start"),
            F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_end"), "count",
        )
        .orderBy("side", "bin")
    )


def top_categories(df: DataFrame, column: str, n: int = TOP_CATEGORIES) -> DataFrame:
    """T5s/V6: (value, count) of the ``n`` most frequent text forms, ties by value."""
    return (
        df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value").limit(n)
    )


def feature_distribution(df: DataFrame, column: str) -> DataFrame:
    """V6: 50-bin histogram for a numeric column, else the top-25 categories."""
    if tc.is_numeric(tc.field_type(df, column)):
        return histogram(df, column)
    return top_categories(df, column)


def class_balance(df: DataFrame, target: str, dropna: bool = False) -> DataFrame:
    """V4: class counts on the text form."""
    return P.class_distribution(df, target, dropna=dropna).select("class", "count")


def correlation_heatmap(df: DataFrame) -> DataFrame:
    """V3: the long correlation matrix."""
    return P.correlation_matrix(df)


def time_trend_chart(df: DataFrame, time_col: str, value_col: str | None = None) -> DataFrame:
    """V7: A12 with parsing of text times."""
    return P.time_trend(df, time_col, value_col)
