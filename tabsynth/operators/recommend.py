"""Generator recommendation.

The rules are evaluated inside one lazy one-row DataFrame whose inputs are scalar
subqueries (row count, class counts, parse rates), so the same frame can be queried,
joined or collected; :func:`recommend_model` collects its single row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typeclass as tc
from ..functions.columns import DATETIME_FORMATS, TIME_NAME_TERMS, parse_datetime
from ..functions.names import has_any_term
from . import profile as P

# Thresholds of the main and the variant rule sets.
SMOTE_RATIO = 0.35
LARGE_ROWS, LARGE_COLS = 8000, 12
CAT_SHARE, CAT_COUNT = 0.35, 5
TIME_PARSE_RATE = 0.8
V2_SMOTE_RATIO = 0.3
V2_CAT_SHARE, V2_CAT_COUNT = 0.4, 5
V2_LARGE_ROWS, V2_LARGE_NUMERIC = 10000, 10

# Model name aliases (variant naming).
MODEL_ALIASES = {"TimeGAN": "Sequential", "TimeGAN / Sequential": "Sequential"}


@dataclass
class ModelRecommendation:
    model: str
    reason: str
    imbalance_ratio: float | None
    detected_time_column: str | None


def canonical_model(name: str) -> str:
    """Map sequential-model aliases to one name."""
    return MODEL_ALIASES.get(name.strip(), name.strip())


def any_datetime(c: Column) -> Column:
    return F.coalesce(*[parse_datetime(c, f) for f in DATETIME_FORMATS])


def time_column_expr(df: DataFrame) -> Column:
    """M3 as a scalar Column: the first date/time column; else the first text column whose
    name mentions date/time and >= 80 % of all rows (missing = failure) parse."""
    dts = tc.datetime_columns(df)
    if dts:
        return F.lit(dts[0])
    cand = [c for c in df.columns if tc.is_text(tc.field_type(df, c)) and has_any_term(c, TIME_NAME_TERMS)]
    if not cand:
        return F.lit(None).cast("string")
    # one struct, so all candidates share one scan (equal subqueries are reused)
    every = df.select(F.struct(*[F.avg(any_datetime(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"r{i}") for i, c in enumerate(cand)])).scalar()
    rates = [every.getField(f"r{i}") for i in range(len(cand))]
    out = F.when(rates[0] >= TIME_PARSE_RATE, F.lit(cand[0]))
    for c, r in zip(cand[1:], rates[1:]):
        out = out.when(r >= TIME_PARSE_RATE, F.lit(c))
    return out


def infer_time_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(time_column_expr(df).alias("detected_time_column"))


def infer_time_column(df: DataFrame) -> str | None:
    return infer_time_frame(df).first()[0]


def recommend_frame(df: DataFrame, target: str | None = None, time_col: str | None = None) -> DataFrame:
    """M1: one row (model, reason, imbalance_ratio, detected_time_column); first rule that
    matches wins: time signal -> TimeGAN; imbalance < 0.35 -> SMOTE; > 8000 rows and > 12
    columns -> TVAE; text/bool share >= 0.35 or >= 5 such columns -> CTGAN; else
    GaussianCopula.  An empty table gets GaussianCopula."""
    spark = df.sparkSession
    rows = df.select(F.count(F.lit(1))).scalar()
    t = F.lit(time_col) if time_col and time_col in df.columns else time_column_expr(df)
    if target and target in df.columns:
        ratio = P.imbalance_ratio_frame(df, target).select("imbalance_ratio").scalar()
    else:
        ratio = F.lit(None).cast("double")
    n_cols = len(df.columns)
    n_cat = len(tc.text_columns(df, include_bool=True))
    cat_ratio = n_cat / max(n_cols, 1)
    large = F.lit(n_cols > LARGE_COLS) & (rows > LARGE_ROWS)
    catty = (cat_ratio >= CAT_SHARE) or (n_cat >= CAT_COUNT)
    ratio_txt = F.format_number(ratio, 2)
    model = (
        F.when(rows == 0, F.lit("GaussianCopula"))
        .when(t.isNotNull(), F.lit("TimeGAN"))
        .when(ratio < SMOTE_RATIO, F.lit("SMOTE"))
        .when(large, F.lit("TVAE"))
        .when(F.lit(catty), F.lit("CTGAN"))
        .otherwise(F.lit("GaussianCopula"))
    )
    reason = (
        F.when(rows == 0, F.lit("Empty input: falling back to the Gaussian copula."))
        .when(t.isNotNull(), F.concat(F.lit("Time column '"), t, F.lit("' found: sequential synthesis.")))
        .when(ratio < SMOTE_RATIO, F.concat(F.lit("Class imbalance ratio "), ratio_txt,
                                            F.lit(f" on '{target}': oversampling with SMOTE.")))
        .when(large, F.lit("Many rows and columns: TVAE."))
        .when(F.lit(catty), F.lit("Many categorical columns: CTGAN."))
        .otherwise(F.lit("Small, mostly numeric table: Gaussian copula."))
    )
    return spark.range(1).select(
        model.alias("model"), reason.alias("reason"),
        F.when(rows == 0, F.lit(None).cast("double")).otherwise(ratio).alias("imbalance_ratio"),
        F.when((rows > 0) & t.isNotNull(), t).alias("detected_time_column"),
    )


def recommend_model(df: DataFrame, target: str | None = None, time_col: str | None = None) -> ModelRecommendation:
    r = recommend_frame(df, target, time_col).first()
    return ModelRecommendation(r["model"], r["reason"], r["imbalance_ratio"], r["detected_time_column"])


def recommend_frame_v2(df: DataFrame, target: str | None = None, time_col: str | None = None) -> DataFrame:
    """M2 (variant rules): given time column or any date/time column -> TimeGAN; binary
    target (missing excluded) with ratio < 0.3 -> SMOTE; text/bool share > 0.4 or more than
    5 such columns -> CTGAN; > 10000 rows and > 10 numeric -> TVAESynthesizer; else
    GaussianCopulaSynthesizer."""
    spark = df.sparkSession
    rows = df.select(F.count(F.lit(1))).scalar()
    dts = tc.datetime_columns(df)
    has_time = bool(time_col and time_col in df.columns) or bool(dts)
    if target and target in df.columns:
        ratio = P.imbalance_ratio_frame(df, target, dropna=True, binary_only=True).select("imbalance_ratio").scalar()
    else:
        ratio = F.lit(None).cast("double")
    n_cols = len(df.columns)
    n_cat = len(tc.text_columns(df, include_bool=True))
    n_num = len(tc.numeric_columns(df))
    catty = (n_cat / n_cols if n_cols else 0) > V2_CAT_SHARE or n_cat > V2_CAT_COUNT
    big = F.lit(n_num > V2_LARGE_NUMERIC) & (rows > V2_LARGE_ROWS)
    model = (
        F.when(rows == 0, F.lit("GaussianCopulaSynthesizer"))
        .when(F.lit(has_time), F.lit("TimeGAN"))
        .when(ratio < V2_SMOTE_RATIO, F.lit("SMOTE"))
        .when(F.lit(catty), F.lit("CTGAN"))
        .when(big, F.lit("TVAESynthesizer"))
        .otherwise(F.lit("GaussianCopulaSynthesizer"))
    )
    reason = (
        F.when(rows == 0, F.lit("Empty input: default model."))
        .when(F.lit(has_time), F.lit("Date/time data: sequential model."))
        .when(ratio < V2_SMOTE_RATIO, F.concat(F.lit("Binary imbalance ratio "), F.format_number(ratio, 2), F.lit(": SMOTE.")))
        .when(F.lit(catty), F.lit("Mostly categorical columns: CTGAN."))
        .when(big, F.lit("Large numeric table: TVAE."))
        .otherwise(F.lit("Small table: Gaussian copula."))
    )
    return spark.range(1).select(model.alias("model"), reason.alias("reason"))
