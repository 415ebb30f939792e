"""Gaussian copula generator (G1).

Fit
* continuous columns (numbers and date/times with more than ``DISCRETE_MAX`` distinct
  values): ``M + 1`` exact quantile knots -- a piecewise-linear marginal CDF;
* discrete columns (text, booleans, numbers with few values): frequency table with
  cumulative shares (``lo``, ``hi``) from the distributed running-count kernel;
* normal scores ``z = PhiInv(u)`` per cell (mid-point of the cell's CDF step), and their
  pairwise-complete correlation matrix (one aggregate pass); the d x d matrix is made
  positive definite and Cholesky-factored on the driver (d x d numbers only).

Sample
* ``spark.range(n)`` -> seeded uniforms -> Box-Muller normals -> correlated normals
  ``L e`` as column arithmetic -> ``Phi`` -> inverse marginal: knot interpolation for
  continuous columns, a bucketed equi-join (bucket of u, then ``lo <= u < hi``) against the
  frequency table for discrete ones, so no table is ever collected or capped;
* the missing share of each column is reproduced with a seeded Bernoulli draw.
Every draw is a hash of (seed, stream, row id): the sample does not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import typeclass as tc
from ...functions.columns import box_muller, epoch_micros, normal_cdf, normal_ppf, uniform
from ...plans import kernels as K
from .. import profile as P

KNOTS = 100
DISCRETE_MAX = 64
BUCKETS = 4096
SEED = 42
EPS = 1e-9


@dataclass
class CopulaModel:
    columns: list[str]
    types: dict[str, T.DataType]
    continuous: list[str]
    discrete: list[str]
    knots: dict[str, list[float]]
    null_rate: dict[str, float]
    freq: DataFrame | None  # (column, value string, lo, hi)
    chol: np.ndarray
    order: list[str] = field(default_factory=list)  # column order of the correlation matrix


def _value(df: DataFrame, c: str) -> Column:
    """Continuous value as double (date/time as epoch seconds)."""
    dt = tc.field_type(df, c)
    col = F.col(f"`{c}`")
    if tc.is_datetime(dt):
        return epoch_micros(col, dt).cast("double") / 1000000.0
    return P.present(df, c).cast("double")


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def marginal_knots(df: DataFrame, cols: list[str], m: int = KNOTS) -> DataFrame:
    """Long (column, k, value): the k/m quantiles (k = 0..m) of each continuous column."""
    wide = df.select(*[_value(df, c).alias(c) for c in cols])
    q = K.exact_quantiles(wide, cols, [k / m for k in range(m + 1)])
    return q.select("column", F.round(F.col("prob") * m).cast("int").alias("k"), "value")


def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, cnt, lo, hi): cumulative shares of each value (value order), from
    the range-split running count -- no column is gathered into one task."""
    vc = K.value_counts_long(df.select(*[_text(c).alias(c) for c in cols]), cols, "string")
    cum = K.prefix_sums(vc, ["column"], ["value"], ["cnt"], prefix="cum_")
    tot = vc.groupBy("column").agg(F.sum("cnt").alias("_n"))
    return cum.join(F.broadcast(tot), "column").select(  # one row per column
        "column", "value", "cnt",
        ((F.col("cum_cnt") - F.col("cnt")) / F.col("_n")).alias("lo"),
        (F.col("cum_cnt") / F.col("_n")).alias("hi"),
    )


def _cdf_from_knots(x: Column, knots: list[float]) -> Column:
    """Piecewise-linear CDF through (knot_k, k/M); a value equal to a run of equal knots
    gets the middle of the run (point mass).  A flat CASE over the distinct knot values
    (at most M + 1), which whole-stage codegen compiles into small split methods."""
    m = len(knots) - 1
    vals: list[float] = []
    first: list[int] = []
    last: list[int] = []
    for k, v in enumerate(knots):
        if vals and v == vals[-1]:
            last[-1] = k
        else:
            vals.append(float(v))
            first.append(k)
            last.append(k)

    def at(i: int) -> Column:
        return F.lit((first[i] + last[i]) / 2.0 / m)

    def between(i: int) -> Column:  # vals[i] < x < vals[i+1]
        return (F.lit(float(last[i])) + (x - F.lit(vals[i])) / F.lit(vals[i + 1] - vals[i])) / F.lit(float(m))

    if len(vals) == 1:
        u = F.lit(0.5)
    else:
        # flat CASE (Spark splits long branch lists into small methods): on a knot value ->
        # middle of its run; strictly between two knot values -> linear interpolation
        u = F.when(x <= F.lit(vals[0]), at(0))
        for i in range(1, len(vals)):
            u = u.when(x < F.lit(vals[i]), between(i - 1)).when(x == F.lit(vals[i]), at(i))
        u = u.otherwise(at(len(vals) - 1))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(u, F.lit(EPS)), F.lit(1.0 - EPS)))


def _inverse_knots(u: Column, knots: list[float]) -> Column:
    m = len(knots) - 1
    arr = F.array(*[F.lit(float(v)) for v in knots])
    pos = u * m
    k = F.least(F.greatest(F.floor(pos).cast("int"), F.lit(0)), F.lit(m - 1))
    a = F.element_at(arr, k + 1)
    b = F.element_at(arr, k + 2)
    return a + (pos - k) * (b - a)


def nearest_correlation(r: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Symmetric, unit-diagonal, positive-definite version of ``r`` (eigenvalue clip)."""
    r = np.nan_to_num((r + r.T) / 2.0)
    np.fill_diagonal(r, 1.0)
    w, v = np.linalg.eigh(r)
    w = np.clip(w, floor, None)
    s = (v * w) @ v.T
    d = np.sqrt(np.diag(s))
    s = s / np.outer(d, d)
    np.fill_diagonal(s, 1.0)
    return s


def fit_copula(df: DataFrame, m: int = KNOTS, discrete_max: int = DISCRETE_MAX) -> CopulaModel:
    cols = [f.name for f in df.schema.fields if not tc.is_nested(f.dataType)]
    if not cols:
        raise ValueError("No column can be modelled by the copula.")
    types = {f.name: f.dataType for f in df.schema.fields}
    numlike = [c for c in cols if tc.is_numeric(types[c]) or tc.is_datetime(types[c])]
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(P.present(df, c) if c in numlike else F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)],
    ).first()
    rows = stats["_rows"]
    if rows == 0:
        raise ValueError("there are no rows to fit")
    null_rate = {c: 1.0 - stats[f"n{i}"] / rows for i, c in enumerate(cols)}
    present = [c for i, c in enumerate(cols) if stats[f"n{i}"] > 0]
    continuous = [c for c in present if c in numlike and stats[f"d{cols.index(c)}"] > discrete_max]
    discrete = [c for c in present if c not in continuous]
    knots: dict[str, list[float]] = {}
    if continuous:
        for r in marginal_knots(df, continuous, m).collect():
            knots.setdefault(r["column"], [0.0] * (m + 1))[r["k"]] = r["value"]
    freq = K._persist(frequency_table(df, discrete)) if discrete else None
    order = continuous + discrete
    # normal scores of every cell, then their correlation (pairwise complete)
    x = df.select(
        *[_value(df, c).alias(f"x{i}") for i, c in enumerate(continuous)],
        *[_text(c).alias(f"t{j}") for j, c in enumerate(discrete)],
    )
    u = x.select(
        *[_cdf_from_knots(F.col(f"x{i}"), knots[c]).alias(f"u{i}") for i, c in enumerate(continuous)],
        *[F.col(f"t{j}") for j in range(len(discrete))],
    )
    z = u.select(
        *[normal_ppf(F.col(f"u{i}")).alias(f"z{i}") for i in range(len(continuous))],
        *[F.col(f"t{j}") for j in range(len(discrete))],
    )
    for j, c in enumerate(discrete):
        f = freq.where(F.col("column") == c).select(
            F.col("value").alias(f"t{j}"), normal_ppf(F.least(F.greatest((F.col("lo") + F.col("hi")) / 2.0, F.lit(EPS)), F.lit(1 - EPS))).alias(f"z{len(continuous) + j}")
        )
        z = z.join(f, f"t{j}", "left")
    zcols = [f"z{i}" for i in range(len(order))]
    # the score projection is wide code; keep it out of the aggregate's codegen stage
    z = K._persist(z.select(*zcols))
    d = len(order)
    corr = np.eye(d)
    if d >= 2:
        for r in P.correlation_matrix(z.select(*zcols), zcols).collect():
            a, b = int(r["col_a"][1:]), int(r["col_b"][1:])
            corr[a, b] = r["r"] if r["r"] is not None else (1.0 if a == b else 0.0)
    chol = np.linalg.cholesky(nearest_correlation(corr))
    return CopulaModel(cols, types, continuous, discrete, knots, null_rate, freq, chol, order)


def sample_copula(model: CopulaModel, spark, n: int, seed: int = SEED) -> DataFrame:
    """n generated rows with the fitted marginals and normal-score correlation."""
    d = len(model.order)
    base = spark.range(n).withColumnRenamed("id", "_id")
    e = [box_muller(uniform(seed, f"e{j}a", F.col("_id")), uniform(seed, f"e{j}b", F.col("_id"))) for j in range(d)]
    base = base.select("_id", *[x.alias(f"_e{j}") for j, x in enumerate(e)])
    zs = []
    for i in range(d):
        terms = [F.col(f"_e{j}") * float(model.chol[i, j]) for j in range(i + 1) if model.chol[i, j] != 0.0]
        z = terms[0]
        for t in terms[1:]:
            z = z + t
        zs.append(F.least(F.greatest(normal_cdf(z), F.lit(0.0)), F.lit(1.0 - 1e-12)).alias(f"_u{i}"))
    # write the drawn uniforms once: the inverse-marginal joins and filters then read stored
    # values instead of re-deriving every hash (filter pushdown would inline the draws)
    out = K._cut(base.select("_id", *zs))
    # discrete columns: bucketed equi-join on the frequency table
    for j, c in enumerate(model.discrete):
        i = len(model.continuous) + j
        f = (
            model.freq.where(F.col("column") == c)
            .select("value", "lo", "hi",
                    F.explode(F.sequence(F.floor(F.col("lo") * BUCKETS).cast("int"),
                                         F.least(F.ceil(F.col("hi") * BUCKETS).cast("int") - 1, F.lit(BUCKETS - 1)))).alias("_b"))
        )
        out = out.withColumn("_b", F.floor(F.col(f"_u{i}") * BUCKETS).cast("int"))
        out = (
            out.join(f, "_b")
            .where((F.col("lo") <= F.col(f"_u{i}")) & (F.col(f"_u{i}") < F.col("hi")))
            .drop("_b", "lo", "hi")
            .withColumnRenamed("value", f"_v{j}")
        )
    sel = []
    for c in model.columns:
        t = model.types[c]
        if c in model.continuous:
            i = model.continuous.index(c)
            x = _inverse_knots(F.col(f"_u{i}"), model.knots[c])
            if isinstance(t, T.TimestampType):
                v = F.timestamp_micros(F.round(x * 1000000.0).cast("long"))
            elif tc.is_datetime(t):  # wall-clock types: add to the epoch without a time zone
                v = F.timestamp_add("MICROSECOND", F.round(x * 1000000.0).cast("long"),
                                    F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast(t)
            elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                v = F.rint(x).cast(t)
            else:
                v = x.cast(t)
        elif c in model.discrete:
            v = F.col(f"_v{model.discrete.index(c)}")
            v = (F.lower(v) == "true") if isinstance(t, T.BooleanType) else v.cast(t)
        else:  # column without any value
            v = F.lit(None).cast(t)
        rate = model.null_rate.get(c, 0.0)
        if 0.0 < rate < 1.0:
            v = F.when(uniform(seed, f"null-{c}", F.col("_id")) < rate, F.lit(None).cast(t)).otherwise(v)
        sel.append(v.alias(c))
    return out.select(*sel)


def generate_gaussian_copula(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    if n <= 0:
        raise ValueError(f"cannot draw {n} rows")
    model = fit_copula(df)
    return sample_copula(model, df.sparkSession, n, seed)
