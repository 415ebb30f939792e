"""Real-vs-generated evaluation.

Column statistics are one wide aggregate a table;
the two-sample Kolmogorov-Smirnov statistic counts both sides in bins and opens only the
bins that may hold it (no column is ever gathered into one task or onto the driver).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typeclass as tc
from ..functions.names import common_columns
from ..plans import kernels as K
from . import profile as P

KS_TERMS = 100
KS_BINS, KS_COLUMNS, KS_SAMPLE = 2048, 16, 20_000  # bins a column, columns counted in one job, rows that the edges come from
KS_HELD, KS_DEALT = 250_000, 1_000_000  # values of a column that a task counts at a time, values of opened bins a task of the shuffle


def shared_numeric(real: DataFrame, synth: DataFrame) -> list[str]:
    """Numeric columns of ``real`` that ``synth`` also has (order of ``real``)."""
    return common_columns(tc.numeric_columns(real), synth.columns)


def both_numeric(real: DataFrame, synth: DataFrame) -> list[str]:
    """Columns numeric in both tables (order of ``real``)."""
    return common_columns(tc.numeric_columns(real), tc.numeric_columns(synth))


def _side_stats(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """One row a column from one wide aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        v = P.present(df, c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(f"{prefix}_n"), F.col(f"m{i}").alias(f"{prefix}_mean"), F.col(f"s{i}").alias(f"{prefix}_std"))
            for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def compare_column_statistics(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Per shared numeric column with values on both sides: real/synth mean and
    sample std, and their absolute differences."""
    cols = shared_numeric(real, synth)
    spark = real.sparkSession
    schema = ("column string, real_mean double, synth_mean double, real_std double, synth_std double, "
              "mean_abs_diff double, std_abs_diff double")
    if not cols:
        return spark.createDataFrame([], schema)
    r = _side_stats(real, cols, "real")
    s = _side_stats(synth, cols, "synth")
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return (
        r.join(s, "column")
        .where((F.col("real_n") > 0) & (F.col("synth_n") > 0))
        .select(
            "column", "real_mean", "synth_mean", "real_std", "synth_std",
            F.abs(F.col("real_mean") - F.col("synth_mean")).alias("mean_abs_diff"),
            F.abs(F.col("real_std") - F.col("synth_std")).alias("std_abs_diff"),
        )
        .orderBy(order[F.col("column")])
    )


def compare_column(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """(metric, real, generated, pct_error) for Mean, Std Dev, Min, Max of one column."""
    def side(df: DataFrame) -> DataFrame:
        v = P.present(df, column).cast("double")
        return df.agg(F.avg(v).alias("Mean"), F.stddev_samp(v).alias("Std Dev"), F.min(v).alias("Min"),
                      F.max(v).alias("Max"), F.count(v).alias("_n"))

    r, s = side(real), side(synth)
    metrics = ["Mean", "Std Dev", "Min", "Max"]

    def longify(df: DataFrame, name: str) -> DataFrame:
        stack = ", ".join(f"'{m}', `{m}`" for m in metrics)
        return df.where(F.col("_n") > 0).selectExpr(f"stack(4, {stack}) AS (metric, {name})")

    from ..functions.columns import pct_error

    return (
        longify(r, "real").join(longify(s, "generated"), "metric")
        .select("metric", "real", "generated", pct_error(F.col("real"), F.col("generated")).alias("pct_error"))
    )


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = KS_TERMS) -> Column:
    """Asymptotic two-sided p-value: Kolmogorov series at lambda = D*sqrt(n1 n2/(n1+n2)),
    clipped to [0, 1], 1 for lambda < 0.2."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def ks_test_report(real: DataFrame, synth: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, ks_statistic, p_value, similarity_score) per shared numeric column with
    values on both sides, similarity descending.

    D = max over distinct values of |F_real - F_synth|, by branch and bound.  Both sides are
    counted in bins between sketched edges (a few hundred a column); the running counts at the
    edges give the best D so far and, for every bin, the most that a value inside can reach.
    Only the values of bins that may beat it are counted one by one and shuffled."""
    cols = cols if cols is not None else shared_numeric(real, synth)
    spark = real.sparkSession
    schema = "column string, ks_statistic double, p_value double, similarity_score double"
    if not cols:
        return spark.createDataFrame([], schema)

    def side(df: DataFrame, real_side: int) -> DataFrame:
        return df.select(F.lit(real_side).alias("side"), *[K.finite(P.present(df, c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    both = side(real, 1).unionByName(side(synth, 0))
    best, spans, rows, inside = [], {}, both.count(), 0
    for some in K.chunked(list(range(len(cols))), KS_COLUMNS):
        d, opened, n = _ks_bins(both, some, K.sampled(both, rows, 1, KS_SAMPLE))
        best += d
        spans.update(opened)
        inside += n
    best = spark.createDataFrame(best, "i int, n1 bigint, n2 bigint, d double")
    if spans:
        best = best.join(_ks_inside(both, spans, inside), "i", "left").withColumn("d", F.greatest("d", F.coalesce("inside", F.lit(0.0))))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    return best.select(
        name.alias("column"), F.col("d").alias("ks_statistic"),
        ks_pvalue(F.col("d"), F.col("n1").cast("double"), F.col("n2").cast("double")).alias("p_value"),
        (1.0 - F.col("d")).alias("similarity_score"),
    ).orderBy(F.desc("similarity_score"), "column")


def _ks_bins(both: DataFrame, cols: list[int], sample: DataFrame) -> tuple[list, dict]:
    """Best D at the edges, (i, n1, n2, d) for each column with values on both sides, and the
    bins to open: {i: [(low, high, counts of both sides below, n1, n2)]}, low <= value < high, and
    how many values they hold."""
    probs = np.arange(KS_BINS + 1) / KS_BINS
    some = sample.select(*[f"v{i}" for i in cols]).toPandas()  # about KS_SAMPLE rows
    edges = {}
    for i in cols:  # any edges are right, sampled ones are even
        v = some[f"v{i}"].dropna().to_numpy(float)
        edges[i] = sorted({*np.quantile(v, probs, method="lower").tolist()}) if len(v) else [0.0]

    def count(batches):
        totals = {i: np.zeros((len(e) + 1, 2), np.int64) for i, e in edges.items()}
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            for (i, e), v in zip(edges.items(), batch.columns[1:]):
                v = v.to_numpy(zero_copy_only=False)  # NULL is NaN here
                given = ~np.isnan(v)
                at = np.searchsorted(np.array(e), v[given], side="right") * 2 + (1 - side[given])
                totals[i] += np.bincount(at, minlength=2 * len(e) + 2).reshape(-1, 2)
        rows = [(i, k, int(c1), int(c2)) for i, t in totals.items() for k, (c1, c2) in enumerate(t) if c1 or c2]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.int64()])], names=["i", "bin", "c1", "c2"])
    counts = both.select("side", *[f"v{i}" for i in edges]).mapInArrow(count, "i int, bin int, c1 bigint, c2 bigint")
    counts = counts.groupBy("i", "bin").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    by = {(r["i"], r["bin"]): (r["c1"], r["c2"]) for r in counts.collect()}  # columns x bins
    best, spans, inside = [], {}, 0
    for i, e in edges.items():
        e = [float("-inf"), *e, None]  # bin k holds e[k] <= value < e[k + 1]
        rows = [by.get((i, k), (0, 0)) for k in range(len(e) - 1)]
        n1, n2 = (sum(r[s] for r in rows) for s in (0, 1))
        if not n1 or not n2:
            continue
        below, d = [(0, 0)], 0.0
        for c1, c2 in rows:
            below.append((below[-1][0] + c1, below[-1][1] + c2))
            d = max(d, abs(below[-1][0] / n1 - below[-1][1] / n2))
        for k, (c1, c2) in enumerate(rows):
            a, b = below[k], below[k + 1]
            # inside the bin one side may already be counted in full while the other is not at all
            if c1 and c2 and max(b[0] / n1 - a[1] / n2, b[1] / n2 - a[0] / n1) > d:
                spans.setdefault(i, []).append((e[k], e[k + 1], *a, n1, n2))
                inside += c1 + c2
        best.append((i, n1, n2, d))
    return best, spans, inside


def _ks_inside(both: DataFrame, spans: dict, rows: int) -> DataFrame:
    """(i, inside): largest difference at the values of the opened bins, which hold ``rows``
    values; so many tasks that none gets more than about ``KS_DEALT`` of them."""
    n = max(-(-rows // KS_DEALT), min(K.default_ranges(both.sparkSession), -(-rows // 50_000)))
    keyed = [(i, k, *span) for i, found in spans.items() for k, span in enumerate(found)]
    lows = {i: [x[0] for x in found] for i, found in spans.items()}
    highs = {i: [float("inf") if x[1] is None else x[1] for x in found] for i, found in spans.items()}
    last = {i: found[-1][1] is None for i, found in spans.items()}  # whether its last bin has no upper edge

    def counted(i, parts):
        v, side = (np.concatenate(x) for x in zip(*parts))
        distinct, of = np.unique(v, return_inverse=True)
        c = np.bincount(of * 2 + (1 - side), minlength=2 * len(distinct)).reshape(-1, 2)
        bins = np.searchsorted(np.array(lows[i]), distinct, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(distinct), i), pa.int32()), pa.array(bins, pa.int32()), pa.array(distinct), pa.array(c[:, 0]), pa.array(c[:, 1])],
            names=["i", "bin", "v", "c1", "c2"])

    def values(batches):
        held, size = {i: [] for i in lows}, dict.fromkeys(lows, 0)
        for batch in batches:
            side = batch.column(0).to_numpy(zero_copy_only=False)
            for i, v in zip(lows, batch.columns[1:]):
                v = v.to_numpy(zero_copy_only=False)
                at = np.searchsorted(np.array(lows[i]), v, side="right") - 1
                inside = ~np.isnan(v) & (at >= 0) & ((v < np.array(highs[i])[at]) | (last[i] & (at == len(lows[i]) - 1)))
                if inside.any():
                    held[i].append((v[inside], side[inside]))
                    size[i] += len(held[i][-1][0])
                if size[i] >= KS_HELD:
                    yield counted(i, held[i])
                    held[i], size[i] = [], 0
        for i, parts in held.items():
            if parts:
                yield counted(i, parts)
    found = both.select("side", *[f"v{i}" for i in lows]).mapInArrow(values, "i int, bin int, v double, c1 bigint, c2 bigint")
    # dealt by value before they are added up: a table of all that a task finds would grow with the rows of a task
    values = found.repartition(n, "i", "bin", "v").groupBy("i", "bin", "v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    cum = K.prefix_sums(values, ["i", "bin"], ["v"], ["c1", "c2"], n_ranges=n)
    start = both.sparkSession.createDataFrame(keyed, "i int, bin int, low double, high double, b1 bigint, b2 bigint, n1 bigint, n2 bigint")
    d = F.abs((F.col("b1") + F.col("cum_c1")) / F.col("n1") - (F.col("b2") + F.col("cum_c2")) / F.col("n2"))
    return cum.join(F.broadcast(start), ["i", "bin"]).groupBy("i").agg(F.max(d).alias("inside"))  # columns x bins at most


def _corr_pairs(real: DataFrame, synth: DataFrame) -> DataFrame | None:
    cols = both_numeric(real, synth)
    if len(cols) < 2:
        return None
    r = P.correlation_matrix(real, cols).withColumnRenamed("r", "r_real")
    s = P.correlation_matrix(synth, cols).withColumnRenamed("r", "r_synth")
    return r.join(s, ["col_a", "col_b"], "full_outer")


def correlation_difference_frame(real: DataFrame, synth: DataFrame) -> DataFrame:
    """E5: one row ``correlation_difference`` = mean over all d x d cells (diagonal
    included) of |R - S|, undefined r counted as 0; 0.0 with fewer than 2 columns."""
    pairs = _corr_pairs(real, synth)
    spark = real.sparkSession
    if pairs is None:
        return spark.createDataFrame([(0.0,)], "correlation_difference double")
    return pairs.agg(
        F.avg(F.abs(F.coalesce("r_real", F.lit(0.0)) - F.coalesce("r_synth", F.lit(0.0)))).alias("correlation_difference")
    )


def correlation_similarity_frame(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row ``correlation_similarity_score`` = max(0, 1 - E5)."""
    diff = correlation_difference_frame(real, synth)
    return diff.select(F.greatest(F.lit(0.0), 1.0 - F.col("correlation_difference")).alias("correlation_similarity_score"))


def correlation_similarity_score(real: DataFrame, synth: DataFrame) -> float:
    return correlation_similarity_frame(real, synth).first()[0]


def correlation_difference(real: DataFrame, synth: DataFrame) -> float:
    return correlation_difference_frame(real, synth).first()[0]


REPORT_COLUMNS = [
    "metric", "value", "section", "column", "real_mean", "synth_mean", "real_std", "synth_std",
    "mean_abs_diff", "std_abs_diff", "ks_statistic", "p_value", "similarity_score",
]


def build_evaluation_report(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One wide table -- ``summary`` rows (real_rows, generated_rows,
    correlation_similarity_score, avg_ks_similarity), then ``column_statistics`` (E1) and
    ``ks_test`` (E3) rows; without shared numeric columns only the summary (no section)."""
    stats = compare_column_statistics(real, synth)
    ks = ks_test_report(real, synth)
    corr = correlation_similarity_frame(real, synth)
    real_rows = real.select(F.count(F.lit(1)).cast("double")).scalar()
    synth_rows = synth.select(F.count(F.lit(1)).cast("double")).scalar()
    avg_ks = ks.select(F.avg("similarity_score")).scalar()
    corr_v = corr.select("correlation_similarity_score").scalar()
    base = real.sparkSession.range(1)
    summary = reduce(
        lambda a, b: a.unionByName(b),
        [
            base.select(F.lit(m).alias("metric"), v.alias("value"))
            for m, v in [
                ("real_rows", real_rows), ("generated_rows", synth_rows),
                ("correlation_similarity_score", corr_v), ("avg_ks_similarity", avg_ks),
            ]
        ],
    )
    if not shared_numeric(real, synth):
        return summary
    summary = summary.withColumn("section", F.lit("summary"))
    s = stats.withColumn("section", F.lit("column_statistics"))
    k = ks.withColumn("section", F.lit("ks_test"))
    out = summary.unionByName(s, allowMissingColumns=True).unionByName(k, allowMissingColumns=True)
    return out.select(*REPORT_COLUMNS)


def quality_insights(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(side, missing_cells, duplicate_rows) for both tables."""
    def side(df: DataFrame, name: str) -> DataFrame:
        m = P.missing_cells(df).select("missing_cells")
        dup = df.distinct().select(F.count(F.lit(1))).scalar()
        return m.select(F.lit(name).alias("side"), "missing_cells",
                        (df.select(F.count(F.lit(1))).scalar() - dup).alias("duplicate_rows"))

    return side(real, "real").unionByName(side(synth, "generated"))


def correlation_side_by_side(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(side, col_a, col_b, r) for both tables' numeric columns."""
    r = P.correlation_matrix(real).withColumn("side", F.lit("real"))
    s = P.correlation_matrix(synth).withColumn("side", F.lit("generated"))
    return r.unionByName(s).select("side", "col_a", "col_b", "r")


def overview(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(side, rows, columns, bytes, numeric_columns, text_columns)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return P.table_bytes(df).select(
            F.lit(name).alias("side"), "rows", F.lit(len(df.columns)).alias("columns"), "bytes",
            F.lit(len(tc.numeric_columns(df))).alias("numeric_columns"),
            F.lit(len(tc.text_columns(df))).alias("text_columns"),
        )

    return side(real, "real").unionByName(side(synth, "generated"))
