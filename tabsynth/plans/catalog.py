"""Query catalog: every operator of the blueprint as a (spark, sf_dir) -> DataFrame query on
the driver tables, with an equivalent DuckDB SQL oracle.

Inputs used throughout (all whole tables):
* real / generated = ``lineitem`` rows with ``l_returnflag = 'R'`` / the other rows;
* ``dl`` = ``documents LEFT JOIN labels`` (601 of 1,000 label cells missing at sf0.01);
Every double in a result is rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chartdata as V
from ..operators import evaluate as E
from ..operators import profile as P
from ..functions.columns import normalize_token

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def real_synth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") != "R")


def docs_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


R6 = P.round_doubles

# ---- SQL building blocks --------------------------------------------------------------
REAL = "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"
SYNTH = "(SELECT * FROM lineitem WHERE l_returnflag <> 'R')"
DL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
      "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
LINE_ALL = LINE_NUM[:8] + ["l_returnflag", "l_linestatus", "l_shipdate"]
DL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def corr_sql(src: str, cols: list[str], extra: str = "") -> str:
    """Long pairwise-complete Pearson matrix (col_a, col_b, r) of ``src``."""
    aggs = []
    rows = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            aggs.append(
                f"regr_sxy({y}, {x}) / NULLIF(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0) AS r_{i}_{j}"
            )
            rows.append(f"SELECT {extra}'{a}' AS col_a, '{b}' AS col_b, r_{i}_{j} AS r FROM m")
            if i != j:
                rows.append(f"SELECT {extra}'{b}' AS col_a, '{a}' AS col_b, r_{i}_{j} AS r FROM m")
    return f"WITH m AS (SELECT {', '.join(aggs)} FROM {src})\n" + union_all(rows)


def unpivot_sql(src: str, cols: list[str], cast: str = "DOUBLE") -> str:
    sel = ", ".join(f"CAST({c} AS {cast}) AS {c}" for c in cols)
    return f"(UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} INTO NAME col VALUE v)"


def ks_sql(real: str, synth: str, cols: list[str], raw: bool = False) -> str:
    extra = ", 1.0 - ks AS sim_raw" if raw else ""
    return f"""
WITH u AS (
  SELECT col, v, 1 AS a, 0 AS b FROM {unpivot_sql(real, cols)} WHERE NOT isnan(v)
  UNION ALL
  SELECT col, v, 0 AS a, 1 AS b FROM {unpivot_sql(synth, cols)} WHERE NOT isnan(v)
), vc AS (
  SELECT col, v, sum(a) AS c1, sum(b) AS c2 FROM u GROUP BY col, v
), cum AS (
  SELECT col, v,
         CAST(sum(c1) OVER (PARTITION BY col ORDER BY v) AS DOUBLE) AS cc1,
         CAST(sum(c2) OVER (PARTITION BY col ORDER BY v) AS DOUBLE) AS cc2,
         CAST(sum(c1) OVER (PARTITION BY col) AS DOUBLE) AS n1,
         CAST(sum(c2) OVER (PARTITION BY col) AS DOUBLE) AS n2
  FROM vc
), d AS (
  SELECT col, n1, n2, max(abs(cc1 / n1 - cc2 / n2)) AS ks
  FROM cum WHERE n1 > 0 AND n2 > 0 GROUP BY col, n1, n2
), l AS (
  SELECT col, ks, ks * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM d
)
SELECT col AS {q('column')}, round(ks, 6) AS ks_statistic,
       round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum(list_transform(
           range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)))))
       END, 6) AS p_value,
       round(1.0 - ks, 6) AS similarity_score{extra}
FROM l"""


def stats_sql(real: str, synth: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS {q('column')}, round(r.m, 6) AS real_mean, round(s.m, 6) AS synth_mean,
  round(r.sd, 6) AS real_std, round(s.sd, 6) AS synth_std, round(abs(r.m - s.m), 6) AS mean_abs_diff,
  round(abs(r.sd - s.sd), 6) AS std_abs_diff
FROM (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS sd, count({c}) AS n FROM {real}) r,
     (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS sd, count({c}) AS n FROM {synth}) s
WHERE r.n > 0 AND s.n > 0""")
    return union_all(parts)


def corr_diff_sql(real: str, synth: str, cols: list[str]) -> str:
    return f"""(SELECT avg(abs(coalesce(a.r, 0.0) - coalesce(b.r, 0.0))) AS d
FROM ({corr_sql(real, cols)}) a FULL OUTER JOIN ({corr_sql(synth, cols)}) b
ON a.col_a = b.col_a AND a.col_b = b.col_b)"""


def bytes_sql(src: str, fixed: dict[str, int], text: list[str]) -> str:
    terms = [f"sum(CASE WHEN {c} IS NULL THEN 0 ELSE {w} END)" for c, w in fixed.items()]
    terms += [f"sum(coalesce(strlen({c}), 0))" for c in text]
    return f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST({' + '.join(terms)} AS BIGINT) AS bytes FROM {src}"


LINE_FIXED = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
              "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8}
LINE_TEXT = ["l_returnflag", "l_linestatus"]


def hist_sql(both: str, bins: int = 50, side: bool = True) -> str:
    """``both`` has columns (side, x); shared min/max; maximum in the last bin."""
    s_sel = "side, " if side else ""
    return f"""WITH b AS (SELECT * FROM {both} WHERE x IS NOT NULL),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM b),
k AS (SELECT {s_sel}CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) END AS bin
      FROM b, mm)
SELECT {s_sel}bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_start,
       round(CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {bins}) END, 6) AS bin_end,
       CAST(count(*) AS BIGINT) AS count
FROM k, mm GROUP BY {s_sel}bin, lo, hi"""


# ---- profiles ---------------------------------------------------------------------------

def _profile_sql(src: str, cols: list[str], num: list[str], cat: list[str], dts: list[str]) -> str:
    filled = " + ".join(f"count({c})" for c in cols)
    n = len(cols)
    return f"""SELECT CAST(count(*) AS BIGINT) AS rows, {n} AS columns, '{",".join(num)}' AS numerical_columns,
 '{",".join(cat)}' AS categorical_columns, '{",".join(dts)}' AS datetime_columns,
 {len(num)} AS n_numerical, {len(cat)} AS n_categorical, {len(dts)} AS n_datetime,
 CAST(count(*) * {n} - ({filled}) AS BIGINT) AS missing_cells,
 round(CASE WHEN count(*) > 0 THEN CAST(count(*) * {n} - ({filled}) AS DOUBLE) / (count(*) * {n}) * 100.0 ELSE 0.0 END, 6) AS missing_percent
FROM {src}"""


@register("profile", _profile_sql(DL, DL_COLS, ["doc_id", "n_chars", "quality", "toxic"], ["text", "lang", "source"], []))
def q_profile(spark, sf):
    return R6(P.profile_frame(docs_labels(spark, sf)))


def _summary_sql(src: str, num: list[str], dts: list[str], cat: list[str]) -> str:
    parts = []
    for c in num + dts:
        x = f"(CAST(epoch_us({c}) AS DOUBLE) / 1000000.0)" if c in dts else f"CAST({c} AS DOUBLE)"
        std = "CAST(NULL AS DOUBLE)" if c in dts else f"round(stddev_samp({x}), 6)"
        parts.append(
            f"SELECT '{c}' AS {q('column')}, CAST(count({x}) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS {q('unique')},"
            f" CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, {std} AS std,"
            f" round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25,"
            f" round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75,"
            f" round(max({x}), 6) AS max FROM {src}"
        )
    for c in cat:
        parts.append(
            f"SELECT '{c}' AS {q('column')}, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS {q('unique')},"
            f" min(value) FILTER (WHERE cnt = mx) AS top, CAST(max(mx) AS BIGINT) AS freq,"
            + ", ".join(f" CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min", "p25", "p50", "p75", "max"))
            + f" FROM (SELECT value, cnt, max(cnt) OVER () AS mx FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt"
            f" FROM {src} WHERE {c} IS NOT NULL GROUP BY 1))"
        )
    return union_all(parts)


ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("summary_all", _summary_sql("orders", ORDERS_NUM, ["o_orderdate"], ["o_orderstatus", "o_orderpriority"]))
def q_summary_all(spark, sf):
    return R6(P.summary_statistics(table(spark, sf, "orders"), "all"))


@register("summary_numeric", _summary_sql("lineitem", LINE_NUM, [], []))
def q_summary_numeric(spark, sf):
    return R6(P.summary_statistics(table(spark, sf, "lineitem"), "number"))


@register("missing_table", union_all([
    f"SELECT '{c}' AS {q('column')}, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,"
    f" round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100.0, 6) AS missing_pct FROM {DL}"
    f" HAVING count(*) - count({c}) > 0" for c in DL_COLS
]))
def q_missing_table(spark, sf):
    return R6(P.missing_values_table(docs_labels(spark, sf)))


@register("class_distribution", f"""SELECT coalesce(CAST(toxic AS VARCHAR), 'nan') AS class, CAST(count(*) AS BIGINT) AS count,
 round(count(*) * 100.0 / (SELECT count(*) FROM {DL}), 6) AS pct FROM {DL} GROUP BY 1""")
def q_class_distribution(spark, sf):
    return R6(P.class_distribution(docs_labels(spark, sf), "toxic"))


@register("class_distribution_nonnull", f"""SELECT CAST(toxic AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count,
 round(count(*) * 100.0 / (SELECT count(toxic) FROM {DL}), 6) AS pct FROM {DL} WHERE toxic IS NOT NULL GROUP BY 1""")
def q_class_distribution_nonnull(spark, sf):
    return R6(P.class_distribution(docs_labels(spark, sf), "toxic", dropna=True))


@register("imbalance_ratio", f"""SELECT CAST(count(*) AS BIGINT) AS n_classes, CAST(min(c) AS BIGINT) AS minority,
 CAST(max(c) AS BIGINT) AS majority,
 round(CASE WHEN count(*) >= 2 AND max(c) > 0 THEN CAST(min(c) AS DOUBLE) / max(c) END, 6) AS imbalance_ratio
FROM (SELECT quality, count(*) AS c FROM {DL} GROUP BY quality)""")
def q_imbalance_ratio(spark, sf):
    return R6(P.imbalance_ratio_frame(docs_labels(spark, sf), "quality"))


@register("correlation_matrix", f"SELECT col_a, col_b, round(r, 6) AS r FROM ({corr_sql('lineitem', LINE_NUM)})")
def q_correlation_matrix(spark, sf):
    return R6(P.correlation_matrix(table(spark, sf, "lineitem")))


@register("duplicate_rows", f"""SELECT CAST(count(*) AS BIGINT) AS rows,
 CAST((SELECT count(*) FROM (SELECT DISTINCT lang, source, quality, toxic FROM {DL})) AS BIGINT) AS distinct_rows,
 CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, quality, toxic FROM {DL})) AS BIGINT) AS duplicate_rows
FROM {DL}""")
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(docs_labels(spark, sf).select("lang", "source", "quality", "toxic"))


@register("missing_cells", f"""SELECT CAST(count(*) AS BIGINT) AS rows, 7 AS columns,
 CAST(count(*) * 7 - ({' + '.join(f'count({c})' for c in DL_COLS)}) AS BIGINT) AS missing_cells,
 round(CAST(count(*) * 7 - ({' + '.join(f'count({c})' for c in DL_COLS)}) AS DOUBLE) / (count(*) * 7) * 100.0, 6) AS missing_pct
FROM {DL}""")
def q_missing_cells(spark, sf):
    return R6(P.missing_cells(docs_labels(spark, sf)))


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("distinct_counts", union_all([
    f"SELECT '{c}' AS {q('column')}, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM customer" for c in CUST
]))
def q_distinct_counts(spark, sf):
    return P.distinct_counts(table(spark, sf, "customer"))


@register("time_trend_mean", "SELECT ts, round(avg(value), 6) AS value FROM events WHERE ts IS NOT NULL GROUP BY ts")
def q_time_trend_mean(spark, sf):
    return R6(P.time_trend(table(spark, sf, "events"), "ts", "value"))


@register("time_trend_count", "SELECT o_orderdate, CAST(count(*) AS BIGINT) AS count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def q_time_trend_count(spark, sf):
    return P.time_trend(table(spark, sf, "orders"), "o_orderdate")


@register("table_bytes", bytes_sql("part", {"p_partkey": 8, "p_size": 4, "p_retailprice": 8}, ["p_name", "p_brand", "p_type"]))
def q_table_bytes(spark, sf):
    return P.table_bytes(table(spark, sf, "part"))


ORD_TXT = ("(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
           "o_orderpriority FROM orders)")


@register("metadata", f"""SELECT CAST(count(*) AS BIGINT) AS rows, 6 AS columns,
 CAST(count(*) * 6 - (count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority)) AS BIGINT) AS missing,
 round(CAST(count(*) * 6 - (count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority)) AS DOUBLE) / (count(*) * 6) * 100.0, 6) AS missing_percentage,
 'o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:string,o_orderpriority:string' AS types,
 'o_orderkey,o_custkey,o_totalprice' AS numerical_columns,
 CASE WHEN max(CASE WHEN try_strptime(o_orderdate, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 1 ELSE 0 END) = 1
      THEN 'o_orderstatus,o_orderpriority' ELSE 'o_orderstatus,o_orderdate,o_orderpriority' END AS categorical_columns,
 CASE WHEN max(CASE WHEN try_strptime(o_orderdate, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 1 ELSE 0 END) = 1
      THEN 'o_orderdate' ELSE '' END AS datetime_columns
FROM {ORD_TXT}""")
def q_metadata(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return R6(P.metadata_frame(o))


@register("select_numeric", f"SELECT doc_id, n_chars, quality, toxic FROM {DL}")
def q_select_numeric(spark, sf):
    from ..functions import typeclass as tc
    d = docs_labels(spark, sf)
    return d.select(*tc.numeric_columns(d))


@register("normalize_token", r"""SELECT p_partkey,
 regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '_', 'g'), '[^a-z0-9_.]', '', 'g') AS name_token,
 regexp_replace(regexp_replace(lower(trim(p_type)), '\s+', '_', 'g'), '[^a-z0-9_.]', '', 'g') AS type_token
FROM part""")
def q_normalize_token(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", normalize_token(F.col("p_name")).alias("name_token"),
                    normalize_token(F.col("p_type")).alias("type_token"))


# ---- evaluation ---------------------------------------------------------------------------

@register("compare_stats", stats_sql(REAL, SYNTH, LINE_NUM))
def q_compare_stats(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.compare_column_statistics(r, s))


@register("compare_column", union_all([
    f"""SELECT '{m}' AS metric, round(r.v, 6) AS real, round(s.v, 6) AS generated,
 round(CASE WHEN r.v IS NULL OR s.v IS NULL THEN 0.0 WHEN r.v = 0 THEN abs(r.v - s.v) * 100.0
       ELSE abs(r.v - s.v) / abs(r.v) * 100.0 END, 6) AS pct_error
FROM (SELECT {f}(l_extendedprice) AS v FROM {REAL}) r, (SELECT {f}(l_extendedprice) AS v FROM {SYNTH}) s"""
    for m, f in [("Mean", "avg"), ("Std Dev", "stddev_samp"), ("Min", "min"), ("Max", "max")]
]))
def q_compare_column(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.compare_column(r, s, "l_extendedprice"))


@register("ks_test", ks_sql(REAL, SYNTH, LINE_NUM))
def q_ks_test(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.ks_test_report(r, s))


@register("corr_difference", f"SELECT round(d, 6) AS correlation_difference FROM {corr_diff_sql(REAL, SYNTH, LINE_NUM)}")
def q_corr_difference(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.correlation_difference_frame(r, s))


@register("corr_similarity", f"SELECT round(greatest(0.0, 1.0 - d), 6) AS correlation_similarity_score FROM {corr_diff_sql(REAL, SYNTH, LINE_NUM)}")
def q_corr_similarity(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.correlation_similarity_frame(r, s))


def report_sql(real: str, synth: str, cols: list[str]) -> str:
    nulls6 = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("real_mean", "synth_mean", "real_std", "synth_std",
                                                                  "mean_abs_diff", "std_abs_diff"))
    nulls3 = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("ks_statistic", "p_value", "similarity_score"))
    ks = ks_sql(real, synth, cols, raw=True)
    return f"""WITH ks AS ({ks}), st AS ({stats_sql(real, synth, cols)})
SELECT 'real_rows' AS metric, CAST((SELECT count(*) FROM {real}) AS DOUBLE) AS value, 'summary' AS section,
  CAST(NULL AS VARCHAR) AS {q('column')}, {nulls6}, {nulls3}
UNION ALL SELECT 'generated_rows', CAST((SELECT count(*) FROM {synth}) AS DOUBLE), 'summary', NULL, {nulls6}, {nulls3}
UNION ALL SELECT 'correlation_similarity_score', (SELECT round(greatest(0.0, 1.0 - d), 6) FROM {corr_diff_sql(real, synth, cols)}),
  'summary', NULL, {nulls6}, {nulls3}
UNION ALL SELECT 'avg_ks_similarity', round((SELECT avg(sim_raw) FROM ks), 6), 'summary', NULL, {nulls6}, {nulls3}
UNION ALL SELECT NULL, NULL, 'column_statistics', {q('column')}, real_mean, synth_mean, real_std, synth_std, mean_abs_diff,
  std_abs_diff, {nulls3} FROM st
UNION ALL SELECT NULL, NULL, 'ks_test', {q('column')}, {nulls6}, ks_statistic, p_value, similarity_score FROM ks"""


@register("evaluation_report", report_sql(REAL, SYNTH, LINE_NUM))
def q_evaluation_report(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.build_evaluation_report(r, s))


@register("quality_insights", union_all([
    f"""SELECT '{n}' AS side, CAST(count(*) * 11 - ({' + '.join(f'count({c})' for c in LINE_ALL)}) AS BIGINT) AS missing_cells,
 CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicate_rows FROM {src}"""
    for n, src in [("real", REAL), ("generated", SYNTH)]
]))
def q_quality_insights(spark, sf):
    r, s = real_synth(spark, sf)
    return E.quality_insights(r, s)


@register("corr_side_by_side", union_all([
    f"SELECT side, col_a, col_b, round(r, 6) AS r FROM ({corr_sql(src, LINE_NUM, extra=f"'{n}' AS side, ")})"
    for n, src in [("real", REAL), ("generated", SYNTH)]
]))
def q_corr_side_by_side(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(E.correlation_side_by_side(r, s))


@register("overview", union_all([
    f"SELECT '{n}' AS side, rows, 11 AS columns, bytes, 8 AS numeric_columns, 2 AS text_columns FROM ({bytes_sql(src, LINE_FIXED, LINE_TEXT)})"
    for n, src in [("real", REAL), ("generated", SYNTH)]
]))
def q_overview(spark, sf):
    r, s = real_synth(spark, sf)
    return E.overview(r, s)


# ---- chart data -------------------------------------------------------------------------------

@register("missing_chart", union_all([
    f"SELECT '{c}' AS {q('column')}, CAST(count(*) - count({c}) AS BIGINT) AS missing_count FROM {DL} HAVING count(*) - count({c}) > 0"
    for c in DL_COLS
]))
def q_missing_chart(spark, sf):
    return V.missing_values_chart(docs_labels(spark, sf))


@register("missing_heatmap", f"""WITH h AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM {DL} ORDER BY doc_id LIMIT 300)
""" + union_all([f"SELECT row, '{c}' AS {q('column')}, CAST({c} IS NULL AS INTEGER) AS missing FROM h" for c in DL_COLS]))
def q_missing_heatmap(spark, sf):
    return V.missing_heatmap(docs_labels(spark, sf), ["doc_id"])


@register("distribution_comparison", hist_sql(
    f"(SELECT 'real' AS side, CAST(l_extendedprice AS DOUBLE) AS x FROM {REAL} UNION ALL "
    f"SELECT 'generated', CAST(l_extendedprice AS DOUBLE) FROM {SYNTH})"))
def q_distribution_comparison(spark, sf):
    r, s = real_synth(spark, sf)
    return R6(V.distribution_comparison(r, s, "l_extendedprice"))


@register("distribution_comparison_zero", hist_sql(
    f"(SELECT 'real' AS side, coalesce(CAST(nullif(l_discount, 0) AS DOUBLE), 0.0) AS x FROM {REAL} UNION ALL "
    f"SELECT 'generated', coalesce(CAST(nullif(l_discount, 0) AS DOUBLE), 0.0) FROM {SYNTH})"))
def q_distribution_comparison_zero(spark, sf):
    r, s = real_synth(spark, sf)
    nz = lambda df: df.withColumn("l_discount", F.expr("nullif(l_discount, 0)"))
    return R6(V.distribution_comparison(nz(r), nz(s), "l_discount", zero_missing=True))


@register("feature_histogram", hist_sql("(SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)", side=False))
def q_feature_histogram(spark, sf):
    return R6(V.feature_distribution(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("top_categories", """SELECT CAST(p_type AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count FROM part
WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 25""")
def q_top_categories(spark, sf):
    return V.feature_distribution(table(spark, sf, "part"), "p_type")


# ---- cleaning ------------------------------------------------------------------------------

from ..functions.columns import READER_NULL_TOKENS  # noqa: E402
from ..operators import clean as C  # noqa: E402
from ..operators import features as FT  # noqa: E402


def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as a messy export: text numbers with thousands commas and 'n/a', dates as
    text, missing-value tokens, a reader-generated blank header and an empty column."""
    o = table(spark, sf, "orders")
    pending = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return o.select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_custkey").alias("cust key"),
        F.col("o_orderstatus").alias("Status"),
        F.when(pending, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2)).alias("Total Price ($)"),
        F.col("o_orderdate").cast("string").alias("order date"),
        F.when(pending, F.lit(" None ")).otherwise(F.col("o_orderpriority")).alias("Priority"),
        F.col("o_custkey").alias("Unnamed: 6"),
        F.expr("nullif(o_orderstatus, o_orderstatus)").alias("empty col"),
    )


PENDING = "(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"
MODE_PRIORITY = (f"(SELECT o_orderpriority FROM orders WHERE NOT {PENDING} GROUP BY 1 "
                 "ORDER BY count(*) DESC, 1 LIMIT 1)")


@register("clean_table", f"""SELECT o_orderkey AS "Order_ID", o_custkey AS cust_key, o_orderstatus AS "Status",
 round(CASE WHEN {PENDING} THEN (SELECT median(o_totalprice) FROM orders WHERE NOT {PENDING})
       ELSE o_totalprice END, 6) AS "Total_Price",
 o_orderdate AS order_date,
 CASE WHEN {PENDING} THEN {MODE_PRIORITY} ELSE o_orderpriority END AS "Priority"
FROM orders""")
def q_clean_table(spark, sf):
    out, _ = C.clean_dataset(messy_orders(spark, sf))
    return R6(out)


@register("cleaning_report", f"""SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
 CAST(8 AS BIGINT) AS cols_before, CAST(6 AS BIGINT) AS cols_after, 'Unnamed: 6,empty col' AS dropped_columns,
 CAST(0 AS BIGINT) AS dropped_rows, 'Total_Price:numeric,order_date:datetime' AS converted_columns,
 CASE WHEN count(*) FILTER (WHERE {PENDING}) > 0 THEN 'Total_Price:median,Priority:mode' ELSE '' END AS imputed_columns,
 '' AS warnings
FROM orders""")
def q_cleaning_report(spark, sf):
    _, rep = C.clean_dataset(messy_orders(spark, sf))
    return rep.to_frame(spark)


@register("drop_null_rows", f"SELECT quality, toxic FROM {DL} WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def q_drop_null_rows(spark, sf):
    return C.drop_null_rows(docs_labels(spark, sf).select("quality", "toxic"))


@register("drop_null_columns", f"SELECT doc_id, lang FROM {DL} WHERE toxic IS NULL")
def q_drop_null_columns(spark, sf):
    d = docs_labels(spark, sf).where(F.col("toxic").isNull()).select("doc_id", "lang", "quality")
    return C.drop_null_columns(d)[0]


@register("drop_unnamed", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_unnamed(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_name", "Unnamed: 1")
    return C.drop_unnamed(c)[0]


@register("normalize_names", 'SELECT n_nationkey AS "N_Nation_Key", n_name AS n_name, n_regionkey AS n_name_1 FROM nation')
def q_normalize_names(spark, sf):
    n = table(spark, sf, "nation").toDF(" N  Nation Key ", "n-name (%)", "n name")
    return C.normalize_names(n, "clean")


@register("post_process", f'SELECT doc_id AS "Doc ID", source, n_chars AS "n chars" FROM {DL} WHERE toxic IS NULL')
def q_post_process(spark, sf):
    d = docs_labels(spark, sf).where(F.col("toxic").isNull()).select(
        F.col("doc_id").alias("  Doc   ID "), F.col("quality").alias("Quality"), F.col("lang").alias("Unnamed: 2"),
        F.col("source"), F.col("n_chars").alias("n  chars"))
    return C.post_process(d)


@register("inf_to_null", """SELECT l_orderkey, l_linenumber,
 round(CASE WHEN isinf(l_extendedprice * 1e305) THEN NULL ELSE l_extendedprice * 1e305 / 1e305 END, 6) AS big
FROM lineitem""")
def q_inf_to_null(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.lit(1e305)).alias("big"))
    out = C.inf_to_null(li)
    return R6(out.withColumn("big", F.col("big") / F.lit(1e305)))


NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _infer_sql(cols: dict[str, str]) -> str:
    parts = []
    for name, expr in cols.items():
        parts.append(f"""SELECT '{name}' AS {q('column')}, CASE WHEN count(v) = 0 THEN 'string'
 WHEN count(CASE WHEN lower(v) IN ('true', 'false') THEN 1 END) = count(v) THEN 'boolean'
 WHEN count(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 1 END) = count(v) THEN 'bigint'
 WHEN count(CASE WHEN regexp_matches(v, '{NUM_RE}') THEN 1 END) = count(v) THEN 'double'
 ELSE 'string' END AS inferred_type
FROM (SELECT CASE WHEN trim({expr}) IN {READER_NULL_TOKENS!r} THEN NULL ELSE trim({expr}) END AS v FROM lineitem)""")
    return union_all(parts)


INFER_COLS = {
    "l_orderkey": "CAST(l_orderkey AS VARCHAR)",
    "l_quantity": "CAST(l_quantity AS VARCHAR)",
    "l_returnflag": "l_returnflag",
    "big_qty": "CAST(l_quantity > 25 AS VARCHAR)",
    "gaps": "CASE l_returnflag WHEN 'A' THEN 'NA' WHEN 'R' THEN '#N/A' ELSE CAST(l_quantity AS VARCHAR) END",
}


@register("infer_types", _infer_sql(INFER_COLS))
def q_infer_types(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_quantity").cast("string").alias("l_quantity"),
        "l_returnflag", (F.col("l_quantity") > 25).cast("string").alias("big_qty"),
        F.when(F.col("l_returnflag") == "A", "NA").when(F.col("l_returnflag") == "R", "#N/A").otherwise(F.col("l_quantity").cast("string")).alias("gaps"))
    return C.infer_column_types(li)


@register("parse_datetime", "SELECT o_orderkey, o_orderdate FROM orders")
def q_parse_datetime(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    d = C.decide_text_types(o, ["o_orderdate"])[0]
    return o.select("o_orderkey", C.convert_expr(d))


@register("parse_numeric", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")
def q_parse_numeric(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.format_number("p_retailprice", 2).alias("p_retailprice"))
    d = C.decide_text_types(p, ["p_retailprice"])[0]
    return R6(p.select("p_partkey", C.convert_expr(d)))


@register("null_tokens", f"SELECT doc_id, CAST(toxic AS VARCHAR) AS toxic_text FROM {DL}")
def q_null_tokens(spark, sf):
    d = docs_labels(spark, sf).select(
        "doc_id", F.concat(F.lit(" "), F.coalesce(F.col("toxic").cast("string"), F.lit("None")), F.lit(" ")).alias("toxic_text"))
    d0 = C.decide_text_types(d, ["toxic_text"])[0]
    return d.select("doc_id", C.convert_expr(d0))


@register("impute_median", f"""SELECT doc_id,
 round(coalesce(CAST(quality AS DOUBLE), (SELECT coalesce(median(quality), 0) FROM {DL})), 6) AS quality,
 round(coalesce(CAST(toxic AS DOUBLE), (SELECT coalesce(median(toxic), 0) FROM {DL})), 6) AS toxic
FROM {DL}""")
def q_impute_median(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", "quality", "toxic")
    return R6(C.impute_median(d, ["quality", "toxic"])[0])


@register("impute_mode", f"""SELECT doc_id, coalesce(CAST(toxic AS VARCHAR),
 (SELECT CAST(toxic AS VARCHAR) FROM {DL} WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS toxic_text
FROM {DL}""")
def q_impute_mode(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", F.col("toxic").cast("string").alias("toxic_text"))
    return C.impute_mode(d, ["toxic_text"])[0]


@register("impute_mode_ts", """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END,
 (SELECT o_orderdate FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS open_date
FROM orders""")
def q_impute_mode_ts(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_orderdate")).alias("open_date"))
    return C.impute_mode(o, ["open_date"])[0]


@register("reduce_features", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_reduce_features(spark, sf):
    return FT.reduce_features(table(spark, sf, "customer"))[0]


@register("reinject_columns", "SELECT c_custkey, 'NA' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_reinject_columns(spark, sf):
    c = table(spark, sf, "customer")
    reduced, dropped = FT.reduce_features(c)
    return FT.reinject_columns(reduced, c, dropped)


# ---- sampling ------------------------------------------------------------------------------

from ..operators import sample as S  # noqa: E402

ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORD_SEL = ", ".join(ORD_COLS)


def hash_sql(stream: str, expr: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:{stream}:' || CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


def uniform_sql(stream: str, expr: str, seed: int = 42) -> str:
    """The 52-bit draw of ``functions.columns.uniform``."""
    digits = f"substr(md5('{seed}:{stream}:' || CAST({expr} AS VARCHAR)), 1, 13)"
    return f"((CAST(CAST(('0x' || {digits}) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def quarter(df: DataFrame) -> int:
    return df.count() // 4


@register("sample_random", f"""SELECT {ORD_SEL} FROM orders
QUALIFY row_number() OVER (ORDER BY {hash_sql('sample', 'o_orderkey')}, o_orderkey) <= (SELECT count(*) // 4 FROM orders)""")
def q_sample_random(spark, sf):
    o = table(spark, sf, "orders")
    return S.sample_random(o, quarter(o), ["o_orderkey"])


STRAT_SQL = f"""WITH c AS (SELECT o_orderpriority AS class, count(*) AS _c FROM orders GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) // 4 AS n FROM orders),
q0 AS (SELECT class, _c, n, floor(_c * n / total) AS base, _c * n / total - floor(_c * n / total) AS rem FROM c, t),
q AS (SELECT class, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, class ASC NULLS FIRST)
                                   <= max(n) OVER () - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql('sample', 'o_orderkey')}, o_orderkey) - 1 AS p
      FROM orders)
SELECT {', '.join('r.' + c for c in ORD_COLS)} FROM r JOIN q ON r.o_orderpriority = q.class WHERE r.p < q.quota"""


@register("sample_stratified", STRAT_SQL)
def q_sample_stratified(spark, sf):
    o = table(spark, sf, "orders")
    return S.sample_stratified(o, quarter(o), "o_orderpriority", ["o_orderkey"])


@register("sample_recent", f"""SELECT {ORD_SEL} FROM orders
QUALIFY row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) <= (SELECT count(*) // 4 FROM orders)""")
def q_sample_recent(spark, sf):
    o = table(spark, sf, "orders")
    return S.sample_recent(o, quarter(o), "o_orderdate", ["o_orderkey"])


@register("bootstrap", f"""WITH t AS (SELECT count(*) AS total FROM orders),
idx AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('boot-order', 'o_orderkey')}, o_orderkey) - 1 AS _idx FROM orders),
d AS (SELECT CAST(floor({uniform_sql('boot', 'r.range')} * t.total) AS BIGINT) AS _idx
      FROM t, range(t.total) r)
SELECT {', '.join('idx.' + c for c in ORD_COLS)} FROM d JOIN idx ON d._idx = idx._idx""")
def q_bootstrap(spark, sf):
    o = table(spark, sf, "orders")
    return S.bootstrap(o, o.count(), ["o_orderkey"])


@register("sample_report", """SELECT CAST(count(*) AS BIGINT) AS orig_rows, CAST(count(*) // 4 AS BIGINT) AS reduced_rows,
 6 AS orig_columns, 6 AS reduced_columns, CAST(0.0 AS DOUBLE) AS orig_missing_pct, CAST(0.0 AS DOUBLE) AS reduced_missing_pct,
 round(CAST(count(*) // 4 AS DOUBLE) / count(*) * 100.0, 6) AS pct_kept, (count(*) // 4) < 100 AS small_warning
FROM orders""")
def q_sample_report(spark, sf):
    o = table(spark, sf, "orders")
    red = S.sample_stratified(o, quarter(o), "o_orderpriority", ["o_orderkey"])
    return R6(S.sample_report(o, red))


# ---- recommendation ------------------------------------------------------------------------

from ..operators import recommend as M  # noqa: E402


@register("recommend_model", f"""WITH c AS (SELECT quality, count(*) AS n FROM {DL} GROUP BY quality),
r AS (SELECT CASE WHEN count(*) >= 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END AS ratio FROM c),
s AS (SELECT count(*) AS rows FROM {DL})
SELECT CASE WHEN rows = 0 THEN 'GaussianCopula' WHEN ratio < 0.35 THEN 'SMOTE' ELSE 'CTGAN' END AS model,
 CASE WHEN rows = 0 THEN 'Empty input: falling back to the Gaussian copula.'
      WHEN ratio < 0.35 THEN 'Class imbalance ratio ' || printf('%.2f', ratio) || ' on ''quality'': oversampling with SMOTE.'
      ELSE 'Many categorical columns: CTGAN.' END AS reason,
 round(ratio, 6) AS imbalance_ratio, CAST(NULL AS VARCHAR) AS detected_time_column
FROM r, s""")
def q_recommend_model(spark, sf):
    return R6(M.recommend_frame(docs_labels(spark, sf), target="quality"))


@register("recommend_model_v2", f"""WITH c AS (SELECT toxic, count(*) AS n FROM {DL} WHERE toxic IS NOT NULL GROUP BY toxic),
r AS (SELECT CASE WHEN count(*) = 2 AND max(n) > 0 THEN CAST(min(n) AS DOUBLE) / max(n) END AS ratio FROM c)
SELECT CASE WHEN ratio < 0.3 THEN 'SMOTE' ELSE 'GaussianCopulaSynthesizer' END AS model,
 CASE WHEN ratio < 0.3 THEN 'Binary imbalance ratio ' || printf('%.2f', ratio) || ': SMOTE.'
      ELSE 'Small table: Gaussian copula.' END AS reason
FROM r""")
def q_recommend_model_v2(spark, sf):
    return M.recommend_frame_v2(docs_labels(spark, sf), target="toxic")


@register("infer_time_column", f"""SELECT CASE WHEN avg(CASE WHEN try_strptime(o_orderdate, '%Y-%m-%d %H:%M:%S') IS NOT NULL
 THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'o_orderdate' END AS detected_time_column FROM {ORD_TXT}""")
def q_infer_time_column(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return M.infer_time_frame(o)


# ---- generation ------------------------------------------------------------------------------

from ..operators.generate import copula as G1  # noqa: E402
from ..operators.generate.fallback import generate_with_fallback  # noqa: E402

KNOT_COLS = ["l_extendedprice", "l_orderkey", "l_partkey"]
PROBS_SQL = "[" + ", ".join(repr(k / 100) for k in range(101)) + "]"


@register("copula_marginals", union_all([
    f"""SELECT '{c}' AS {q('column')}, CAST(g.k AS INTEGER) AS k, round(t.q[g.k + 1], 6) AS value
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), {PROBS_SQL}) AS q FROM lineitem) t, range(0, 101) g(k)"""
    for c in KNOT_COLS
]))
def q_copula_marginals(spark, sf):
    return R6(G1.marginal_knots(table(spark, sf, "lineitem"), KNOT_COLS, 100))


@register("copula_sample")
def q_copula_sample(spark, sf):
    o = table(spark, sf, "orders")
    return G1.generate_gaussian_copula(o, o.count())


CUST_RED = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUST_KEY = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in CUST_RED)


@register("generate_fallback", f"""WITH base AS (SELECT {', '.join(CUST_RED)} FROM customer),
t AS (SELECT count(*) AS total FROM base),
idx AS (SELECT *, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('42:boot-order:' || {CUST_KEY}), 1, 8)) AS BIGINT),
        {', '.join(CUST_RED)}) - 1 AS _idx FROM base),
d AS (SELECT CAST(floor({uniform_sql('boot', 'r.range')} * t.total) AS BIGINT) AS _idx
      FROM t, range(t.total) r)
SELECT idx.c_custkey, 'NA' AS c_name, idx.c_nationkey, idx.c_acctbal, idx.c_mktsegment FROM d JOIN idx ON d._idx = idx._idx""")
def q_generate_fallback(spark, sf):
    c = table(spark, sf, "customer")
    return generate_with_fallback(c, "BOOTSTRAP", c.count()).rows


@register("full_pipeline")
def q_full_pipeline(spark, sf):
    from .pipeline import run_full_pipeline
    return R6(run_full_pipeline(spark, f"{sf.rstrip('/')}/orders.parquet").tables["evaluation"])


# ---- sources ---------------------------------------------------------------------------------

from ..session import scratch_path  # noqa: E402
from ..sources import csv as SC  # noqa: E402
from ..sources import load as LD  # noqa: E402
from ..sources import sinks as SK  # noqa: E402


CSV_SHAPES = (  # separator, lines above the header, columns of a file
    (",", ["Order export", ""], ["ID", "customer", "status", "price", "date", "priority"]),
    (";", [";;;;;", "made by hand;;;;;", ";;"], ["date", "ID", "price", "customer", "priority", "status"]),
    ("|", [], ["priority", "status", "ID", "date", "customer", "price"]),
    ("\t", ["no note here"], ["ID", "price", "priority", "customer", "date", "status"]))


def messy_orders_csv(spark: SparkSession, sf: str, files: int = 8) -> str:
    """``orders`` as several files, written by their tasks: each with its own separator, lines
    above the header and column order; the priority is quoted and holds a line break, a doubled
    quote and every separator."""
    path = scratch_path(spark, "orders-csv")

    def lines(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        sep, junk, names = shapes[TaskContext.get().partitionId() % len(shapes)]
        yield pa.RecordBatch.from_arrays([pa.array([*junk, sep.join(names)])], names=["value"])
        for batch in batches:
            cells = [batch.column(n).cast(pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*cells, pa.scalar(sep, pa.string()))], names=["value"])

    shapes = CSV_SHAPES
    o = table(spark, sf, "orders")
    text = o.select(F.col("o_orderkey").cast("string").alias("ID"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
                    F.concat(F.lit('"'), "o_orderpriority", F.lit('\n\nsaid ""now"", ; | \t."')).alias("priority"))
    text.repartition(files, "ID").mapInArrow(lines, "value string").write.text(path)
    return path


ORDERS_TEXT = """CAST(o_orderkey AS BIGINT) AS "ID", CAST(o_custkey AS BIGINT) AS customer, o_orderstatus AS status,
 round(o_totalprice, 2) AS price, strftime(o_orderdate, '%Y-%m-%d') AS date,
 o_orderpriority || chr(10) || chr(10) || 'said "now", ; | ' || chr(9) || '.' AS priority"""


@register("csv_scan", f"SELECT {ORDERS_TEXT} FROM orders")
def q_csv_scan(spark, sf):
    df = LD.load_dataset(spark, messy_orders_csv(spark, sf), fmt="csv")[0]
    return df.withColumn("price", F.round("price", 2))


FILE_SHAPES = " UNION ALL ".join(
    f"SELECT {'chr(9)' if sep == chr(9) else repr(sep)} AS delimiter, {sum(bool(x.strip()) for x in junk)} AS header_row, '{'+'.join(names)}' AS names, CAST(2 AS BIGINT) AS files"
    for sep, junk, names in CSV_SHAPES)


@register("header_detect", f"SELECT header_row, delimiter, files FROM ({FILE_SHAPES})")
def q_header_detect(spark, sf):
    """Header row and separator of each file, and how many files have them."""
    heads = SC.scan_files(spark, messy_orders_csv(spark, sf)).heads
    return heads.groupBy(F.col("header").alias("header_row"), "delimiter").agg(F.count(F.lit(1)).alias("files"))


@register("csv_delimiter", f"SELECT delimiter, files FROM ({FILE_SHAPES})")
def q_csv_delimiter(spark, sf):
    lines = SC.physical_lines(spark, messy_orders_csv(spark, sf))
    found = SC.detect_delimiters(SC.numbered(lines).where(F.col("rec") < SC.HEADER_SCAN))
    return found.groupBy("delimiter").agg(F.count(F.lit(1)).alias("files"))


@register("ingest_diagnostics", f"SELECT delimiter, header_row, names, files, (SELECT count(*) FROM orders) AS data_rows FROM ({FILE_SHAPES})")
def q_ingest_diagnostics(spark, sf):
    """What the load found out about its files, and the rows that it returned."""
    df, diag = LD.load_dataset(spark, messy_orders_csv(spark, sf), fmt="csv")
    found = diag.files.groupBy("delimiter", F.col("header").alias("header_row"), F.array_join("cells", "+").alias("names")).agg(F.count(F.lit(1)).alias("files"))
    return found.crossJoin(df.agg(F.count(F.lit(1)).alias("data_rows")))


@register("row_ffill", f"""SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), lang) AS quality,
 coalesce(CAST(toxic AS VARCHAR), CAST(quality AS VARCHAR), lang) AS toxic FROM {DL}""")
def q_row_ffill(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", "lang", F.col("quality").cast("string").alias("quality"),
                                      F.col("toxic").cast("string").alias("toxic"))
    return SC.row_ffill(d, ["lang", "quality", "toxic"])


@register("load_parquet", "SELECT * FROM lineitem")
def q_load_parquet(spark, sf):
    return LD.load(spark, f"{sf.rstrip('/')}/lineitem.parquet")


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, sf):
    return LD.preview(table(spark, sf, "orders"), ["o_orderkey"], 10)


@register("csv_sink", """SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
 round(p_retailprice, 6) AS p_retailprice FROM part""")
def q_csv_sink(spark, sf):
    path = scratch_path(spark, "part-csv")
    SK.write_csv(table(spark, sf, "part"), path)
    return R6(LD.load(spark, path, fmt="csv"))


# ---- SMOTE, label encoding, sequences ---------------------------------------------------------

from ..operators.generate import sequence as G4  # noqa: E402
from ..operators.generate import smote as G2  # noqa: E402

EMB_DIM = 64


def embedding_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf, "embeddings")
    feats = [f"e{i}" for i in range(EMB_DIM)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)]), feats


@register("label_encode", "SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type_code FROM part")
def q_label_encode(spark, sf):
    return G2.label_encode(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@register("smote_neighbors", """WITH p AS (
  SELECT a.vec_id, b.vec_id AS nn,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
             lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS d2
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, nn AS nn_vec_id, CAST(rn AS INTEGER) AS nn_rank
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nn) AS rn FROM p) WHERE rn <= 5""")
def q_smote_neighbors(spark, sf):
    e, feats = embedding_features(spark, sf)
    nn = G2.knn_within_class(e, "vec_id", "label", feats, 5)
    return nn.select("vec_id", F.col("nn_key").alias("nn_vec_id"), "nn_rank")


@register("smote_balance", """SELECT CAST(label AS VARCHAR) AS class,
 (SELECT max(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) AS rows
FROM embeddings GROUP BY label""")
def q_smote_balance(spark, sf):
    e, feats = embedding_features(spark, sf)
    bal, _, _ = G2.smote_balance(e.drop("vec_id"), "label")
    return bal.groupBy(F.col("_y").alias("class")).agg(F.count(F.lit(1)).alias("rows"))


@register("smote_generate")
def q_smote_generate(spark, sf):
    d = docs_labels(spark, sf).select("lang", "source", "n_chars", "quality")
    return G2.generate_smote(d, "quality", d.count())


@register("sequence_bootstrap", f"""WITH r AS (SELECT *, epoch_us(ts) AS t, row_number() OVER w - 1 AS p,
        coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS gap
      FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS si, count(*) OVER () AS k
      FROM (SELECT coalesce('k' || CAST(user_id AS VARCHAR), '') AS name, user_id, count(*) AS len, min(t) AS t0, arg_min(props, p) AS first_props
            FROM r GROUP BY ALL)),
n AS (SELECT count(*) AS n FROM events),
g AS (SELECT range AS g, CAST(floor({uniform_sql('seq-src', 'range')} * (SELECT max(k) FROM s)) AS BIGINT) AS si
      FROM range((SELECT n FROM n))),
o AS (SELECT g.g, s.*, sum(len) OVER (ORDER BY g.g) - len AS begun FROM g JOIN s ON g.si = s.si),
j AS (SELECT o.*, unnest(range(CAST(least(len, n.n - begun) AS BIGINT))) AS j FROM o, n WHERE begun < n.n),
b AS (SELECT *, least(CAST(floor({uniform_sql('seq-block', "CAST(g AS VARCHAR) || ':' || CAST(j // 8 AS VARCHAR)")} * (len - least(8, len) + 1)) AS BIGINT)
      + j % 8, len - 1) AS p FROM j)
SELECT r.event_id, make_timestamp(CAST(b.t0 + sum(CASE WHEN b.j = 0 THEN 0 ELSE r.gap END) OVER (PARTITION BY b.g ORDER BY b.j) AS BIGINT)) AS ts,
       b.g AS user_id, r.event_type, r.value, b.first_props AS props
FROM b JOIN r ON r.user_id IS NOT DISTINCT FROM b.user_id AND r.p = b.p""")
def q_sequence_bootstrap(spark, sf):
    ev = table(spark, sf, "events")
    return G4.generate_sequences(ev, ev.count(), "ts", sequence_key="user_id", context_columns=["props"])


# ---- workbooks ---------------------------------------------------------------------------------

def _xlsx_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """Minimal workbook with inline strings; a datetime becomes a number in a date style."""
    import datetime
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def col(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    def sheet(rows) -> str:
        body = []
        for r, row in enumerate(rows, start=1):
            cells = []
            for c, v in enumerate(row):
                ref = f"{col(c)}{r}"
                if v is None or v == "":
                    continue
                if isinstance(v, datetime.datetime):
                    cells.append(f'<c r="{ref}" s="1"><v>{(v - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>')
                elif isinstance(v, (int, float)) and not isinstance(v, bool):
                    cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                else:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{m}"><sheetData>{"".join(body)}</sheetData></worksheet>'

    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    n = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": head + f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets>'
        + "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        "xl/styles.xml": head + f'<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{i}.xml": sheet(rows) for i, rows in zip(n, sheets.values())},
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


WORKBOOK_ROWS = 40_000  # about as many rows a workbook; a sheet can hold 1,048,576


def orders_workbooks(spark: SparkSession, sf: str, files: int | None = None) -> str:
    """``orders`` as workbooks written by tasks, four or as many as its rows need: a title row and an empty row above the header
    of sheet "Orders" (columns in another order in every other workbook), and a second sheet
    "Days" with key and date."""
    folder = scratch_path(spark, "orders-xlsx")
    make, names = _xlsx_bytes, ["ID", "status", "price", "date", "priority"]

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        order = names if k % 2 == 0 else names[::-1]
        rows = [r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in order))]
        days = [(r[order.index("ID")], r[order.index("date")]) for r in rows]
        book = make({"Orders": [["Order list"], [], order, *rows], "Days": [["ID", "date"], *days]})
        store, path = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if not folder.startswith("file://") and folder.startswith("file:/") else folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/orders-{k}.xlsx") as f:
            f.write(book)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], names=["n"])

    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"),
        F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"))
    files = files or max(4, math.ceil(o.count() / WORKBOOK_ROWS))
    o.repartition(files, "ID").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return folder


@register("xlsx_scan", """SELECT CAST(o_orderkey AS BIGINT) AS "ID", o_orderstatus AS status, round(o_totalprice, 2) AS price,
 CAST(o_orderdate AS TIMESTAMP) AS date, o_orderpriority AS priority FROM orders""")
def q_xlsx_scan(spark, sf):
    """The first sheet of every workbook, found by place, columns aligned by name."""
    return LD.load_dataset(spark, orders_workbooks(spark, sf), fmt="excel")[0].select("ID", "status", F.round("price", 2).alias("price"), "date", "priority")


@register("xlsx_sheet", 'SELECT CAST(o_orderkey AS BIGINT) AS "ID", CAST(o_orderdate AS TIMESTAMP) AS date FROM orders')
def q_xlsx_sheet(spark, sf):
    """A sheet by its name."""
    return LD.load_dataset(spark, orders_workbooks(spark, sf), fmt="excel", sheet="Days")[0]


# ---- further profile and sink operators ------------------------------------------------------

@register("value_counts", "SELECT o_orderpriority AS value, count(*) AS \"count\" FROM orders GROUP BY 1")
def q_value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@register("column_type_counts", """SELECT CASE WHEN data_type IN ('VARCHAR') THEN 'categorical' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'numeric' END AS type_class,
 CAST(count(*) AS BIGINT) AS n_columns FROM (SELECT unnest(['BIGINT', 'BIGINT', 'VARCHAR', 'DOUBLE', 'TIMESTAMP', 'VARCHAR']) AS data_type FROM (SELECT count(*) FROM orders)) GROUP BY 1""")
def q_column_type_counts(spark, sf):
    return P.column_type_counts(table(spark, sf, "orders"))


@register("report_csv_sink", """SELECT 'o_totalprice' AS "column", round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS real_mean,
 round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 6) AS synth_mean FROM orders""")
def q_report_csv_sink(spark, sf):
    """A report written as CSV and read again."""
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderstatus")
    path = scratch_path(spark, "report-csv")
    SK.write_report_csv(E.compare_column_statistics(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")), path)
    return R6(LD.load(spark, path, fmt="csv").select("column", "real_mean", "synth_mean"))


# ---- set operations --------------------------------------------------------------------------

from ..functions.names import common_columns  # noqa: E402


@register("common_columns", "SELECT " + ", ".join(c for c in LINE_ALL if c != "l_tax") + f" FROM {REAL}")
def q_common_columns(spark, sf):
    """The real table on the columns the generated table also has (order of the real)."""
    real, synth = real_synth(spark, sf)
    synth = synth.drop("l_tax")
    return real.select(*common_columns(real.columns, synth.columns))
