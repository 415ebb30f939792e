"""Seeded, exact-size sampling.

Every draw is a hash of (seed, stream, key), so the same rows come back under any
partitioning and after any task retry.  Exact "n smallest hashes" selections first keep
only candidate rows below a hash threshold chosen from the counts (one cheap filter pass),
then rank the candidates -- the shuffle carries about n rows, not the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import typeclass as tc
from ..functions.columns import TWO_POW_32, hash_u32, named, uniform
from ..plans import kernels as K
from . import profile as P

SEED = 42
SMALL_WARNING_ROWS = 100


def _keys(df: DataFrame, key_cols: list[str] | None) -> list[str]:
    return list(key_cols) if key_cols else list(df.columns)


def sample_hash(df: DataFrame, key_cols: list[str] | None = None, seed: int = SEED, stream: str = "sample") -> Column:
    return hash_u32(seed, stream, *_keys(df, key_cols))


def _smallest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Exactly the ``n`` first rows of ``order`` (a unique order), ranked by the range-split
    position kernel at every size."""
    pos = K.positions(df, [], order, name="_p", n_ranges=K.partitions(df.sparkSession, n))
    return pos.where(F.col("_p") < n).drop("_p")


def sample_random(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows without replacement -- the n smallest seeded hashes of
    the key (key as tie-break).  ``key_cols=None`` hashes every column (equal rows are
    interchangeable, so the multiset is still exact)."""
    keys = _keys(df, key_cols)
    h = sample_hash(df, keys, seed)
    total = df.count()
    if n >= total:
        return df
    frac = min(1.0, n / total * 1.05 + 32.0 / total)
    thr = math.ceil(frac * TWO_POW_32)
    withh = df.withColumn("_h", h)
    cand = withh.where(F.col("_h") < F.lit(thr))
    if frac < 1.0 and cand.count() < n:
        cand = withh
    out = _smallest(cand, n, [F.col("_h"), *[named(k) for k in keys]])
    return out.drop("_h")


def largest_remainder_quotas(counts: DataFrame, n: int, total: int, cls: str = "class") -> DataFrame:
    """(class, quota): n * N_c / N rounded down, the remaining units to the largest
    fractional parts (class ascending on ties).  One row per class."""
    exact = F.col("_c") * F.lit(n) / F.lit(total)
    q = counts.select(F.col(cls), F.col("_c"), F.floor(exact).cast("long").alias("_base"),
                      (exact - F.floor(exact)).alias("_rem"))
    left = q.select(F.lit(n) - F.sum("_base")).scalar()
    ranked = K.positions(q, [], [F.desc("_rem"), F.col(cls).asc_nulls_first()], name="_rank")
    return ranked.select(
        F.col(cls), F.col("_c"),
        (F.col("_base") + F.when(F.col("_rank") < left, 1).otherwise(0)).alias("_quota"),
    )


def sample_stratified(df: DataFrame, n: int, target: str, key_cols: list[str] | None = None,
                      seed: int = SEED) -> DataFrame:
    """R2: exactly n rows with class shares kept (largest-remainder quotas); all rows if
    n >= rows; falls back to :func:`sample_random` when a class has one row or n is below
    the number of classes.  Inside a class the smallest seeded hashes win; candidates are
    pre-filtered per class so only about n rows are ranked."""
    keys = _keys(df, key_cols)
    total = df.count()
    if n >= total:
        return df
    counts = df.groupBy(named(target).alias("_class")).agg(F.count(F.lit(1)).alias("_c"))
    stats = counts.agg(F.count(F.lit(1)).alias("k"), F.min("_c").alias("m")).first()
    if stats["m"] < 2 or n < stats["k"]:
        return sample_random(df, n, keys, seed)
    quotas = largest_remainder_quotas(counts, n, total, "_class")
    thr = F.least(F.lit(TWO_POW_32), F.ceil((F.col("_quota") / F.col("_c") * 1.05 + 32.0 / F.col("_c")) * TWO_POW_32))
    quotas = quotas.withColumn("_thr", thr)
    withh = df.withColumn("_h", sample_hash(df, keys, seed))
    joined = withh.join(quotas, named(target).eqNullSafe(F.col("_class")))  # one row per class
    cand = joined.where(F.col("_h") < F.col("_thr"))
    short = cand.groupBy("_class", "_quota").agg(F.count(F.lit(1)).alias("_got")).where(F.col("_got") < F.col("_quota"))
    if not short.isEmpty():
        cand = joined
    ranked = K.positions(cand, ["_class"], [F.col("_h"), *[named(k) for k in keys]], name="_p")
    return ranked.where(F.col("_p") < F.col("_quota")).select(*[named(c) for c in df.columns])


def _time_number(df: DataFrame, time_col: str) -> Column | None:
    """Date/time as epoch seconds, a number as it is; None for other types."""
    kind = tc.field_type(df, time_col)
    if tc.is_datetime(kind):
        return P.dt_seconds(df, time_col)
    return K.finite(named(time_col).cast("double")) if tc.is_numeric(kind) else None


def sample_recent(df: DataFrame, n: int, time_col: str, key_cols: list[str] | None = None) -> DataFrame:
    """R3/T4s: the last n rows after sorting by time with missing times last -- i.e. rows
    without a time first, then the latest; key descending breaks ties.

    Counts find a time that about n rows reach (K2); only those rows, and rows without a time,
    are ranked and shuffled."""
    keys = _keys(df, key_cols)
    order = [named(time_col).desc_nulls_first(), *[named(k).desc() for k in keys if k != time_col]]
    number = _time_number(df, time_col)
    if number is not None and n > 0:
        timed = df.select(number.alias("_t"))
        total, known = timed.agg(F.count(F.lit(1)), F.count("_t")).first()
        wanted = n - (total - known)  # rows with a time that are needed
        if wanted <= 0:
            df = df.where(number.isNull())
        elif wanted + 2 < known:
            # two ranks lower than needed: the share is rounded, and more candidates do no harm
            least = K.exact_quantiles(timed, ["_t"], [(known - wanted - 2) / (known - 1)]).first()["value"]
            df = df.where(number.isNull() | (number >= F.lit(math.nextafter(least, -math.inf))))
    return _smallest(df, n, order)


BUCKET_ROWS = 50_000


def _indexed(df: DataFrame, total: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with (_bucket, _rank) and the buckets (_bucket, _from, _to), so that _from + _rank
    is the place of a row in the order of ``_h`` and then ``order``.

    A bucket is a range of the 32-bit hash ``_h`` with about ``BUCKET_ROWS`` rows: counts, not
    a sort of the table, give the places of buckets.  Rows are ranked inside their bucket; a
    bucket that repeated keys make much larger goes through the range-split kernel."""
    buckets = max(1, total // BUCKET_ROWS)
    rows = df.withColumn("_bucket", F.floor(F.col("_h") * F.lit(buckets) / F.lit(TWO_POW_32)).cast("long"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    places = K.prefix_sums(sizes, [], ["_bucket"], ["_n"]).select("_bucket", (F.col("cum__n") - F.col("_n")).alias("_from"), F.col("cum__n").alias("_to"), "_n")
    large = [r[0] for r in places.where(F.col("_n") > 8 * BUCKET_ROWS).select("_bucket").collect()]  # fewer than total / (8 * BUCKET_ROWS)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *order)) - 1
    ranked = (rows.where(~F.col("_bucket").isin(large)) if large else rows).withColumn("_rank", rank.cast("long"))
    if large:
        hot = K.positions(rows.where(F.col("_bucket").isin(large)), ["_bucket"], [F.col("_h"), *order], name="_rank")
        ranked = ranked.unionByName(hot)
    return ranked, places.drop("_n")


def bootstrap(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """N rows drawn with replacement.  Draw j takes place floor(u(seed, j) * N) in
    seeded-hash order; places are counted by hash bucket, so a draw finds its bucket among the
    bucket ranges and its row by the rank in the bucket.  Rows are shuffled once, by bucket;
    the result is the same under any partitioning."""
    keys = _keys(df, key_cols)
    spark = df.sparkSession
    total = df.count()
    if total == 0 or n <= 0:
        return df.limit(0)
    h = hash_u32(seed, "boot-order", *keys)
    rows, places = _indexed(df.withColumn("_h", h), total, [named(k) for k in keys])
    width = max(1, total // max(1, total // BUCKET_ROWS))
    # a bucket of the usual size covers one or two cells of ``width`` places
    cells = places.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width).cast("long"), F.floor((F.col("_to") - 1) / width).cast("long"))))
    draws = spark.range(n).select(
        F.floor(uniform(seed, "boot", F.col("id")) * F.lit(total)).cast("long").alias("_idx")
    ).withColumn("_cell", F.floor(F.col("_idx") / width).cast("long"))
    found = draws.join(cells, "_cell").where((F.col("_from") <= F.col("_idx")) & (F.col("_idx") < F.col("_to")))
    found = found.select("_bucket", (F.col("_idx") - F.col("_from")).alias("_rank"))
    return found.join(rows, ["_bucket", "_rank"]).select(*[named(c) for c in df.columns])


def resample_to(df: DataFrame, n: int, key_cols: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """N rows -- without replacement when the table has enough rows, else bootstrap."""
    total = df.count()
    if total >= n:
        return sample_random(df, n, key_cols, seed)
    return bootstrap(df, n, key_cols, seed)


def ui_sample_size(rows: int) -> int:
    """Page default max(max(10, N), min(3N, 1000))."""
    return max(max(10, rows), min(rows * 3, 1000))


def pipeline_sample_size(rows: int) -> int:
    """Pipeline default min(max(N, 100), 1000)."""
    return min(max(rows, 100), 1000)


def sample_report(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """One row comparing a table with its reduction: rows, columns, missing % of all
    cells on both sides, % of rows kept, and a warning flag below 100 rows."""
    a = P.profile_frame(original).select(
        F.col("rows").alias("orig_rows"), F.col("columns").alias("orig_columns"),
        F.col("missing_percent").alias("orig_missing_pct"))
    b = P.profile_frame(reduced).select(
        F.col("rows").alias("reduced_rows"), F.col("columns").alias("reduced_columns"),
        F.col("missing_percent").alias("reduced_missing_pct"))
    rr = b.select("reduced_rows").scalar()
    rc = b.select("reduced_columns").scalar()
    rm = b.select("reduced_missing_pct").scalar()
    return a.select(
        "orig_rows", rr.alias("reduced_rows"), "orig_columns", rc.alias("reduced_columns"),
        "orig_missing_pct", rm.alias("reduced_missing_pct"),
        (rr / F.greatest(F.col("orig_rows"), F.lit(1)) * 100.0).alias("pct_kept"),
        (rr < SMALL_WARNING_ROWS).alias("small_warning"),
    )
