"""Shared distributed plans.

* ``to_long`` / ``value_counts_long``: one long (column, value) form so that per-column
  work becomes one grouped job instead of one job per column.
* ``prefix_sums`` (K1): inclusive running sums of weights within a group in a global
  order.  Range-partition on (group, order) so a hot group is split over many tasks; a
  window over (partition, group) -- bounded by one range -- gives local sums; totals by
  (partition, group) give the offsets, of which each range needs one at most: only its first
  group can have begun in an earlier range.  The ranged frame is checkpointed
  (reliable, shared folder) so both branches see one partition assignment and lineage
  stays flat when kernels are chained.
* ``positions`` (K1, rows): the same with weight 1 -> exact 0-based position in the group.
* ``exact_quantiles`` (K2): linear-interpolation quantiles (pandas/DuckDB ``quantile_cont``
  rule).  A sample brackets each wanted rank, exact counts prove the bracket, brackets with many
  rows are refined by a sample of their inside, and only the distinct values left in the
  brackets are shuffled.  Many probabilities at once (the copula's knots) take the running
  counts of all distinct values instead (``all_quantiles``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import default_ranges, ensure_checkpoint_dir

def to_long(df: DataFrame, cols: list[str], value_type: str | None = "double",
            name: str = "column", value: str = "value", ids: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (ids..., column, value); ``value_type`` casts first so the
    columns share one type (None keeps the types, which must then agree)."""
    ids = ids or []
    def quoted(c: str) -> Column:
        return F.col("`" + c.replace("`", "``") + "`")

    plain = [f"v{i}" for i in range(len(cols))]  # names may hold dots and commas
    sel = [quoted(c) for c in ids] + [(quoted(c).cast(value_type) if value_type else quoted(c)).alias(p) for c, p in zip(cols, plain)]
    long = df.select(*sel).unpivot([quoted(c) for c in ids], plain, name, value)
    back = F.create_map(*[F.lit(x) for p, c in zip(plain, cols) for x in (p, c)])
    return long.withColumn(name, back[F.col(name)]) if cols else long


def value_counts_long(df: DataFrame, cols: list[str], value_type: str | None = "string",
                      dropna: bool = True) -> DataFrame:
    """(column, value, cnt) for every column; partial aggregation happens map-side, so a
    value that holds a third of all rows costs one row per map task."""
    long = to_long(df, cols, value_type)
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


_PERSISTED: list[DataFrame] = []


def _persist(df: DataFrame) -> DataFrame:
    """Persist a frame that two branches of one plan must read identically (a re-planned
    range exchange would re-sample its boundaries).  Lost blocks are rebuilt from the same
    shuffle dependency, so the partition assignment survives executor loss."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(out)
    return out


def _cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a reliable checkpoint in the shared ``spark.checkpoint.dir``
    and continue from it: both branches of a kernel read identical partitions, a lost
    executor costs no recomputation, and the next kernel starts from a one-node plan
    (chained kernels would otherwise nest their lineage twice per step)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Unpersist every frame the kernels persisted (call once results are written)."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist()


def prefix_sums(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                weights: list[str | Column], prefix: str = "cum_", n_ranges: int | None = None,
                cut: bool = True) -> DataFrame:
    """Add ``prefix+i`` (i-th weight) = inclusive running sum within the group, rows ordered
    by ``order_cols`` (the order must be unique inside a group for a defined result).

    Range partitions on (group, order) split a hot group over many tasks; inside each
    partition a window over (partition, group) -- bounded by one range -- gives local
    sums, and totals by (partition, group) give the offsets.  A group has none in its first
    range, so however many groups there are, one offset a range is broadcast."""
    n = n_ranges or default_ranges(df.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    wcols = [F.col(w) if isinstance(w, str) else w for w in weights]
    keys = [F.col(g) for g in group_cols] + order
    base = df.select("*", *[w.alias(f"_w{i}") for i, w in enumerate(wcols)])
    ranged = base.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    if n > default_ranges(df.sparkSession):  # the window would deal the ranges to the session's partitions, several to a task
        ranged = ranged.repartitionById(n, "_pid")
    wl = (
        Window.partitionBy("_pid", *group_cols)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    k = len(wcols)
    local = ranged.select("*", *[F.sum(f"_w{i}").over(wl).alias(f"_lc{i}") for i in range(k)])
    # ``cut=False`` (results consumed right away, never chained): a persisted frame gives
    # both branches the same partitions without the checkpoint write
    local = _cut(local) if cut else _persist(local)
    totals = local.groupBy("_pid", *group_cols).agg(*[F.sum(f"_w{i}").alias(f"_t{i}") for i in range(k)])
    wspec = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    wspec = wspec.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *group_cols, F.count(F.lit(1)).over(wspec).alias("_earlier"),
        *[F.coalesce(F.sum(f"_t{i}").over(wspec), F.lit(0)).alias(f"_b{i}") for i in range(k)],
    ).where(F.col("_earlier") > 0).drop("_earlier")
    lo = local.alias("_l")
    of = F.broadcast(offsets.alias("_o"))
    on = _null_safe_on(lo, of, ["_pid", *group_cols])
    names = [prefix + (w if isinstance(w, str) else str(i)) for i, w in enumerate(weights)]
    return lo.join(of, on, "left").select(
        *[lo["`" + c.replace("`", "``") + "`"] for c in df.columns],
        *[(lo[f"_lc{i}"] + F.coalesce(of[f"_b{i}"], F.lit(0))).alias(names[i]) for i in range(k)],
    )


def positions(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
              name: str = "_pos", n_ranges: int | None = None) -> DataFrame:
    """Add ``name``: exact 0-based position of the row in its group, rows sorted by
    ``order_cols`` (callers pass a unique order, e.g. hash then key)."""
    out = prefix_sums(df, group_cols, order_cols, [F.lit(1)], prefix="_cum", n_ranges=n_ranges)
    return out.withColumn(name, F.col("_cum0") - 1).drop("_cum0")


def quoted(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """The number, NULL where it is NaN."""
    return F.when(~F.isnan(c), c)


@dataclass
class _Bracket:
    """The ranks ``first`` and ``last`` (next to each other) of a column lie among its values
    from ``low`` to ``high``, of which there are ``inside``; ``below`` are smaller."""

    column: str
    prob: float
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    part: float  # of the way from the first rank's value to the last one's

    @property
    def held(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside


SKETCHED = 200_000  # rows of the sample that a bracket is drawn from; the counts prove it


def sampled(df: DataFrame, rows: int, seed: int, wanted: int = SKETCHED) -> DataFrame:
    """About ``wanted`` rows of ``rows``, for bounds that are proved by counts afterwards."""
    return df if rows <= wanted else df.sample(wanted / rows, seed)


def _sketch(df: DataFrame, brackets: list[_Bracket], share: float, seed: int) -> None:
    """Narrow every bracket to what a sample of its inside puts around its ranks: ``share`` of
    it to each side, or four standard deviations of the sample's rank if that is more."""
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.column, b.low, b.high), []).append(b)
    exprs, ends = [], []
    for (c, low, high), some in spans.items():
        v, inside = finite(quoted(c)), some[0].inside
        width = max(share, 2 / math.sqrt(min(inside, SKETCHED)))
        at = [(b.first - b.below) / max(1, inside - 1) for b in some]
        ends.append([(x - width, x + width) for x in at])
        exprs.append(F.percentile_approx(F.when(v.between(low, high), v), [min(1.0, max(0.0, e)) for pair in ends[-1] for e in pair], int(4 / share)))
    rows = min(b.inside for b in brackets)
    row = sampled(df, rows, seed).agg(*[e.alias(f"q{i}") for i, e in enumerate(exprs)]).first()
    for some, pairs, found in zip(spans.values(), ends, row):
        for k, (b, (least, most)) in enumerate(zip(some, pairs)):
            if found:
                b.low = b.low if least <= 0 else found[2 * k]
                b.high = b.high if most >= 1 else found[2 * k + 1]


def _count(df: DataFrame, brackets: list[_Bracket]) -> None:
    exprs = []
    for i, b in enumerate(brackets):
        v = finite(quoted(b.column))
        exprs += [F.count(F.when(v < b.low, 1)).alias(f"b{i}"), F.count(F.when(v.between(b.low, b.high), 1)).alias(f"i{i}")]
    row = df.agg(*exprs).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = row[f"b{i}"], row[f"i{i}"]


def _picked(df: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """The values at the first and last rank of each bracket, from the distinct values in it."""
    cols = sorted({b.column for b in brackets})
    spans = [(cols.index(b.column), b.low, b.high) for b in brackets]

    def inside(batches):
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # NULL is NaN, which no bracket holds
            for i, (j, low, high) in enumerate(spans):
                v, c = np.unique(values[j][(values[j] >= low) & (values[j] <= high)], return_counts=True)
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(v), pa.array(c, pa.int64())], names=["i", "v", "c"])
    found = df.select(*[quoted(c).alias(f"v{j}") for j, c in enumerate(cols)]).mapInArrow(inside, "i int, v double, c bigint")
    values = found.groupBy("i", "v").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("v"))  # a bracket's few values
    wanted = [F.struct(F.lit(b.first - b.below).alias("first"), F.lit(b.last - b.below).alias("last")) for b in brackets]
    at = F.array(*wanted)[F.col("i")]
    ranked = values.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c")).withColumn("at", at)
    found = ranked.groupBy("i").agg(*[F.max(F.when((F.col("from") <= F.col(f"at.{r}")) & (F.col(f"at.{r}") < F.col("upto")), F.col("v"))).alias(r) for r in ("first", "last")])
    return {r["i"]: (r["first"], r["last"]) for r in found.collect()}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], few: int = 100_000, share: float = 0.001, at_once: int = 24) -> DataFrame:
    """Long table (column, prob, value): exact quantiles with linear interpolation between the
    two neighbouring order statistics (NULL/NaN ignored; empty columns absent).

    Rounds over the brackets of all columns: sample, count, until a bracket has at most ``few``
    rows, one value, or shrinks no more.  A bracket that a sample put beside its ranks goes
    back to the last one that held them.  The driver sees a few numbers a bracket."""
    spark, schema = df.sparkSession, "column string, prob double, value double"
    if not cols:
        return spark.createDataFrame([], schema)
    if len(probs) > 8:
        return all_quantiles(df, cols, probs)
    df = df.select(*[quoted(c).cast("double").alias(c) for c in cols])
    ends = df.agg(*[f(finite(quoted(c))).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    out = []
    for some in chunked([(i, c) for i, c in enumerate(cols) if ends[f"n{i}"]], max(1, at_once // len(probs))):
        brackets = []
        for i, c in some:
            n = ends[f"n{i}"]
            for p in probs:
                h = (n - 1) * float(p)
                brackets.append(_Bracket(c, float(p), math.floor(h), math.ceil(h), ends[f"a{i}"], ends[f"b{i}"], 0, n, h - math.floor(h)))
        wide, seed = [b for b in brackets if b.inside > few and b.low < b.high], 0
        while wide and seed < 8:
            before, seed = [(b.low, b.high, b.below, b.inside) for b in wide], seed + 1
            _sketch(df, wide, share, seed)
            _count(df, wide)
            further = []
            for b, old in zip(wide, before):
                if not b.held:  # unlucky sample: another one
                    b.low, b.high, b.below, b.inside = old
                    further.append(b)
                elif b.inside > few and b.low < b.high and b.inside <= old[3] // 2:
                    further.append(b)
            wide = further
        several = [b for b in brackets if b.low < b.high]
        values = _picked(df, several) if several else {}
        place = {id(b): values[i] for i, b in enumerate(several)}
        for b in brackets:
            first, last = place.get(id(b), (b.low, b.low))
            out.append((b.column, b.prob, first if last == first else first + b.part * (last - first)))
    return spark.createDataFrame(out, schema)


def all_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                  n_ranges: int | None = None) -> DataFrame:
    """``exact_quantiles`` for many probabilities.

    Values are counted first, so a value holding a third of the rows is one row before the
    range split; the running count over distinct values locates each needed rank."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, prob double, value double")
    long = to_long(df, cols, "double").where(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = _persist(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c")))
    cum = prefix_sums(vc, ["column"], ["value"], ["_c"], prefix="_cum", cut=True)
    counts = _persist(vc.groupBy("column").agg(F.sum("_c").alias("_n")))  # one row per column
    need = (
        counts.select("column", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("_h", (F.col("_n") - 1) * F.col("prob"))
        .withColumn("_lo", F.floor("_h").cast("long"))
        .withColumn("_hi", F.ceil("_h").cast("long"))
        .withColumn("_frac", F.col("_h") - F.col("_lo"))
    )
    ranks = (
        need.select("column", F.col("_lo").alias("_r"))
        .union(need.select("column", F.col("_hi").alias("_r")))
        .distinct()
    )
    # locate each needed rank by an equi-join on rank buckets (bucket width n/1024 per
    # column): a value's rank interval [cum - c, cum) is exploded into the buckets it
    # spans (only values holding more than n/1024 rows span several)
    bw = F.broadcast(counts.select("column", F.greatest(F.lit(1), F.floor(F.col("_n") / 1024)).cast("long").alias("_bw")))
    cb = cum.join(bw, "column").select(
        "column", "value", (F.col("_cum_c") - F.col("_c")).alias("_from"), F.col("_cum_c").alias("_to"),
        F.explode(F.sequence(F.floor((F.col("_cum_c") - F.col("_c")) / F.col("_bw")).cast("long"),
                             F.floor((F.col("_cum_c") - 1) / F.col("_bw")).cast("long"))).alias("_bk"))
    rk = ranks.join(bw, "column").select("column", "_r", F.floor(F.col("_r") / F.col("_bw")).cast("long").alias("_bk"))
    picked = _persist(cb.join(F.broadcast(rk), ["column", "_bk"]).where(  # #columns x #probs x 2 rows
        (F.col("_from") <= F.col("_r")) & (F.col("_r") < F.col("_to"))
    ).select("column", "_r", "value"))
    lo = picked.select("column", F.col("_r").alias("_lo"), F.col("value").alias("_vlo"))
    hi = picked.select("column", F.col("_r").alias("_hi"), F.col("value").alias("_vhi"))
    return (
        need.join(lo, ["column", "_lo"]).join(hi, ["column", "_hi"])
        .select("column", "prob", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"))
    )


def quantile_map(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, dict[float, float]]:
    """Driver-side {column: {prob: value}}; (#columns x #probs) numbers cross the wire."""
    out: dict[str, dict[float, float]] = {}
    for row in exact_quantiles(df, cols, probs).collect():
        out.setdefault(row["column"], {})[row["prob"]] = row["value"]
    return out


def modes(df: DataFrame, cols: list[str], value_type: str | None = "string") -> DataFrame:
    """(column, value, cnt): most frequent non-null value per column, smallest on ties."""
    vc = value_counts_long(df, cols, value_type)
    best = vc.groupBy("column").agg(F.max("cnt").alias("_m"))
    return (
        vc.join(best, "column").where(F.col("cnt") == F.col("_m"))
        .groupBy("column").agg(F.min("value").alias("value"), F.first("_m").alias("cnt"))
    )


def dense_index(df: DataFrame, order_cols: list[str | Column], name: str = "_idx",
                n_ranges: int | None = None) -> DataFrame:
    """0-based row index over the whole table in the given (unique) order."""
    return positions(df, [], order_cols, name=name, n_ranges=n_ranges)


def numbered(df: DataFrame, length: str, name: str, keys: list[str], step: int = 1 << 16) -> DataFrame:
    """``length`` copies of every row, numbered 0, 1, ... in ``name``.  Rows are first copied
    once for each ``step`` numbers and those copies dealt over the tasks, so no row holds an
    array of all its numbers and one long row is still split.

    Spark sizes the result by ``df``, since it does not see how many numbers follow, and would
    broadcast it: join it by ``joined``."""
    last = F.floor((F.col(length) - 1) / F.lit(step)).cast("long")
    parts = df.where(F.col(length) > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = parts.repartition(default_ranges(df.sparkSession), *keys, "_part")
    first = F.col("_part") * F.lit(step).cast("long")
    end = F.least(first + F.lit(step), F.col(length).cast("long")) - 1
    return parts.withColumn(name, F.explode(F.sequence(first, end))).drop("_part")


def joined(rows: DataFrame, other: DataFrame, keys: list[str], size: int = 0, how: str = "inner") -> DataFrame:
    """Join of two large frames, of which one may look small to Spark (``numbered`` rows): a
    merge join, whatever the estimates, so neither is gathered on the driver.  ``size``: rows of
    the larger one, which sets the number of tasks."""
    return dealt(rows, size, keys).hint("merge").join(dealt(other, size, keys), keys, how)


TASK_ROWS = 1 << 18  # rows of one frame that a task sorts, however few partitions the session has


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows: the session's, or more where a task would get over
    ``TASK_ROWS`` of them, so that its memory does not grow with the table."""
    return max(default_ranges(spark), -(-int(rows) // TASK_ROWS))


def dealt(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` for the join, window or grouping by them that follows, where the
    session's partitions are too few for ``rows`` rows; otherwise that is left to Spark."""
    n = partitions(df.sparkSession, rows)
    return df.repartition(n, *keys) if n > default_ranges(df.sparkSession) else df


def chunked(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
