"""Sequential generation (G4, re-aimed): moving-block bootstrap of sequences.

Rows are ordered by time inside each sequence key (no key: the whole table is one
sequence) and numbered with the range-split kernel.  Output sequence g copies a source
sequence chosen by a seeded hash; its positions are filled by blocks of ``block``
consecutive source positions starting at hashed offsets; context columns stay constant
per output sequence; new times are the source sequence's first time plus the running sum
of the observed gaps (running sum by the range-split kernel, so a sequence as long as the
table is still split over many tasks).  Exactly n rows are produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import typeclass as tc
from ...functions.columns import DATETIME_FORMATS, epoch_micros, parse_datetime, uniform
from ...plans import kernels as K

BLOCK = 8
SEED = 42


def _as_time(df: DataFrame, time_col: str):
    dt = tc.field_type(df, time_col)
    c = F.col(f"`{time_col}`")
    if tc.is_datetime(dt):
        return c.cast("timestamp_ntz")
    return F.coalesce(*[parse_datetime(c, f) for f in DATETIME_FORMATS])


def generate_sequences(df: DataFrame, n: int, time_col: str, sequence_key: str | None = None,
                       context_columns: list[str] | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    if n <= 0:
        raise ValueError(f"cannot draw {n} rows")
    if not time_col or time_col not in df.columns:
        raise ValueError("a sequence needs a column of times")
    spark = df.sparkSession
    key = sequence_key if sequence_key and sequence_key in df.columns and sequence_key != time_col else None
    ctx = [c for c in (context_columns or []) if c in df.columns and c not in (key, time_col)]
    base = df.withColumn(time_col, _as_time(df, time_col)).where(F.col(f"`{time_col}`").isNotNull())
    # rows without a key are one sequence of their own, before all others
    named = F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("")) if key else F.lit("all")
    base = base.withColumn("_seq", named)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    known = df.count()  # tasks follow the rows read and drawn, so a task's share does not grow with them
    ranges = K.partitions(spark, known)
    ranked = K.positions(base.withColumn("_tie", tie), ["_seq"], [F.col(f"`{time_col}`"), F.col("_tie")], name="_p", n_ranges=ranges)
    ranked = K._persist(ranked)
    held = [f"_ctx{i}" for i in range(len(ctx))]  # first value of each context column, carried along
    seqs = ranked.groupBy("_seq").agg(F.count(F.lit(1)).alias("_len"), F.min(f"`{time_col}`").alias("_t0"),
                                      *[F.min_by(f"`{c}`", "_p").alias(h) for c, h in zip(ctx, held)])
    seqs = K._persist(K.positions(seqs, [], [F.col("_seq")], name="_si", n_ranges=ranges))
    stats = seqs.agg(F.count(F.lit(1)).alias("k"), F.avg("_len").alias("m")).first()
    if not stats["k"]:
        raise ValueError("no row has a time")
    n_seq, mean_len = stats["k"], stats["m"]
    # output sequences: enough to cover n rows (a few spare, trimmed below)
    g_count = int(n / mean_len * 1.25) + 8
    while True:
        outs = spark.range(g_count).select(
            F.col("id").alias("_g"),
            F.floor(uniform(seed, "seq-src", F.col("id")) * n_seq).cast("long").alias("_si"))
        outs = K.dealt(outs, max(g_count, n_seq), ["_si"]).join(K.dealt(seqs, max(g_count, n_seq), ["_si"]), "_si")
        outs = K.prefix_sums(outs, [], [F.col("_g")], ["_len"], prefix="_cum", n_ranges=K.partitions(spark, g_count))
        covered = outs.select(F.max("_cum_len")).first()[0] or 0
        if covered >= n:
            break
        g_count *= 2
    outs = outs.where(F.col("_cum_len") - F.col("_len") < n)
    left = F.lit(n) - (F.col("_cum_len") - F.col("_len"))  # rows still wanted when the sequence begins
    outs = outs.select("_g", "_seq", "_len", "_t0", *held, F.least(F.col("_len"), left).alias("_take"))
    rows = K.numbered(outs, "_take", "_j", ["_g"])
    blen = F.least(F.lit(block), F.col("_len"))
    b = F.floor(F.col("_j") / F.lit(block)).cast("long")
    off = F.floor(uniform(seed, "seq-block", F.col("_g"), b) * (F.col("_len") - blen + 1)).cast("long")
    rows = rows.select("*", F.least(off + F.col("_j") % F.lit(block), F.col("_len") - 1).alias("_p"))
    # the gap before each source position (none before the first) and its running sum: times and
    # numbers only, so that the other columns are moved once, in the last join
    times = ranked.select("_seq", "_p", epoch_micros(F.col(f"`{time_col}`"), T.TimestampNTZType()).alias("_at"))
    before = times.select("_seq", (F.col("_p") + 1).alias("_p"), F.col("_at").alias("_prev"))
    larger = max(known, n)
    gaps = K.joined(times, before, ["_seq", "_p"], larger, "left").select("_seq", "_p", F.coalesce(F.col("_at") - F.col("_prev"), F.lit(0)).alias("_step"))
    placed = K.joined(rows, gaps, ["_seq", "_p"], larger).withColumn("_gap", F.when(F.col("_j") == 0, F.lit(0)).otherwise(F.col("_step")))
    cum = K.prefix_sums(placed.select("_g", "_j", "_seq", "_p", "_t0", "_gap", *held), ["_g"], [F.col("_j")], ["_gap"], prefix="_cum",
                        n_ranges=K.partitions(spark, n))
    payload = ranked.select("_seq", "_p", *[F.col(f"`{c}`") for c in df.columns if c != time_col])
    cum = K.joined(cum, payload, ["_seq", "_p"], larger)
    new_t = F.timestamp_add("MICROSECOND", F.col("_cum_gap"), F.col("_t0").cast("timestamp_ntz")).cast(
        tc.field_type(df, time_col) if tc.is_datetime(tc.field_type(df, time_col)) else "timestamp_ntz")
    sel = []
    for c in df.columns:
        if c == time_col:
            v = new_t if tc.is_datetime(tc.field_type(df, time_col)) else new_t.cast("string")
        elif key and c == key:
            v = F.col("_g").cast(tc.field_type(df, c)) if tc.is_numeric(tc.field_type(df, c)) else F.concat(F.lit("seq-"), F.col("_g").cast("string"))
        elif c in ctx:
            v = F.col(held[ctx.index(c)])
        else:
            v = F.col(f"`{c}`")
        sel.append(v.alias(c))
    return cum.select(*sel)
