"""Date and missing-value text, copies by number, and the sequence and SMOTE generators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabsynth.operators import clean as C
from tabsynth.operators.generate.sequence import generate_sequences
from tabsynth.plans import kernels as K

from .conftest import SF


@pytest.mark.parametrize("text,expected", [
    ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10)),
    ("2024-01-05 10:00:00+02:00", datetime(2024, 1, 5, 8)),
    ("2024-01-05T10:00:00.250Z", datetime(2024, 1, 5, 10, 0, 0, 250000)),
    ("Jan 5, 2024", datetime(2024, 1, 5)),
    ("05-Jan-2024", datetime(2024, 1, 5)),
    ("25/12/2024", datetime(2024, 12, 25)),
    ("1/5/2024", datetime(2024, 1, 5)),
    ("1/5/2024 10:30", datetime(2024, 1, 5, 10, 30)),
    ("2024.01.05", datetime(2024, 1, 5)),
])
def test_date_shapes(spark, text, expected):
    df = spark.createDataFrame([(text,)] * 3, "d string")
    decision = C.decide_text_types(df, ["d"])[0]
    assert decision.kind == "datetime"
    assert df.select(C.convert_expr(decision)).first()[0] == expected


def test_reader_tokens_leave_numbers(spark):
    df = spark.createDataFrame([("1", "a"), ("NA", "N/A"), ("n/a", "<NA>"), ("4", "b"), (None, None)], "x string, y string")
    types = {r["column"]: r["inferred_type"] for r in C.infer_column_types(df).collect()}
    assert types == {"x": "bigint", "y": "string"}
    assert [tuple(r) for r in C.apply_inferred_types(df, types).collect()] == [
        (1, "a"), (None, None), (None, None), (4, "b"), (None, None)]


def test_numbered_copies(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 8)], "k string, n long")
    got = sorted((r["k"], r["i"]) for r in K.numbered(df, "n", "i", ["k"], step=4).collect())
    assert got == [(k, i) for k, n in (("b", 1), ("c", 7), ("d", 8)) for i in range(n)]


@pytest.mark.parametrize("key", [None, "o_orderstatus"])
def test_sequences(spark, key):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_orderdate")
    out = generate_sequences(orders, 300, "o_orderdate", key, ["o_orderpriority"])
    assert out.schema.simpleString() == orders.schema.simpleString()
    assert out.count() == 300
    if key:
        assert out.groupBy(key).agg(F.count_distinct("o_orderpriority").alias("n")).agg(F.max("n")).first()[0] == 1


def test_rows_without_a_key_are_a_sequence(spark):
    rows = [(None if i % 3 else 7, datetime(2024, 1, 1, i % 24, i), f"v{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, v string")
    got = generate_sequences(df, 200, "t", "k")
    assert got.count() == 200 and {r["v"] for r in got.collect()} <= {f"v{i}" for i in range(30)}
    lone = generate_sequences(df.where("k is null"), 50, "t", "k")
    assert lone.count() == 50


def test_tasks_of_sequences_follow_the_rows(spark, monkeypatch):
    """a task's share of the rows must not grow with the table where partitions are few."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    want = sorted(generate_sequences(ev, 900, "ts", "user_id", ["props"]).collect())
    monkeypatch.setattr(K, "TASK_ROWS", 50, raising=False)
    got = generate_sequences(ev, 900, "ts", "user_id", ["props"])
    assert got.rdd.getNumPartitions() >= ev.count() / 50
    assert sorted(got.collect()) == want


def test_offsets_of_running_sums_are_one_a_range(spark):
    """rows already dealt by range were shuffled again to meet the totals of many groups."""
    df = spark.range(3000).selectExpr("id", "if(id < 1500, -1, id % 700) as g")
    out = K.prefix_sums(df, ["g"], ["id"], [F.col("id")], prefix="s", n_ranges=37)
    assert out.rdd.getNumPartitions() == 37  # the session has 8: its tasks took several ranges
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    sums, want = {}, set()
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["id"]
        want.add((r["id"], r["g"], sums[r["g"]]))
    assert {tuple(r) for r in out.collect()} == want


def test_sequences_stay_in_order_and_repeat(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    first = generate_sequences(ev, 500, "ts", "user_id")
    again = generate_sequences(ev.repartition(13), 500, "ts", "user_id")
    assert sorted(first.collect()) == sorted(again.collect())
    steps = first.selectExpr("user_id", "ts", "lag(ts) over (partition by user_id order by ts) as before")
    assert steps.where("before > ts").count() == 0


def test_feature_reduction_near_the_limit(spark):
    from tabsynth.operators.features import reduce_features

    n = 1000
    df = spark.range(n).selectExpr("id as n", "'x' as same", "cast(null as string) as none", "cast(id % 600 as string) as at_limit",
                                   "cast(id % 601 as string) as over", "cast(id % 50 as string) as few", "cast(id % 610 as string) as `dotted.over`",
                                   "cast(id as string) as kept", "cast('nan' as double) as nothing", "0.0D * (id - 5) as zeros")
    out, dropped = reduce_features(df, ["kept"])
    assert dropped == ["same", "none", "over", "dotted.over", "nothing", "zeros"]
    assert out.columns == ["n", "at_limit", "few", "kept"] and out.count() == n
    small = spark.range(51).selectExpr("cast(id % 50 as string) as fifty", "cast(id as string) as more")
    assert reduce_features(small)[1] == ["more"]
    assert reduce_features(df.limit(0))[0].columns == []


@pytest.mark.parametrize("name", ["copula_sample", "full_pipeline", "smote_generate"])
def test_generator_queries(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_smote_variant_fills_and_never_repeats(spark):
    from tabsynth.operators.generate.smote import generate_smote

    rows = [(float(i), float(i * i % 7), None, "n" if i < 20 else "p") for i in range(26)]
    df = spark.createDataFrame(rows, "x double, y double, note string, cls string")
    got = generate_smote(df, "cls", 1000, variant=True)
    assert got.count() == 40 and {r["note"] for r in got.collect()} == {"__missing__"}
    assert generate_smote(df, "cls", 7, variant=True).count() == 7
    assert generate_smote(df, "cls", 100).count() == 100 and {r["note"] for r in generate_smote(df, "cls", 50).collect()} == {"missing"}


def test_numbered_rows_are_not_broadcast(spark):
    long = K.numbered(spark.createDataFrame([("a", 200_000)], "g string, n bigint"), "n", "_j", ["g"])
    other = spark.range(300_000).select("id", (F.col("id") % 1000).alias("v"))
    both = K.joined(long.select(F.col("_j").alias("id")), other, ["id"])
    assert both.count() == 200_000
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
