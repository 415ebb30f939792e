"""Most recent rows and the bootstrap by buckets, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsynth.operators import profile as P
from tabsynth.operators import sample as S
from tabsynth.operators.evaluate import overview


def test_recent_rows_with_ties_and_missing_times(spark):
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.02 else rng.choice([5.0, 5.0, 5.0, *range(50)]) * 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, t double")
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), -r[0]))
    stamped = df.select("id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("a.time"))
    text = df.select("id", F.format_string("%09.1f", "t").alias("t"))
    for n in (1, 30, 100, 700, 3999, 4000, 5000):
        want = {r[0] for r in order[:n]}
        assert {r["id"] for r in S.sample_recent(df, n, "t", ["id"]).collect()} == want
        assert n > 700 or {r["id"] for r in S.sample_recent(stamped, n, "a.time", ["id"]).collect()} == want
    assert S.sample_recent(text.where("t is not null"), 50, "t", ["id"]).count() == 50


@pytest.mark.parametrize("bucket_rows", [50_000, 100, 3])
def test_bootstrap_is_the_same_under_any_partitioning(spark, monkeypatch, bucket_rows):
    df = spark.range(1000).select(F.col("id").alias("k.1"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, S.bootstrap(df, 1500, ["k.1"]).collect()))
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    for parts in (1, 13):
        got = sorted(map(tuple, S.bootstrap(df.repartition(parts), 1500, ["k.1"]).collect()))
        assert got == want and len(got) == 1500
    assert max(Counter(want).values()) > 2


def test_bootstrap_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    got = Counter(r["k"] for r in S.bootstrap(df, 3000, ["k"]).collect())
    assert sum(got.values()) == 3000 and 850 < got[0] < 1150
    plan = S.bootstrap(df.where("k > 0"), 10, ["k"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


def test_names_with_dots(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0, "a"), ("2024-01-05", 3.0, None), ("bad", 9.0, "c")], "`t.x` string, `S.No` double, `a b` string")
    assert [(str(r[0])[:10], r[1]) for r in P.time_trend(df, "t.x", "S.No").collect()] == [("2024-01-05", 2.0)]
    assert P.time_trend(df, "t.x").columns == ["t.x", "count"]
    assert P.table_bytes(df).first()["bytes"] == 10 + 10 + 3 + 24 + 2
    assert P.round_doubles(df, 0).columns == df.columns
    assert overview(df, df).count() >= 1
