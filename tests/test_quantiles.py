"""Bracketed quantiles and the two-sample statistic against numpy, with forced refinement."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsynth.operators import evaluate as E
from tabsynth.plans import kernels as K


def table(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), rng.choice([0.0, 0.0, 0.0, 1.0, 5.0]), 10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]), None if rng.random() < 0.5 else rng.randint(0, 9) * 1.0,
             float("nan") if rng.random() < 0.1 else rng.random(), 7.0, None) for _ in range(n)]
    return spark.createDataFrame(rows, "gauss double, ties double, wild double, `with.dot` double, nans double, same double, none double")


@pytest.mark.parametrize("few, share", [(100_000, 0.001), (10, 0.05), (1, 0.2), (50, 0.0005)])
def test_exact_quantiles(spark, few, share):
    df = table(spark)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in K.exact_quantiles(df, df.columns, probs, few, share, at_once=10).collect()}
    pdf = df.toPandas()
    assert {c for c, _ in got} == set(df.columns) - {"none"}
    for (c, p), value in got.items():
        assert value == pytest.approx(np.nanquantile(pdf[c].astype(float), p), rel=1e-12, abs=1e-300), (c, p)
    many = {(r["column"], r["prob"]): r["value"] for r in K.all_quantiles(df, ["gauss", "ties"], probs).collect()}
    assert all(got[k] == pytest.approx(v) for k, v in many.items())


def test_infinite_values_and_one_row(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), None), (2.0, None), (3.0, None)], "a double, b double")
    got = {(r["column"], r["prob"]): r["value"] for r in K.exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): -math.inf, ("a", 0.5): 2.5, ("a", 1.0): math.inf, ("b", 0.0): 1.0, ("b", 0.5): 1.0, ("b", 1.0): 1.0}
    assert K.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_quantiles_shuffle_no_rows(spark):
    df = spark.range(200_000).select((F.hash("id") % 100_000).cast("double").alias("a"))
    got = K.exact_quantiles(df, ["a"], [0.25, 0.5], few=1000).collect()
    want = np.quantile(np.array([r[0] for r in df.collect()]), [0.25, 0.5])
    assert [r["value"] for r in got] == pytest.approx(list(want))


def brute_ks(a, b):
    a, b = ([x for x in s if x is not None and not math.isnan(x)] for s in (a, b))
    if not a or not b:
        return None
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("bins", [2048, 7, 1])
def test_ks_by_branch_and_bound(spark, monkeypatch, bins):
    monkeypatch.setattr(E, "KS_BINS", bins)
    monkeypatch.setattr(E, "KS_COLUMNS", 3)
    real, synth = table(spark, 1, 700), table(spark, 2, 500).withColumn("gauss", F.col("gauss") * 1.3 + 0.1)
    got = {r["column"]: r["ks_statistic"] for r in E.ks_test_report(real, synth).collect()}
    a, b = real.toPandas().astype(object), synth.toPandas().astype(object)
    want = {c: brute_ks(a[c].tolist(), b[c].tolist()) for c in real.columns if c != "none"}
    assert got == pytest.approx({c: d for c, d in want.items() if d is not None})


def test_opened_bins_get_tasks_by_the_values_in_them(spark, monkeypatch):
    import numpy as np

    from tabsynth.operators import evaluate as E

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=4000), rng.normal(size=3000)
    seen = []
    prefix_sums = E.K.prefix_sums
    monkeypatch.setattr(E.K, "prefix_sums", lambda *a, n_ranges=None, **kw: seen.append(n_ranges) or prefix_sums(*a, n_ranges=n_ranges, **kw))
    monkeypatch.setattr(E, "KS_BINS", 2)
    monkeypatch.setattr(E, "KS_HELD", 100)
    monkeypatch.setattr(E, "KS_DEALT", 200)
    real, synth = (spark.createDataFrame([(float(a),) for a in v], "x double") for v in (x, y))
    got = E.ks_test_report(real, synth).first()["ks_statistic"]
    at = np.concatenate([x, y])
    want = np.abs(np.searchsorted(np.sort(x), at, "right") / 4000 - np.searchsorted(np.sort(y), at, "right") / 3000).max()
    assert abs(got - want) < 1e-12 and seen[0] > 10
