"""Neighbours inside a class against brute force, and the size of the plans around them."""

import random
import re

import pytest

import __spark_entry__ as entry
from tabsynth.operators.generate import smote as G2
from tabsynth.plans import kernels as K

from .conftest import SF


def _rows():
    r = random.Random(3)
    rows = [(i, "a" if i % 3 else "b", float(r.randint(0, 30)), float(r.choice([0, 1, 2])), 1e9 + r.randint(0, 3)) for i in range(600)]
    return rows + [(5000 + i, "c", 1.0, 2.0, 1e9) for i in range(40)] + [(6000, "d", 1.0, 1.0, 1.0), (6001, "d", 1.0, 1.0, 2.0), (7000, "e", 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("block", [16, None])
def test_neighbours_are_exact_with_copies_and_ties(spark, block):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, cls string, x double, y double, z double")
    want = set()
    for a in rows:
        others = sorted((sum(((p - q) ** 2 for p, q in zip(a[2:], b[2:])), 0.0), b[0]) for b in rows if b[1] == a[1] and b[0] != a[0])
        want |= {(a[0], k, i + 1, d) for i, (d, k) in enumerate(others[:5])}
    got = [tuple(r) for r in G2.knn_within_class(df, "id", "cls", ["x", "y", "z"], 5, block=block).select("id", "nn_key", "nn_rank", "dist2").collect()]
    assert len(got) == len(want) and set(got) == want
    some = df.where("id % 7 = 0")
    part = [tuple(r) for r in G2.knn_within_class(df, "id", "cls", ["x", "y", "z"], 5, queries=some.select("id"), block=block).collect()]
    assert set(part) == {w for w in want if w[0] % 7 == 0} and len(part) == len(set(part))


def test_pairs_of_rows_are_not_joined(spark):
    """Pairs are compared block by block, so no operator gives a row for each of them."""
    plan = entry.queries()["smote_neighbors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "c_e0" not in plan


def test_plan_of_balancing_stays_short(spark):
    """Nested cached plans once made this plan's text 3,170,828 characters long."""
    text = entry.queries()["smote_balance"](spark, SF)._jdf.queryExecution().toString()
    assert len(text) < 300_000


def test_tasks_follow_the_rows(spark, monkeypatch):
    """a task's share must not grow with the rows where partitions are few; candidates bring
    their keys along, so they are not joined with all vectors to break ties."""
    df = spark.createDataFrame(_rows(), "id long, cls string, x double, y double, z double")
    args = (df, "id", "cls", ["x", "y", "z"], 5)
    want = sorted(G2.knn_within_class(*args, block=16).collect())
    monkeypatch.setattr(K, "TASK_ROWS", 40, raising=False)
    sizes = []
    monkeypatch.setattr(K, "prefix_sums", lambda *a, f=K.prefix_sums, **k: sizes.append(k.get("n_ranges")) or f(*a, **k))
    got = G2.knn_within_class(*args, block=16)
    assert len(sizes) == 2 and all(n and n >= df.count() / 40 for n in sizes)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())]
    assert dealt and min(dealt) >= df.count() / 40
    assert sorted(got.collect()) == want
