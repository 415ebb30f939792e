"""Every query with an oracle matches DuckDB on sf0.001 (the driver checks sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SLOW = {"copula_sample", "full_pipeline", "smote_generate", "sequence_bootstrap"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    scols, srows = _canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    dcols, drows = _canon(rel.columns, rel.fetchall())
    assert scols == dcols
    assert srows == drows


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "metric" in df.columns
