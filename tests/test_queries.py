"""Every trace query against its SQL."""

import math

import duckdb
import pytest

from tracewell.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, small, name):
    got = plans.queries()[name](spark, small)
    want = duck.sql(plans.oracle_sql()[name])
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_expected_counts(spark, small):
    got = {(r["state"], r["decision"]): r["n"] for r in plans.queries()["sampling_decisions"](spark, small).groupBy("state", "decision").count().withColumnRenamed("count", "n").collect()}
    assert got == {("active", "pending"): 13, ("force", "keep"): 15, ("ready", "keep"): 45, ("ready", "drop"): 2}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 75
    assert set(e.oracle_sql()) <= set(e.queries())
