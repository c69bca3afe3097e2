"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestar import plans

DATA = os.environ.get("LODESTAR_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, DATA).columns
