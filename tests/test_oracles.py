"""Every query with oracle SQL gives the oracle's rows on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from cairn.plans import load
from cairn.plans.catalog import ORACLES, QUERIES
from cairn.plans.substrate import BASE

from .conftest import SMALL

load()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 8) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    run = oracle.execute(ORACLES[name])
    names = [x[0] for x in run.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in run.fetchall()]
    assert in_order(got) == in_order(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).columns
