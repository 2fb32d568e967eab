"""Every registered query against its SQL twin in DuckDB on the smallest folder."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from lakeledger.plans import ORACLES, QUERIES
from lakeledger.plans.registry import BASE

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_names_and_twins():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [q for q in QUERIES if "pipeline" in q or q.startswith("op")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.columns, rows) == table(cols, r.fetchall())


def test_entry(spark):
    assert {"dataset", "anomaly_type", "deviation"} <= set(entry.entry(spark).columns)
