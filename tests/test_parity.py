"""Every query with SQL gives what the SQL gives."""

import collections
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [m for m in entry._modules() if ".llm" not in m.__name__]
SQL = {k: s for m in CORE for k, s in getattr(m, "ORACLES", {}).items()}
PLANS = {k: f for m in CORE for k, f in getattr(m, "QUERIES", {}).items()}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    import pathlib

    c = duckdb.connect()
    for f in pathlib.Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = PLANS[name](spark, sf)
    q = duck.execute(SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = collections.Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = collections.Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in q.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "language"


def test_sql_names_are_queries():
    assert set(SQL) <= set(PLANS)
