"""Every query of this package with SQL gives what the SQL gives."""

import collections
import pathlib

import duckdb
import pytest

from ticketloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for f in pathlib.Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    q = c.execute(ORACLES[name])
    columns = [d[0] for d in q.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    ours = collections.Counter(tuple(r[x] for x in columns) for r in df.collect())
    assert ours == collections.Counter(q.fetchall())
