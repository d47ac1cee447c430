"""Every query with SQL gives the SQL's rows; every other query runs and is held against plain Python elsewhere."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from gleanery.queries import QUERIES, SQL


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return repr(round(float(v), 9))
    return str(v)[:26].replace("T", " ") if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in columns) for r in got.collect())
    assert a == sorted(tuple(map(norm, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
