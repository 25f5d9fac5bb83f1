"""Every query that SQL can express gives the same rows in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    got = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(got, key=lambda r: tuple((v is None, str(v)) for v in r))


def close(a, b):
    return len(a) == len(b) and all(all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 * max(1, abs(x)) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_as_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = table(df.columns, df.collect())
    rel = duck.sql(catalog.oracles()[name])
    want = table(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert close(got[1], want[1]), [(x, y) for x, y in zip(got[1], want[1], strict=False) if x != y][:3]
