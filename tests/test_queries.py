"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from bidlake import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, decimal.Decimal):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(plain, x)) + "]"
    return repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.limit(1).count() == 1 and df.columns


def test_entry_module_lists_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert catalog.FLAGSHIP in QUERIES
