"""Every registered query runs over the smallest tables; those with an SQL twin give its rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(k for k, f in QUERIES.items() if ".llm." not in f.__module__)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "None" if math.isnan(v) else f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def check(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name in SQL:
        rel = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})")
        assert norm(rows) == norm(rel.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    check(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
