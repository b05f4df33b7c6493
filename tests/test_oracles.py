"""Every registered query against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LEXILOOM_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
NAMES = sorted(entry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
