"""Every query with SQL, against DuckDB on the same tables; every other one runs."""

import datetime
import decimal
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return str(v.date())
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([plain(r[i]) for i in order] for r in rows)


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        from purseflow.plans import registry

        metafunc.parametrize("name", registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_query(spark, duck, name):
    from purseflow.plans import registry

    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
