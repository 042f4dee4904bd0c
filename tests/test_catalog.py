"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from tidegate.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{os.path.join(data, 'events.parquet')}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        r = db.execute(sql)
        names = [d[0] for d in r.description]
        assert got == sorted(str(tuple(row[names.index(c)] for c in columns)) for row in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
