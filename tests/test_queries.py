"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from loomwork.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    described = db.execute("describe " + ORACLE_SQL[name]).fetchall()
    assert sorted(df.columns) == sorted(r[0] for r in described)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: names[t] for c, t in df.dtypes} == {r[0]: r[1] for r in described}
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(db.execute(ORACLE_SQL[name]).fetchall(), [r[0] for r in described])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
