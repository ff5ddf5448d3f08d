"""Every registered query with SQL equals DuckDB; the others give rows."""

import os

import duckdb
import pytest

from cohortlens.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return "-"
    if isinstance(value, (int, bool)):
        return str(int(value))
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value) + 0.0:.6f}"
    return str(value)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    as_numbers = [[float(x) if x.replace(".", "", 1).lstrip("-").isdigit() else x for x in r] for r in a], [[float(x) if x.replace(".", "", 1).lstrip("-").isdigit() else x for x in r] for r in b]
    assert as_numbers[0] == as_numbers[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
