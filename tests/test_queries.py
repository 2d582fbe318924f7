"""Every registered point-pattern query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from pointloom.plans.queries import QUERIES
from pointloom.plans.sql import SQL

TABLES = ("region", "events", "orders")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    flat = [tuple(round(v, 9) if isinstance(v, float) else v for v in (r[k] for k in order)) for r in rows]
    return sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
