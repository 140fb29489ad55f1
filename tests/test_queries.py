"""Registered queries against DuckDB on the smallest tables, where those are at hand."""

import os

import duckdb
import pytest

from xylem import queries as registered

FOLDER = os.environ.get("XYLEM_TABLES", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]
NAMES = sorted(registered.oracle_sql())


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    frame = registered.queries()[name](spark, FOLDER)
    want = sql.sql(registered.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, frame.collect()) == rows(want.columns, want.fetchall())
