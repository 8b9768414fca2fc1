"""Every registered query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from chronomesh.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(found, columns):
    return sorted(str(tuple(r)) for r in found.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, tmp_path, name):
    registry.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    want = tables.sql(registry.ORACLES[name])
    got = tables.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["src_03_single_channel"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
