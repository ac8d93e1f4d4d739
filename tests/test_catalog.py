"""Every registered query against its SQL counterpart, on the smallest tables."""

import os

import pytest

import __spark_entry__ as registry

DATA = registry.SMOKE_DIR
QUERIES, SQL = registry.queries(), registry.oracle_sql()
# Whole streams; their ticks are checked one by one in test_online.
SLOW = {"online_stream", "online_tick_totals", "online_partitioned", "streaming_kmeans"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted([tuple(row[i] for i in order) for row in rows], key=repr),
    )


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in SLOW])
def test_query_without_sql_runs(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


def test_entry(spark):
    assert registry.entry(spark).columns == ["tc", "h", "pos", "c0", "c1"]
