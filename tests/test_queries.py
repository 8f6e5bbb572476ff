"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from suite import QUERIES
from tools.check_oracles import rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, sql.fetchall())


def test_the_flagship_query_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["party", "name", "nation", "segment"] and df.count() > 0


def test_tasks_are_bounded_where_the_session_does_not_say(spark, monkeypatch):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.getAll.get(k) for k in entry.TASK_BOUNDS}
    monkeypatch.setattr(entry, "_BOUNDED", set())
    try:
        for k in before:
            spark.conf.unset(k)
        spark.conf.set(key, "5m")
        entry._bound_tasks(spark, True)
        assert {k: spark.conf.getAll[k] for k in before} == entry.TASK_BOUNDS | {key: "5m"}
        entry._bound_tasks(spark, False)
        assert [k for k in before if k in spark.conf.getAll] == [key]
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
