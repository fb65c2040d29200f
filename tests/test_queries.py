"""Every registered query against its SQL on whole tables, and the shape of its plan."""

import os

import duckdb
import pytest

from skyqueries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def _sorted_rows(rows, columns):
    order = [columns.index(name) for name in sorted(columns)]
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
    found = _sorted_rows([tuple(row) for row in result.collect()], result.columns)
    assert name in ORACLES
    cursor = duck.execute(ORACLES[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert found == _sorted_rows(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
