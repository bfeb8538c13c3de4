"""Every registered query against its SQL on the smallest driver tables, and its plan."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = pathlib.Path("/root/testdata/sf0.001")
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, str(FOLDER))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in PYTHON + CROSS if node in plan]
    expected = tables.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert by_name(found.columns, found.collect()) == by_name(columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["hash_split", "rf_importances", "rf_predictions"])
def test_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
