"""Operators that SQL can express against their SQL, and the registration."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_point
from tonetape.llm.oracles import SQL
from tonetape.llm.queries import QUERIES

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, str(FOLDER))
    expected = db.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    rows = sorted(tuple(r[c] for c in columns) for r in found.collect())
    assert rows == sorted(expected.fetchall())
    assert sorted(columns) == sorted(found.columns)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in entry_point.queries()}
    assert "pipeline" in entry_point.queries()
