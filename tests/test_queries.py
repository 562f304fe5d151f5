import importlib
import sys
from pathlib import Path

import duckdb
import pytest

from strandwork.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table[c].to_pylist() for c in names)))), names


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_its_sql(spark, con, name):
    got, names = rows(QUERIES[name](spark, FOLDER).toArrow())
    if name in SQL:
        assert (got, names) == rows(con.sql(SQL[name]).to_arrow_table())


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_core_does_without_the_optional_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("strandwork.llm")] + ["strandwork.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
