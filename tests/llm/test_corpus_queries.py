from pathlib import Path

import duckdb
import pytest

from strandwork.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table[c].to_pylist() for c in names)))), names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got, names = rows(QUERIES[name](spark, FOLDER).toArrow())
    if name in SQL:
        con = duckdb.connect()
        for path in Path(FOLDER).glob("*.parquet"):
            con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
        assert (got, names) == rows(con.sql(SQL[name]).to_arrow_table())
    assert len(got) == len(set(got))
