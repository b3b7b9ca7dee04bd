"""Every corpus query that has SQL agrees with DuckDB on the smallest tables, and those that SQL expresses in part have a companion."""

import duckdb
import pytest

from terrane.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cur.fetchall())
