"""Queries with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from lexmill.llm.queries import QUERIES
from lexmill.llm.sql import SQL
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name]).df()
    assert rows(got.select(*sorted(got.columns))) == {tuple(v if isinstance(v, str) else int(v) for v in r) for r in want[sorted(want.columns)].itertuples(index=False)}
