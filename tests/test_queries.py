"""Every query with SQL against DuckDB on the smallest tables; every query runs."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
CORE, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "<NA>":
        return None
    return round(v, 7) if isinstance(v, float) else v


def _sorted(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted((tuple(map(_plain, r)) for r in pdf.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert _sorted(CORE[name](spark, SF).toPandas()) == _sorted(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_inline_tokens_cover_all_paragraphs(spark, tmp_path):
    texts = [(1, "one **two**\nthree <b>four\n\nfive & six "), (2, "\nonly later"), (3, None), (4, ""), (1, "one **two**\nthree <b>four\n\nfive & six ")]
    spark.createDataFrame(texts, "id long, content_source string").write.parquet(f"{tmp_path}/chapters.parquet")
    got = {r.chapter_id: (r.words, r.chars) for r in CORE["inline_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: (7, 7 + 10 + 10), 2: (2, 10)}
