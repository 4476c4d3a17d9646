"""Every pN_ query over tables with nulls in any column, empty, repeated and very long rows, clashing columns, and no rows."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexmill.llm.queries import QUERIES

SOURCE = "/root/testdata/sf0.001"
USED = ("books", "chapters", "glossary", "documents", "bench_items", "bins")
CLASHES = ("h", "n", "rep", "pos", "part", "kind", "term", "site", "text_", "lang", "token", "key", "block", "size", "t")
TEXT = {"chapters": ("content_source", "content_target"), "documents": ("text",), "bench_items": ("passage",)}


def _awkward(name: str, table: pa.Table) -> pa.Table:
    rows = table.slice(0, 40).to_pylist()
    extra = []
    for k, column in enumerate(table.column_names):
        extra.append({**rows[k % len(rows)], column: None})
        if pa.types.is_string(table.schema.field(column).type):
            extra.append({**rows[(k + 1) % len(rows)], column: ""})
    for column in TEXT.get(name, ()):
        extra.append({**rows[0], column: " \n　\n​"})
        extra.append({**rows[1], column: "很長的一行，沒有盡頭" * 30_000})
        extra.append({**rows[2], column: "a\n" * 50_000 + "The end. 😀".encode("utf-16", "surrogatepass").decode("utf-16")})
    extra.append(dict.fromkeys(table.column_names))
    out = table.to_pylist() + extra + rows[:5]
    made = pa.Table.from_pylist(out, schema=table.schema)
    for c in CLASHES:
        if c not in made.column_names:
            made = made.append_column(c, pa.array(["x"] * made.num_rows))
    return made


def _write(folder, change):
    for path in glob.glob(f"{SOURCE}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name in USED:
            pq.write_table(change(name, pq.read_table(path)), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("awkward"), _awkward)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("empty"), lambda name, table: table.slice(0, 0))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows(spark, awkward, name):
    found = QUERIES[name](spark, awkward)
    rows = found.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows}), "a set: no repeated rows"
        assert not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
