"""Registered queries of the operators: against DuckDB where there is SQL, and the rules for their plans."""

from __future__ import annotations

import duckdb
import pytest
from compare import compare
from conftest import TESTDATA

import __spark_entry__ as entry
import corpus_pipeline
from cohortwise.llm.queries import QUERIES, SQL

SMALL = str(TESTDATA / "sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    yield con
    con.close()


def test_all_are_registered():
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()
    assert {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")} == set(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    problem, rows, _ = compare(spark, duck, QUERIES[name], SQL[name], SMALL)
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_one_row_per_input_row(spark, name):
    rows = [r[0] for r in QUERIES[name](spark, SMALL).collect()]
    table = "pages" if "html" in name else "documents"
    assert sorted(rows) == sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(f"{'page' if 'html' in name else 'doc'}_id").collect())


def test_byte_strings_like_brute_force(spark):
    import hashlib

    from llm.test_suffixes import brute

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {d: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for (d, _), (n, gone, runs, kept) in brute(rows).items()}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_suffix_array_dedup"](spark, SMALL).collect()} == want
