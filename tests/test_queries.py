"""Every registered query against its DuckDB text, and what its plan must not contain."""

from __future__ import annotations

import re

import pytest
from compare import compare, connect
from conftest import TESTDATA

import __spark_entry__ as entry
from cohortwise.registry import all_queries

QUERIES, ORACLES = {name: entry.queries()[name] for name in all_queries()}, entry.oracle_sql()
STREAMS = [n for n in QUERIES if n.endswith("_stream")]
SMALL = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    problem, rows, _ = compare(spark, duck, QUERIES[name], ORACLES.get(name), SMALL)
    assert problem is None
    if name not in ORACLES:
        assert rows > 0


def test_entry(spark):
    got = {r.cancer_type: (r.altered_samples, r.profiled_samples) for r in entry.entry(spark).collect()}
    assert got == {"AUTOMOBILE": (3, 119), "BUILDING": (7, 195), "FURNITURE": (4, 251), "HOUSEHOLD": (5, 129), "MACHINERY": (1, 170)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# the p-value of finished 2x2 tables is the one Python function (that of the scan ends before a checkpoint)
PYTHON = {"h1_fisher_exact"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("ArrowEvalPython" in text) == (name in PYTHON)
    assert "BatchEvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["f09_altered_counts", "f12_study_gene_frequency", "c11_value_distribution", "c21_cohort_counts", "k05_study_profile_all"])
def test_two_distinct_counts_expand_no_rows(spark, name):
    assert "Expand" not in plan(QUERIES[name](spark, SMALL))


def test_filters_and_columns_reach_the_scan(spark, tables):
    from cohortwise.operators import frequency

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(frequency.gene_mutation_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE3"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in text.splitlines() if "FileScan" in line and "hugo_gene_symbol" in line and "off_panel" in line)
    assert "EqualTo(hugo_gene_symbol,GENE3)" in scan and "variant_type" in scan
    columns = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "mutation_variant" not in columns and "entrez_gene_id" not in columns


def test_flagship_shuffles_only_samples_and_counts(spark, tables):
    from cohortwise.operators import frequency

    text = plan(frequency.gene_mutation_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE3"))
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert set(keys) <= {"sample_unique_id", "cancer_type", "cancer_study_identifier", "gene_panel_id"}
    # the coverage table is read once for panels and exome together
    assert len(re.findall(r"FileScan parquet \[sample_unique_id#\d+,cancer_study_identifier#\d+,gene_panel_id", text)) == 1
