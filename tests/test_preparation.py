from __future__ import annotations

import json

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F
from tiny import tiny

from cohortwise.sources import adhoc, prep, sqlviews, taxonomy
from cohortwise.sources.tables import Tables, load, project


def test_adhoc_select_takes_queries_only(spark):
    t = tiny(spark)
    got = adhoc.select(t, "with s as (select * from cancer_study) select name from s where type_of_cancer_id = :code order by name;",
                       {"code": "bb"}, ["cancer_study"])
    assert [r[0] for r in got.collect()] == ["No rows", "Study B"]
    for statement in ("drop view cancer_study", "create table x as select 1", "insert into cancer_study values (1)",
                      "select 1) ; drop view cancer_study --", "set spark.sql.ansi.enabled = false"):
        assert "error_message" in adhoc.run_select(t, statement, tables=["cancer_study"])
    assert spark.table("cancer_study").count() == 3


def test_sparse_rows_keep_zero_and_false(spark):
    df = spark.createDataFrame([("a", "", 0, False, None), (None, "b", None, True, 1.5)], "s string, t string, n int, f boolean, d double")
    got = [json.loads(r[0]) for r in adhoc.run_select(Tables.of(spark, v=df), "select * from v", tables=["v"])["rows"].collect()]
    assert got == [{"s": "a", "n": 0, "f": False}, {"t": "b", "f": True, "d": 1.5}]


def test_columns(spark):
    t = tiny(spark)
    sample = prep.comment_columns(t.sample, prep.COMMENTS["sample"])
    assert sample.schema["patient_id"].metadata["comment"].startswith("The sample's patient")
    assert prep.drop_columns(sample, "nothing").columns == sample.columns
    listed = {r.name: r.comment for r in prep.column_comments(prep.comment_columns(t.cancer_study, prep.COMMENTS["cancer_study"])).collect()}
    assert listed["name"] and listed["description"] is None


def test_comments_survive_storage(spark, tmp_path):
    t = tiny(spark).replace(sample=prep.comment_columns(tiny(spark).sample, prep.COMMENTS["sample"]))
    prep.write(t, str(tmp_path), ["sample", "genomic_event_derived"])
    back = load(spark, str(tmp_path))
    assert back.sample.schema["internal_id"].metadata["comment"] == "Key of the sample."
    assert rows(back.genomic_event_derived, *t.genomic_event_derived.columns) == rows(t.genomic_event_derived)


def test_cohorts_exist_only_for_known_studies(spark):
    t = tiny(spark)
    assert rows(prep.cohort_by_pattern(t, "p", "%_tcga_pan_can_atlas_2018"), "cancer_study_identifier") == [("a_tcga_pan_can_atlas_2018",)]
    # `_` stands for any character
    assert rows(prep.cohort_by_pattern(t, "p", "_.2020".replace(".", "_")), "cancer_study_identifier") == [("b_2020",)]
    assert rows(prep.cohort_by_rows(t, [("x", "b_2020", "n"), ("x", "gone", "n")])) == [("x", "b_2020", "n")]
    assert rows(prep.cohort_by_ids(t, "y", ["b_2020", "b_2020", "gone"])) == [("y", "b_2020", "curated set")]


def test_prepare_orders_steps(spark):
    done = []

    def step(name):
        def run(t):
            done.append(name)
            return t.sample.withColumn("last", F.lit(name))
        return (name, "sample", run)

    t = prep.prepare(tiny(spark), [step(n) for n in ("portal/0-x", "10-b", "2-a", "portal/1-y", "0-c")])
    assert done == ["0-c", "2-a", "10-b", "portal/0-x", "portal/1-y"]
    assert t.sample.select("last").first()[0] == "portal/1-y"


RECORDS = [
    {"code": "LUAD", "name": "Lung Adenocarcinoma", "mainType": "NSCLC", "tissue": "", "parent": "NSCLC", "level": 3,
     "revocations": ["OLD"], "precursors": [], "color": "Gray"},
    {"code": "BB", "name": "Type B", "mainType": "B", "tissue": "Blood", "parent": None, "level": 1, "revocations": []},
]


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps(RECORDS, indent=1))
    got = taxonomy.read_taxonomy(spark, str(path)).collect()
    assert [r.code for r in got] == ["BB", "LUAD"]
    assert got[1].tissue is None and got[1].revocations == ["OLD"] and got[1].precursors is None and got[0].revocations is None


def test_enrichment_sets_supplied_fields_only(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps(RECORDS))
    types = spark.createDataFrame([("luad", "old", "kept"), ("zz", "none", "kept")], "type_of_cancer_id string, name string, tissue string")
    got = {r.type_of_cancer_id: r for r in prep.enrich_cancer_types(types, taxonomy.read_taxonomy(spark, str(path))).collect()}
    assert (got["luad"].main_type, got["luad"].tissue, got["luad"].level, got["luad"].revocations) == ("NSCLC", "kept", 3, ["OLD"])
    assert (got["zz"].main_type, got["zz"].tissue, got["zz"].level) == (None, "kept", None)


def test_sql_table_functions_agree_with_the_operators(spark, tables):
    from cohortwise.operators import expression, frequency

    sqlviews.register_views(tables)
    pairs = [
        ("gene_mutation_frequency_in_study(study => 'nation_1_msk_2024', gene => 'GENE3')",
         frequency.gene_mutation_frequency_in_study(tables, "nation_1_msk_2024", "GENE3")),
        ("gene_mutation_frequency_in_studies(array('nation_1_msk_2024', 'nation_2_msk_2024'), 'GENE3')",
         frequency.gene_mutation_frequency_in_studies(tables, ["nation_1_msk_2024", "nation_2_msk_2024"], "GENE3")),
        ("gene_alteration_frequency_by_cancer_type('pan_cancer_tcga', 'GENE3', 'deep_deletion')",
         frequency.gene_alteration_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE3", "deep_deletion")),
        ("top_mutated_genes_in_cohort(preference => 'pan_cancer_tcga', top_n => 7)",
         frequency.top_mutated_genes_in_cohort(tables, "pan_cancer_tcga", 7)),
    ]
    for call, df in pairs:
        assert rows(spark.sql(f"select * from {call}")) == rows(df)
    got = spark.sql("select * from gene_pair_coexpression('expr_study', 'GENE1', 'GENE2', 'mrna')").first()
    want = expression.gene_pair_coexpression(tables, "expr_study", "GENE1", "GENE2", "mrna").first()
    assert got.num_samples == want.num_samples == 425
    assert got.spearman_correlation == pytest.approx(want.spearman_correlation) == pytest.approx(-0.001831968, abs=1e-9)
    none = spark.sql("select * from gene_pair_coexpression('expr_study', 'GENE1', 'NONE', 'mrna')").first()
    assert tuple(none) == ("GENE1", "NONE", "mrna", None, 0)


def test_errors_in_rows_are_messages(spark):
    t = Tables.of(spark, v=spark.createDataFrame([("1",), ("x",)], "s string"))
    assert "CAST_INVALID_INPUT" in adhoc.run_select(t, "select cast(s as int) as n from v", tables=["v"])["error_message"]


def test_folder_values_stay_texts(spark, tmp_path):
    cohorts = spark.createDataFrame([("007", "a", "x"), ("2024", "b", "y")], "preference_name string, cancer_study_identifier string, notes string")
    prep.write(Tables.of(spark, cancer_study_query_preferences=cohorts), str(tmp_path), ["cancer_study_query_preferences"])
    back = load(spark, str(tmp_path)).cancer_study_query_preferences
    assert back.schema["preference_name"].dataType.simpleString() == "string"
    assert rows(back, *cohorts.columns) == rows(cohorts)


def test_folder_values_come_back_as_written(spark, tmp_path):
    values = ["", None, "=", "=x", "007", "1.50", "a/b c", "__HIVE_DEFAULT_PARTITION__", "x"]
    frame = spark.createDataFrame([(i, v, "n") for i, v in enumerate(values)], "i int, preference_name string, notes string")
    path = str(tmp_path / "t")
    prep.write_table(frame, path, "cancer_study_query_preferences")
    back = prep.read_table(spark, path, "cancer_study_query_preferences")
    assert {r.i: r.preference_name for r in back.collect()} == dict(enumerate(values))
    one = back.where(F.col("preference_name") == "x")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "preference_name" in filters and one.count() == 1  # folders are still skipped


def test_top_genes_in_sql_count_samples_per_set_of_panels(spark):
    """A sample on several panels counts once per gene, and samples do not meet genes one by one."""
    t = tiny(spark)
    twice = t.sample_to_gene_panel_derived.unionByName(t.sample_to_gene_panel_derived.withColumn("gene_panel_id", F.lit("P2"))).unionByName(
        t.sample_to_gene_panel_derived.limit(1).withColumn("sample_unique_id", F.lit(None).cast("string")))
    sqlviews.register_views(t.replace(sample_to_gene_panel_derived=twice))
    want = {r[0]: r[1] for r in spark.sql(
        "select hugo_gene_symbol, count(distinct sample_unique_id) from mutation_panel_gene_coverage group by 1").collect()}
    exome = spark.sql("select count(distinct sample_unique_id) from mutation_wes_coverage").first()[0]
    spark.sql("create or replace temporary view cancer_study_query_preferences as select 'all' as preference_name, cancer_study_identifier from cancer_study")
    found = spark.sql("select * from top_mutated_genes_in_cohort(preference => 'all', top_n => 50)")
    got = found.collect()
    assert got and all(r.profiled_samples == want.get(r.hugo_gene_symbol, 0) + exome for r in got)
    assert "collect_set(gene_panel_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_stored_files_are_sorted_by_study_gene_and_sample(spark, tmp_path):
    """Inside a folder the rows follow the clustering columns, also where the folder's value is missing or marked."""
    kinds = ["mutation", "cna", None, "", "=x"]
    events = [(f"s{i * 7 % 300:03}", f"study{i * 11 % 4}", f"GENE{i * 13 % 9}", kinds[i % 5]) for i in range(600)]
    frame = spark.createDataFrame(events, "sample_unique_id string, cancer_study_identifier string, hugo_gene_symbol string, variant_type string")
    path = str(tmp_path / "t")
    prep.write_table(frame.repartition(3), path, "genomic_event_derived", 2)
    order = prep.CLUSTERED["genomic_event_derived"]
    files = list((tmp_path / "t").glob("*/*.parquet"))
    assert len(files) >= len(kinds)
    for file in files:
        stored = [tuple(r) for r in spark.read.parquet(str(file)).coalesce(1).select(*order).collect()]
        assert stored == sorted(stored)
    assert rows(prep.read_table(spark, path, "genomic_event_derived"), *frame.columns) == rows(frame)


@pytest.mark.parametrize("name", ["sample_expression"])
def test_rows_of_parents_in_another_form_are_not_stored(spark, tables, name):
    got, want = getattr(tables, name), getattr(project(spark, str(TESTDATA / "sf0.01")), name)
    assert not any(name in file for file in got.inputFiles())
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
