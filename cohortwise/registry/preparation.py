"""Loading and preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.registry import Query
from cohortwise.registry.frequency import THREE_STUDIES
from cohortwise.registry.catalog import taxonomy
from cohortwise.session import shared_dir
from cohortwise.sources import adhoc, prep, sqlviews, taxonomy as taxonomy_file
from cohortwise.sources.tables import load

STUDY = "cancer_study_identifier"
IDS = ["nation_1_msk_2024", "nation_2_msk_2024", "nation_2_msk_2024", "no_such_study"]
ROWS = [("large_genomic_cohort", "nation_1_msk_2024", "single study"), ("absent_cohort", "no_such_study", "single study")]

ADHOC = """
with busy as (
  select cancer_study_identifier, count(*) as mutations from genomic_event_derived
  where variant_type = :kind group by cancer_study_identifier)
select s.name, b.mutations from busy b join cancer_study s using (cancer_study_identifier) where b.mutations >= :least"""


def raw_records(t):
    """Taxonomy records as a file would hold them: JSON texts with empty fields and unknown ones."""
    record = F.struct(
        "code", "name", F.col("main_type").alias("mainType"), F.coalesce("tissue", F.lit("")).alias("tissue"),
        F.coalesce("parent", F.lit("")).alias("parent"), "level",
        F.coalesce("revocations", F.array().cast("array<string>")).alias("revocations"),
        F.lit("ignored").alias("color"),
    )
    return taxonomy(t).select(F.to_json(record).alias("json"))


def normalized(t):
    parsed = raw_records(t).select(F.from_json("json", taxonomy_file.SCHEMA).alias("r")).select("r.*")
    out = taxonomy_file.normalize_taxonomy(parsed)
    return out.withColumns({c: F.array_join(c, ",") for c in ("revocations", "precursors")})


def enriched(t):
    types = t.type_of_cancer.withColumn("tissue", F.when(F.col("name").endswith("(retired)"), "kept"))
    out = prep.enrich_cancer_types(types, taxonomy(t))
    return out.withColumns({c: F.array_join(c, ",") for c in ("revocations", "precursors")})


STEPS = [
    ("portal/0-rows", "cancer_study_query_preferences",
     lambda t: prep.preferences(t.cancer_study_query_preferences, prep.cohort_by_rows(t, ROWS), prep.cohort_by_ids(t, "listed", IDS))),
    ("3-pattern", "cancer_study_query_preferences",
     lambda t: prep.cohort_by_pattern(t, "pan_cancer_tcga", "%_tcga_pan_can_atlas_2018")),
    ("0-cleanup", "sample", lambda t: prep.drop_columns(t.sample.withColumn("sample_type", F.lit("x")), "sample_type")),
    ("1-comments", "sample", lambda t: prep.comment_columns(t.sample, prep.COMMENTS["sample"])),
]


def written(t):
    """Event table after a round trip through its stored layout."""
    path = f"{shared_dir(t.spark)}/cohortwise/{t.spark.sparkContext.applicationId}/written"
    prep.write(t, path, ["genomic_event_derived"])
    stored = load(t.spark, path).genomic_event_derived
    return stored.groupBy("variant_type", STUDY).agg(F.count("*").alias("events"), F.sum("off_panel").alias("off_panel"))


def folder_values(t):
    """Cohort names that look like numbers, after a round trip through folders of that name."""
    cohorts = t.nation.join(t.cancer_study, F.col("cancer_study_id") == F.col("n_nationkey")).select(
        (F.lit(2000) + F.col("n_nationkey")).cast("string").alias("preference_name"), STUDY,
        F.concat(F.lit("00"), F.col("n_nationkey").cast("string")).alias("notes"))
    path = f"{shared_dir(t.spark)}/cohortwise/{t.spark.sparkContext.applicationId}/folders"
    prep.write(t.replace(cancer_study_query_preferences=cohorts), path, ["cancer_study_query_preferences"])
    return load(t.spark, path).cancer_study_query_preferences


def by_sql(t):
    sqlviews.register_views(t)
    return t.spark.sql(
        "select * from gene_mutation_frequency_by_cancer_type(preference => 'all_studies_non_redundant', gene => 'GENE3')"
    )


def call(text: str):
    """A recipe through its SQL table function."""

    def run(t):
        sqlviews.register_views(t)
        return t.spark.sql(f"select * from {text}")

    return run


def _queries(module: str, name: str) -> str:
    from importlib import import_module

    return import_module(f"cohortwise.registry.{module}").QUERIES[name].sql


PATTERN = f"""select 'pan_cancer_tcga' as preference_name, {STUDY}, 'pattern-detected' as notes from cancer_study
  where {STUDY} like '%_tcga_pan_can_atlas_2018'"""
LITERAL = f"""select 'large_genomic_cohort' as preference_name, {STUDY}, 'single study' as notes from cancer_study
  where {STUDY} = 'nation_1_msk_2024'"""
LISTED = f"""select 'listed' as preference_name, {STUDY}, 'curated set' as notes from cancer_study
  where {STUDY} in ('nation_1_msk_2024', 'nation_2_msk_2024')"""


def sparse(column: str) -> str:
    return f"case when {column} <> '' then '\"{column}\":\"' || {column} || '\"' end"


SPEARMAN = """
with valued as (
  select sample_unique_id, hugo_gene_symbol as gene, try_cast(alteration_value as double) as v from genetic_alteration_derived
  where cancer_study_identifier = 'expr_study' and profile_type = 'mrna' and hugo_gene_symbol in ('GENE1', 'GENE2')),
pairs as (
  select a.v as a, b.v as b from valued a join valued b using (sample_unique_id)
  where a.gene = 'GENE1' and b.gene = 'GENE2' and a.v is not null and b.v is not null),
ranks as (
  select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2e0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2e0 as rb
  from pairs)
select 'GENE1' as gene_a, 'GENE2' as gene_b, 'mrna' as profile_type, round(corr(ra, rb), 6) as spearman_correlation, count(*) as num_samples from ranks"""


def _frequency_by_sql() -> str:
    from cohortwise.registry.frequency import EVERY, frequency_sql, one_gene, preference

    return one_gene(frequency_sql(studies=preference(EVERY)), "GENE3")


def _one_gene(name: str) -> str:
    from cohortwise.registry.frequency import one_gene

    return one_gene(_queries("frequency", name), "GENE3")


QUERIES = {
    "s01_table_scan": Query(
        lambda t: t.genomic_event_derived.select(STUDY, "sample_unique_id", "hugo_gene_symbol", "variant_type", "cna_alteration"),
        f"select {STUDY}, sample_unique_id, hugo_gene_symbol, variant_type, cna_alteration from genomic_event_derived"),
    "s02_adhoc_select": Query(
        lambda t: adhoc.select(t, ADHOC, {"kind": "mutation", "least": 10}, ["genomic_event_derived", "cancer_study"]),
        """select s.name, count(*) as mutations from genomic_event_derived e join cancer_study s using (cancer_study_identifier)
           where variant_type = 'mutation' group by 1 having count(*) >= 10"""),
    "s02_run_select": Query(
        lambda t: adhoc.run_select(t, ADHOC, {"kind": "mutation", "least": 10}, ["genomic_event_derived", "cancer_study"])["rows"],
        """select '{"name":"' || s.name || '","mutations":' || count(*) || '}' as "row"
           from genomic_event_derived e join cancer_study s using (cancer_study_identifier)
           where variant_type = 'mutation' group by s.name having count(*) >= 10"""),
    "s02_sql_table_function": Query(by_sql, _frequency_by_sql()),
    "s02_sql_frequency_in_study": Query(
        call("gene_mutation_frequency_in_study(study => 'nation_1_msk_2024', gene => 'GENE3')"),
        _queries("frequency", "f05_gene_mutation_frequency_in_study")),
    "s02_sql_frequency_in_studies": Query(
        call("gene_mutation_frequency_in_studies(studies => array({}), gene => 'GENE3')".format(", ".join(f"'{s}'" for s in THREE_STUDIES))),
        _one_gene("f06_gene_mutation_frequency_in_studies")),
    **{
        f"s02_sql_{alteration}_frequency": Query(
            call(f"gene_alteration_frequency_by_cancer_type(preference => 'all_studies_non_redundant', gene => 'GENE3', alteration => '{alteration}')"),
            _one_gene(f"f07_{alteration}_frequency_by_cancer_type"))
        for alteration in ("mutation", "amplification", "deep_deletion", "structural_variant")
    },
    "s02_sql_top_mutated_genes": Query(
        call("top_mutated_genes_in_cohort(preference => 'pan_cancer_tcga', top_n => 20)"),
        _queries("frequency", "f08_top_mutated_genes_in_cohort")),
    "s02_sql_gene_pair_coexpression": Query(
        lambda t: call("gene_pair_coexpression('expr_study', 'GENE1', 'GENE2', 'mrna')")(t).withColumn(
            "spearman_correlation", F.round("spearman_correlation", 6)),
        SPEARMAN),
    "s05_sparse_json": Query(
        lambda t: adhoc.sparse_json(t.clinical_data_derived.select("sample_unique_id", "patient_unique_id", "attribute_name", "attribute_value")),
        f"""select '{{' || concat_ws(',', {", ".join(map(sparse, ("sample_unique_id", "patient_unique_id", "attribute_name", "attribute_value")))}) || '}}' as "row"
            from clinical_data_derived"""),
    "s06_drop_columns": Query(
        lambda t: prep.drop_columns(t.sample.withColumn("sample_type", F.lit("Primary Solid Tumor")), "sample_type", "absent"),
        "select internal_id, stable_id, patient_id from sample"),
    "s07_comment_columns": Query(
        lambda t: prep.column_comments(prep.comment_columns(t.clinical_data_derived, prep.COMMENTS["clinical_data_derived"])),
        " union all ".join(
            "select '{0}' as name, 'string' as type, {1} as comment, count({0}) as present from clinical_data_derived".format(
                c, "'{}'".format(prep.COMMENTS["clinical_data_derived"][c].replace("'", "''"))
                if c in prep.COMMENTS["clinical_data_derived"] else "null::varchar")
            for c in ("sample_unique_id", "patient_unique_id", STUDY, "attribute_name", "attribute_value", "type"))),
    "s08_normalize_taxonomy": Query(
        normalized,
        """select code, name, main_type, tissue, parent, level, nullif(replaced_csv, '') as revocations,
             null::varchar as precursors from oncotree"""),
    "s09_enrich_cancer_types": Query(
        enriched,
        """select type_of_cancer_id, t.name, main_type, coalesce(tissue, case when t.name like '%(retired)' then 'kept' end) as tissue,
             level::smallint as level, nullif(replaced_csv, '') as revocations, null::varchar as precursors
           from type_of_cancer t left join oncotree o on lower(o.code) = type_of_cancer_id"""),
    "s10_cohort_by_pattern": Query(
        lambda t: prep.cohort_by_pattern(t, "pan_cancer_tcga", "%_tcga_pan_can_atlas_2018"), PATTERN),
    "s11_cohort_by_rows": Query(lambda t: prep.cohort_by_rows(t, ROWS), LITERAL),
    "s12_cohort_by_ids": Query(lambda t: prep.cohort_by_ids(t, "listed", IDS), LISTED),
    "s13_preferences": Query(
        lambda t: prep.preferences(
            prep.cohort_by_pattern(t, "pan_cancer_tcga", "%_tcga_pan_can_atlas_2018"),
            prep.cohort_by_rows(t, ROWS), prep.cohort_by_ids(t, "listed", IDS)),
        f"{PATTERN} union all {LITERAL} union all {LISTED}"),
    "s14_prepare": Query(
        lambda t: prep.prepare(t, STEPS).cancer_study_query_preferences, f"{PATTERN} union all {LITERAL} union all {LISTED}"),
    "s15_folder_values_read_back": Query(
        folder_values,
        f"""select (2000 + n_nationkey)::varchar as preference_name, s.{STUDY}, '00' || n_nationkey as notes
            from nation join cancer_study s on s.cancer_study_id = n_nationkey"""),
    "s15_write_and_read_back": Query(
        written,
        f"""select variant_type, {STUDY}, count(*) as events, sum(off_panel)::bigint as off_panel
            from genomic_event_derived group by 1, 2"""),
}
