"""Coverage, frequency and event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortwise.operators import coverage, cube, events, frequency
from cohortwise.registry import Query
from cohortwise.session import shared_dir

PANEL_GENES = """
  select gp.stable_id as panel, g.hugo_gene_symbol as gene
  from gene_panel gp, gene_panel_list l, gene g where l.internal_id = gp.internal_id and l.gene_id = g.entrez_gene_id"""

# (study, sample, gene) pairs a sample is profiled for, by alteration type
COVERED = f"""
  select distinct c.cancer_study_identifier as study, c.sample_unique_id as sample, c.alteration_type as kind, pg.gene
  from sample_to_gene_panel_derived c join ({PANEL_GENES}) pg on pg.panel = c.gene_panel_id
  union
  select c.cancer_study_identifier, c.sample_unique_id, c.alteration_type, g.hugo_gene_symbol
  from sample_to_gene_panel_derived c, gene g where c.gene_panel_id = 'WES'"""

TYPED = """
  select distinct cancer_study_identifier as study, sample_unique_id as sample, attribute_value as cancer_type
  from clinical_data_derived where attribute_name = 'CANCER_TYPE' and sample_unique_id <> ''"""

HITS = {
    "mutation": ("MUTATION_EXTENDED", "variant_type = 'mutation' and mutation_status <> 'UNCALLED'"),
    "amplification": ("COPY_NUMBER_ALTERATION", "variant_type = 'cna' and cna_alteration = 2"),
    "deep_deletion": ("COPY_NUMBER_ALTERATION", "variant_type = 'cna' and cna_alteration = -2"),
    "structural_variant": ("STRUCTURAL_VARIANT", "variant_type = 'structural_variant'"),
}


def frequency_sql(alteration: str = "mutation", studies: str = "true", per_study: bool = False, minimum: int = 50,
                  outer: bool = False) -> str:
    kind, condition = HITS[alteration]
    keys = "study, cancer_type, gene" if per_study else "cancer_type, gene"
    out = ("study as cancer_study_identifier, " if per_study else "") + "cancer_type, gene as hugo_gene_symbol"
    return f"""
with typed as ({TYPED}),
pairs as (select * from ({COVERED}) where kind = '{kind}' and {studies}),
hits as (
  select distinct cancer_study_identifier as study, sample_unique_id as sample, hugo_gene_symbol as gene
  from genomic_event_derived where {condition} and off_panel = 0),
altered as (
  select {keys}, count(distinct sample) as altered_samples from hits join typed using (study, sample)
  where {studies} group by {keys}),
profiled as (
  select {keys}, count(distinct sample) as profiled_samples from pairs join typed using (study, sample) group by {keys})
select {out}, coalesce(altered_samples, 0) as altered_samples, profiled_samples,
  round_even(coalesce(altered_samples, 0) * 100e0 / profiled_samples, 1) as frequency_pct
from profiled {"left" if outer else "inner"} join altered using ({keys}) where profiled_samples >= {minimum}"""


def preference(name: str) -> str:
    return f"study in (select cancer_study_identifier from cancer_study_query_preferences where preference_name = '{name}')"


def one_gene(sql: str, gene: str) -> str:
    head, body = sql.split("with typed as", 1)
    return f"with all_rows as (with typed as{body}) select * exclude (hugo_gene_symbol) from all_rows where hugo_gene_symbol = '{gene}'"


THREE_STUDIES = ["nation_1_msk_2024", "nation_2_msk_2024", "nation_3_tcga_pan_can_atlas_2018"]
EVERY = "all_studies_non_redundant"
TCGA = "pan_cancer_tcga"
CALLED = "variant_type = 'mutation' and mutation_status <> 'UNCALLED'"

PATIENTS = """
  select distinct cancer_study_identifier as study, sample_unique_id as sample, patient_unique_id as patient
  from clinical_data_derived where sample_unique_id <> ''"""

PATIENT_SQL = f"""
with pairs as (select * from ({COVERED}) where kind = 'MUTATION_EXTENDED'),
people as ({PATIENTS}),
hits as (
  select distinct cancer_study_identifier as study, sample_unique_id as sample, hugo_gene_symbol as gene
  from genomic_event_derived where {CALLED} and off_panel = 0),
counted as (
  select study, gene, count(distinct patient) as profiled_patients,
    count(distinct case when h.sample is not null then patient end) as altered_patients
  from pairs join people using (study, sample)
    left join hits h using (study, sample, gene)
  group by study, gene)"""


def _with_drivers(t):
    driver = F.when(F.col("mutation_type").isin("Nonsense_Mutation", "Missense_Mutation"), "Putative_Driver")
    return t.replace(genomic_event_derived=t.genomic_event_derived.withColumn("driver_filter", driver))


def from_cube(t):
    """Every cohort from the stored counts, after one study's have been made anew."""
    path = f"{shared_dir(t.spark)}/cohortwise/cubes/{uuid.uuid4().hex}"
    cube.refresh(t, path)
    cube.refresh(t, path, [THREE_STUDIES[0]])
    return cube.frequencies(t, path)


def every_cohort() -> str:
    return f"""
with typed as ({TYPED}),
cohorts as (select distinct preference_name, cancer_study_identifier as study from cancer_study_query_preferences),
hits as (
  select distinct cancer_study_identifier as study, sample_unique_id as sample, hugo_gene_symbol as gene
  from genomic_event_derived where {HITS["mutation"][1]} and off_panel = 0),
altered as (
  select preference_name, cancer_type, gene, count(distinct sample) as altered_samples
  from hits join typed using (study, sample) join cohorts using (study) group by 1, 2, 3),
profiled as (
  select preference_name, cancer_type, gene, count(distinct sample) as profiled_samples
  from (select * from ({COVERED}) where kind = 'MUTATION_EXTENDED') join typed using (study, sample) join cohorts using (study) group by 1, 2, 3)
select preference_name, cancer_type, gene as hugo_gene_symbol, altered_samples, profiled_samples,
  round_even(altered_samples * 100e0 / profiled_samples, 1) as frequency_pct
from altered join profiled using (preference_name, cancer_type, gene) where profiled_samples >= 50"""


QUERIES = {
    "f01_panel_gene_coverage": Query(
        lambda t: coverage.panel_gene_coverage(t),
        f"""select c.sample_unique_id, c.cancer_study_identifier, pg.gene as hugo_gene_symbol, c.gene_panel_id
            from sample_to_gene_panel_derived c join ({PANEL_GENES}) pg on pg.panel = c.gene_panel_id
            where c.alteration_type = 'MUTATION_EXTENDED'"""),
    "f02_wes_coverage": Query(
        lambda t: coverage.wes_coverage(t),
        """select sample_unique_id, cancer_study_identifier from sample_to_gene_panel_derived
           where alteration_type = 'MUTATION_EXTENDED' and gene_panel_id = 'WES'"""),
    "f03_profiled_samples": Query(
        lambda t: coverage.profiled_samples(t, "GENE3"),
        f"""select c.sample_unique_id, c.cancer_study_identifier from sample_to_gene_panel_derived c
            where c.alteration_type = 'MUTATION_EXTENDED'
              and (c.gene_panel_id = 'WES' or c.gene_panel_id in (select panel from ({PANEL_GENES}) where gene = 'GENE3'))"""),
    "f04_gene_mutation_frequency_by_cancer_type": Query(
        lambda t: frequency.gene_mutation_frequency_by_cancer_type(t, TCGA, "GENE3"),
        one_gene(frequency_sql(studies=preference(TCGA)), "GENE3")),
    "f04_mutation_frequency_by_cancer_type_all_genes": Query(
        lambda t: frequency.gene_mutation_frequency_by_cancer_type(t, EVERY), frequency_sql(studies=preference(EVERY))),
    "f04_mutation_frequency_with_unaltered_types": Query(
        lambda t: frequency.gene_mutation_frequency_by_cancer_type(t, EVERY, "GENE3", include_zero=True, min_profiled=0),
        one_gene(frequency_sql(studies=preference(EVERY), minimum=0, outer=True), "GENE3")),
    "f04_contributing_studies": Query(
        lambda t: frequency.contributing_studies(t, EVERY),
        f"""select cancer_type, count(distinct study) as studies from ({TYPED}) where {preference(EVERY)} group by cancer_type"""),
    "f05_gene_mutation_frequency_in_study": Query(
        lambda t: frequency.gene_mutation_frequency_in_study(t, "nation_1_msk_2024", "GENE3"),
        one_gene(frequency_sql(studies="study = 'nation_1_msk_2024'"), "GENE3")),
    "f05_mutation_frequency_in_every_study": Query(
        lambda t: frequency.gene_mutation_frequency_in_study(t, None, min_profiled=20),
        frequency_sql(per_study=True, minimum=20)),
    "f06_gene_mutation_frequency_in_studies": Query(
        lambda t: frequency.gene_mutation_frequency_in_studies(t, THREE_STUDIES),
        frequency_sql(studies="study in ({})".format(", ".join(f"'{s}'" for s in THREE_STUDIES)))),
    **{
        f"f07_{alteration}_frequency_by_cancer_type": Query(
            lambda t, a=alteration: frequency.gene_alteration_frequency_by_cancer_type(t, EVERY, None, a),
            frequency_sql(alteration, preference(EVERY)))
        for alteration in HITS
    },
    "f08_top_mutated_genes_in_cohort": Query(
        lambda t: frequency.top_mutated_genes_in_cohort(t, TCGA, 20),
        f"""
with chosen as (select * from sample_to_gene_panel_derived
    where alteration_type = 'MUTATION_EXTENDED' and {preference(TCGA).replace('study in', 'cancer_study_identifier in')}),
altered as (
  select hugo_gene_symbol, count(distinct sample_unique_id) as altered_samples, count(*) as total_mutation_events
  from genomic_event_derived where {CALLED} and off_panel = 0
    and {preference(TCGA).replace('study in', 'cancer_study_identifier in')} group by all),
named as (select gene, count(distinct sample_unique_id) as n from chosen join ({PANEL_GENES}) on panel = gene_panel_id group by gene),
counted as (select a.*, coalesce(n, 0) + (select count(distinct sample_unique_id) from chosen where gene_panel_id = 'WES') as profiled_samples
  from altered a left join named on gene = hugo_gene_symbol)
select *, round_even(altered_samples * 100e0 / profiled_samples, 1) as frequency_pct from counted
order by altered_samples desc, hugo_gene_symbol limit 20"""),
    "f09_altered_counts": Query(
        lambda t: frequency.altered_counts(t, pooled=True),
        f"""select hugo_gene_symbol, entrez_gene_id, count(distinct sample_unique_id) as altered_samples,
              count(distinct sample_unique_id) filter (off_panel = 0) as altered_samples_on_panel, count(*) as total_mutation_events
            from genomic_event_derived where {CALLED} group by all"""),
    "f10_profiled_count": Query(
        lambda t: frequency.profiled_count(t, "GENE3"),
        f"""select study as cancer_study_identifier, count(distinct sample) as profiled_samples from ({COVERED})
            where kind = 'MUTATION_EXTENDED' and gene = 'GENE3' group by study"""),
    "f10_profiled_count_panels_only": Query(
        lambda t: frequency.profiled_count(t, "GENE3", wes_aware=False),
        f"""select cancer_study_identifier, count(distinct sample_unique_id) as profiled_samples from sample_to_gene_panel_derived
            where alteration_type = 'MUTATION_EXTENDED' and gene_panel_id in (select panel from ({PANEL_GENES}) where gene = 'GENE3')
            group by cancer_study_identifier"""),
    "f11_profiled_count_wes_study": Query(
        lambda t: frequency.profiled_count_wes_study(t),
        """select cancer_study_identifier, count(distinct sample_unique_id) as profiled_samples from sample_to_gene_panel_derived
           where alteration_type = 'MUTATION_EXTENDED' group by cancer_study_identifier"""),
    **{
        f"f12_study_gene_frequency{suffix}": Query(
            lambda t, w=wes: frequency.study_gene_frequency(t, wes_aware=w),
            f"""
with denominators as (
  select study, gene, count(distinct sample) as profiled_samples from ({COVERED if wes else COVERED.split("union")[0]})
  where kind = 'MUTATION_EXTENDED' group by all),
numerators as (
  select cancer_study_identifier as study, hugo_gene_symbol as gene, count(*) as mutations,
    count(distinct case when off_panel = 0 then sample_unique_id end) as altered_samples
  from genomic_event_derived where {CALLED} group by all)
select study as cancer_study_identifier, gene as hugo_gene_symbol, mutations, altered_samples, profiled_samples,
  round_even(altered_samples * 100e0 / profiled_samples, 1) as sample_frequency_percent
from numerators join denominators using (study, gene)""")
        for suffix, wes in (("", True), ("_panels_only", False))
    },
    "f13_top_genes_per_cancer_type": Query(
        lambda t: frequency.top_genes_per_cancer_type(t, EVERY, 5),
        f"""with f as ({frequency_sql(studies=preference(EVERY))}) select * from f
            qualify row_number() over (partition by cancer_type order by altered_samples desc, hugo_gene_symbol) <= 5"""),
    "f14_frequency_compare": Query(
        lambda t: frequency.frequency_compare(t, EVERY, ("BUILDING", "MACHINERY")),
        f"""with f as ({frequency_sql(studies=preference(EVERY))})
            select hugo_gene_symbol, {", ".join(
                f"max({column}) filter (cancer_type = '{cancer}') as {side}_{short}"
                for side, cancer in (("first", "BUILDING"), ("second", "MACHINERY"))
                for column, short in (("altered_samples", "altered"), ("profiled_samples", "profiled"), ("frequency_pct", "pct")))}
            from f where cancer_type in ('BUILDING', 'MACHINERY') group by hugo_gene_symbol"""),
    "f15_patient_frequency": Query(
        lambda t: frequency.patient_frequency(t, gene="GENE3"),
        f"""{PATIENT_SQL} select study as cancer_study_identifier, altered_patients, profiled_patients,
              round_even(altered_patients * 100e0 / profiled_patients, 1) as patient_frequency_pct from counted where gene = 'GENE3'"""),
    "f15_patient_frequency_all_genes": Query(
        lambda t: frequency.patient_frequency(t),
        f"""{PATIENT_SQL} select study as cancer_study_identifier, gene as hugo_gene_symbol, altered_patients, profiled_patients,
              round_even(altered_patients * 100e0 / profiled_patients, 1) as patient_frequency_pct
            from counted where altered_patients > 0"""),
    "f16_cna_gene_counts": Query(
        lambda t: events.cna_gene_counts(t, level=2),
        """select cancer_study_identifier, hugo_gene_symbol, count(distinct sample_unique_id) as samples
           from genomic_event_derived where variant_type = 'cna' and cna_alteration = 2 group by all"""),
    "f17_gene_variants": Query(
        lambda t: events.gene_variants(t, None, "GENE3"),
        """select cancer_study_identifier, sample_unique_id, hugo_gene_symbol, mutation_variant, mutation_type
           from genomic_event_derived where variant_type = 'mutation' and hugo_gene_symbol = 'GENE3'"""),
    "f18_variant_samples": Query(
        lambda t: events.variant_samples(t, None, "GENE3", "p.V6E"),
        """select distinct cancer_study_identifier, sample_unique_id, patient_unique_id from genomic_event_derived
           where variant_type = 'mutation' and hugo_gene_symbol = 'GENE3' and mutation_variant = 'p.V6E'"""),
    "f19_mutation_class_counts": Query(
        lambda t: events.mutation_class_counts(t),
        """
with classes as (
  select unnest(['missense', 'nonsense', 'synonymous', 'splice', 'frameshift', 'frameshift', 'inframe_indel', 'inframe_indel',
    'truncating', 'truncating', 'truncating', 'truncating', 'truncating', 'point_mutation', 'point_mutation', 'point_mutation',
    'point_mutation']) as mutation_class,
  unnest(['Missense_Mutation', 'Nonsense_Mutation', 'Silent', 'Splice_Site', 'Frame_Shift_Ins', 'Frame_Shift_Del', 'In_Frame_Ins',
    'In_Frame_Del', 'Nonsense_Mutation', 'Frame_Shift_Ins', 'Frame_Shift_Del', 'Splice_Site', 'Nonstop_Mutation',
    'Missense_Mutation', 'Nonsense_Mutation', 'Silent', 'Splice_Site']) as mutation_type)
select cancer_study_identifier, mutation_class, count(*) as events, count(distinct sample_unique_id) as samples
from genomic_event_derived join classes using (mutation_type) where variant_type = 'mutation' group by all"""),
    "f20_promoter_profiles": Query(
        lambda t: events.promoter_profiles(t, term="structural"),
        """select cancer_study_identifier, p.name as profile_name, genetic_alteration_type, datatype
           from genetic_profile p join cancer_study s using (cancer_study_id) where contains(lower(p.name), 'structural')"""),
    "f21_driver_events": Query(
        lambda t: events.driver_events(_with_drivers(t), None),
        """select cancer_study_identifier, sample_unique_id, hugo_gene_symbol, mutation_variant, 'Putative_Driver' as driver_filter
           from genomic_event_derived
           where variant_type = 'mutation' and mutation_type in ('Nonsense_Mutation', 'Missense_Mutation')"""),
    "f22_assert_frequency": Query(
        lambda t: frequency.assert_frequency(frequency.gene_mutation_frequency_by_cancer_type(t, EVERY)),
        frequency_sql(studies=preference(EVERY))),
    "f23_preference_summary": Query(
        lambda t: frequency.preference_summary(t),
        """select preference_name, count(*) as studies, min(notes) as note from cancer_study_query_preferences group by 1"""),
    "f24_event_counts_on_panel": Query(
        lambda t: events.event_counts(t, on_panel=True),
        "select cancer_study_identifier, count(*) as events from genomic_event_derived where off_panel = 0 group by 1"),
    "f24_event_counts_called": Query(
        lambda t: events.event_counts(t, called=True),
        f"select cancer_study_identifier, count(*) as events from genomic_event_derived where {CALLED} group by 1"),
    "f24_event_counts_per_gene": Query(
        lambda t: events.event_counts(t, per_gene=True, pooled=True),
        "select hugo_gene_symbol, count(*) as events from genomic_event_derived group by 1"),
    "f25_cna_level_counts": Query(
        lambda t: events.cna_level_counts(t),
        """select cancer_study_identifier, cna_alteration, count(*) as events, count(distinct sample_unique_id) as samples,
             case cna_alteration when -2 then 'Deep Deletion' when -1 then 'Shallow Deletion' when 0 then 'Diploid'
               when 1 then 'Gain' else 'Amplification' end as label
           from genomic_event_derived where cna_alteration is not null group by all"""),
    "f04_frequency_cube_of_every_cohort": Query(from_cube, every_cohort()),
}
