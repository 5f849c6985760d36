"""The cohort recipes as SQL views and table functions, for use from `spark.sql`.

    register_views(t)
    spark.sql("select * from gene_mutation_frequency_by_cancer_type(preference => 'p', gene => 'TP53')")
"""

from __future__ import annotations

TABLES = (
    "cancer_study", "patient", "sample", "gene", "gene_panel", "gene_panel_list", "sample_to_gene_panel_derived",
    "genomic_event_derived", "clinical_data_derived", "cancer_study_query_preferences",
    "genetic_alteration_derived",
)

PANEL_COVERAGE = """
select s.sample_unique_id, s.cancer_study_identifier, g.hugo_gene_symbol, s.gene_panel_id, s.alteration_type
from sample_to_gene_panel_derived s
  join gene_panel p on p.stable_id = s.gene_panel_id
  join gene_panel_list l using (internal_id)
  join gene g on g.entrez_gene_id = l.gene_id
"""

VIEWS = {
    "panel_gene_coverage": PANEL_COVERAGE,
    "panel_genes": """
select p.stable_id as gene_panel_id, g.hugo_gene_symbol
from gene_panel p join gene_panel_list l using (internal_id) join gene g on g.entrez_gene_id = l.gene_id
""",
    "mutation_panel_gene_coverage": """
select sample_unique_id, cancer_study_identifier, hugo_gene_symbol, gene_panel_id
from panel_gene_coverage where alteration_type = 'MUTATION_EXTENDED'
""",
    "mutation_wes_coverage": """
select sample_unique_id, cancer_study_identifier
from sample_to_gene_panel_derived where alteration_type = 'MUTATION_EXTENDED' and gene_panel_id = 'WES'
""",
}

ROWS = "cancer_type string, altered_samples bigint, profiled_samples bigint, frequency_pct double"


# How a recipe limits a table to its studies: (extra CTE, join, condition). A parameter can
# be used in the WHERE of a CTE but not in a subquery below it, hence the semi join.
SCOPES = {
    "preference": (
        "cohort as (select distinct cancer_study_identifier from cancer_study_query_preferences "
        "where preference_name = preference),",
        "left semi join cohort using (cancer_study_identifier)",
        "true",
    ),
    "study": ("", "", "cancer_study_identifier = study"),
    "studies": ("", "", "array_contains(studies, cancer_study_identifier)"),
}


def _frequency(scope: str, altered: str, kind: str) -> str:
    """Frequency per cancer type over the studies of a scope."""
    cohort, join, condition = SCOPES[scope]
    return f"""
with {cohort}
typed as (
  select distinct sample_unique_id, attribute_value as cancer_type from clinical_data_derived {join}
  where attribute_name = 'CANCER_TYPE' and {condition}
), covered as (
  select sample_unique_id from panel_gene_coverage {join}
  where hugo_gene_symbol = gene and alteration_type = {kind} and {condition}
  union
  select sample_unique_id from sample_to_gene_panel_derived {join}
  where gene_panel_id = 'WES' and alteration_type = {kind} and {condition}
), hit as (
  select distinct sample_unique_id from genomic_event_derived {join}
  where hugo_gene_symbol = gene and off_panel = 0 and {condition} and {altered}
), altered as (
  select cancer_type, count(*) as n from hit join typed using (sample_unique_id) group by cancer_type
), profiled as (
  select cancer_type, count(*) as n from covered join typed using (sample_unique_id) group by cancer_type
)
select cancer_type, altered.n, profiled.n, bround(altered.n * 100e0 / profiled.n, 1)
from altered join profiled using (cancer_type) where profiled.n >= 50
"""


MUTATED = "variant_type = 'mutation' and mutation_status <> 'UNCALLED'"
BY_TOKEN = """(
  case alteration
    when 'mutation' then variant_type = 'mutation' and mutation_status <> 'UNCALLED'
    when 'amplification' then variant_type = 'cna' and cna_alteration = 2
    when 'deep_deletion' then variant_type = 'cna' and cna_alteration = -2
    when 'structural_variant' then variant_type = 'structural_variant'
    else false end)"""
KIND_OF_TOKEN = """case alteration when 'mutation' then 'MUTATION_EXTENDED' when 'amplification' then 'COPY_NUMBER_ALTERATION'
    when 'deep_deletion' then 'COPY_NUMBER_ALTERATION' when 'structural_variant' then 'STRUCTURAL_VARIANT' end"""

TOP_GENES = f"""
with {SCOPES["preference"][0]}
altered as (
  select hugo_gene_symbol, count(distinct sample_unique_id) as altered_samples, count(*) as total_mutation_events
  from genomic_event_derived left semi join cohort using (cancer_study_identifier)
  where {MUTATED} and off_panel = 0 group by hugo_gene_symbol
), sets as (
  select panels, count(*) as units from (
    select sample_unique_id, array_sort(collect_set(gene_panel_id)) as panels
    from sample_to_gene_panel_derived left semi join cohort using (cancer_study_identifier)
    where alteration_type = 'MUTATION_EXTENDED' and sample_unique_id is not null group by sample_unique_id)
  group by panels
), listed as (
  select panels, units, explode(panels) as gene_panel_id from sets
), panel as (
  -- samples are counted per set of panels, and only the few sets meet the genes
  select hugo_gene_symbol, sum(units) as n
  from (select distinct panels, units, hugo_gene_symbol from listed join panel_genes using (gene_panel_id))
  group by hugo_gene_symbol
), exome as (
  select count(distinct sample_unique_id) as n
  from mutation_wes_coverage left semi join cohort using (cancer_study_identifier)
), counted as (
  -- the exome samples are a row of their own, which every gene sees through the window
  select is_gene, hugo_gene_symbol, sum(altered) as altered_samples, sum(events) as total_mutation_events,
    sum(panel_samples) + max(sum(exome_samples)) over () as profiled_samples
  from (
    select true as is_gene, hugo_gene_symbol, altered_samples as altered, total_mutation_events as events, 0 as panel_samples, 0 as exome_samples from altered
    union all select true, hugo_gene_symbol, 0, 0, n, 0 from panel
    union all select false, null, 0, 0, 0, n from exome)
  group by is_gene, hugo_gene_symbol
), placed as (
  select *, row_number() over (order by altered_samples desc, hugo_gene_symbol) as place from counted
  where is_gene and altered_samples > 0
)
select hugo_gene_symbol, altered_samples, profiled_samples,
  bround(altered_samples * 100e0 / nullif(profiled_samples, 0), 1), total_mutation_events
from placed where place <= top_n
"""

# Mean ranks of both sides come from counts per distinct value: summed per slice of the value
# range, then inside the slice, so that no single task orders all values.
COEXPRESSION = """
with valued as (
  select sample_unique_id, hugo_gene_symbol, try_cast(alteration_value as double) as v
  from genetic_alteration_derived d
  where d.cancer_study_identifier = study and d.profile_type = gene_pair_coexpression.profile_type
    and translate(alteration_value, 'dDfFxX', '') = alteration_value
    and abs(try_cast(alteration_value as double)) < double('infinity')
), first as (select sample_unique_id, v as a from valued where hugo_gene_symbol = gene_a),
second as (select sample_unique_id, v as b from valued where hugo_gene_symbol = gene_b),
counted as (select a, b, count(*) as n from first join second using (sample_unique_id) group by a, b),
sides as (
  select side, v, sum(n) as n, floor(signum(v) * log1p(abs(v)) * 64 * 1024) as slice
  from (select n, stack(2, 'a', a, 'b', b) as (side, v) from counted) group by side, v
), bases as (
  select side, slice, sum(sum(n)) over (partition by side order by slice) - sum(n) as base from sides group by side, slice
), ranks as (
  select s.side, s.v, b.base + sum(s.n) over (partition by s.side, s.slice order by s.v) - (s.n - 1) / 2e0 as r
  from sides s join bases b on b.side = s.side and b.slice = s.slice
), sums as (
  select sum(n) as n, sum(n * x.r) as sx, sum(n * y.r) as sy, sum(n * x.r * y.r) as sxy, sum(n * x.r * x.r) as sxx,
    sum(n * y.r * y.r) as syy
  from counted c join ranks x on x.side = 'a' and x.v = c.a join ranks y on y.side = 'b' and y.v = c.b
)
select gene_a, gene_b, profile_type, case when n >= 3 then try_divide(sxy - sx * sy / n, sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))) end,
  coalesce(n, 0)
from sums
"""

FUNCTIONS = {
    "gene_mutation_frequency_by_cancer_type": (
        "preference string, gene string", ROWS, _frequency("preference", MUTATED, "'MUTATION_EXTENDED'")),
    "gene_mutation_frequency_in_study": (
        "study string, gene string", ROWS, _frequency("study", MUTATED, "'MUTATION_EXTENDED'")),
    "gene_mutation_frequency_in_studies": (
        "studies array<string>, gene string", ROWS, _frequency("studies", MUTATED, "'MUTATION_EXTENDED'")),
    "gene_alteration_frequency_by_cancer_type": (
        "preference string, gene string, alteration string", ROWS, _frequency("preference", BY_TOKEN, KIND_OF_TOKEN)),
    "top_mutated_genes_in_cohort": (
        "preference string, top_n int",
        "hugo_gene_symbol string, altered_samples bigint, profiled_samples bigint, frequency_pct double, "
        "total_mutation_events bigint",
        TOP_GENES),
    "gene_pair_coexpression": (
        "study string, gene_a string, gene_b string, profile_type string",
        "gene_a string, gene_b string, profile_type string, spearman_correlation double, num_samples bigint",
        COEXPRESSION),
}


def register_views(t) -> None:
    """Temporary views for the tables and coverage, and a temporary table function per recipe."""
    spark = t.spark
    for name in TABLES:
        getattr(t, name).createOrReplaceTempView(name)
    for name, text in VIEWS.items():
        spark.sql(f"create or replace temporary view {name} as {text}")
    for name, (parameters, rows, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table ({rows}) return {body}")
