"""Correlation and group-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions.values import log2p1
from cohortwise.operators import cooccurrence, correlation, expression
from cohortwise.operators.coverage import GENE
from cohortwise.registry import Query
from cohortwise.registry.clinical import NUM
from cohortwise.registry.frequency import CALLED, COVERED, THREE_STUDIES

STUDY = "cancer_study_identifier"
VALUED = "select {study}, sample_unique_id, hugo_gene_symbol as gene, {number} as v from {table} where {number} is not null".format(
    study=STUDY, number=NUM.replace("attribute_value", "alteration_value"), table="{table}")
MRNA = VALUED.format(table="genetic_alteration_derived")
BULK = VALUED.format(table="sample_expression")
ROUND = 9


def spearman_sql(pairs: str, keys: str = "") -> str:
    """Correlation of mean ranks over rows (keys, a, b)."""
    part = f"partition by {keys}" if keys else ""
    both = f"partition by {keys}, " if keys else "partition by "
    head, tail = (f"{keys}, ", f" group by {keys}") if keys else ("", "")
    return f"""
with pairs as ({pairs}),
ranked as (
  select {head}rank() over ({part} order by a) + (count(*) over ({both}a) - 1) / 2e0 as ra,
    rank() over ({part} order by b) + (count(*) over ({both}b) - 1) / 2e0 as rb from pairs)
select {head}round(case when count(*) >= 3 and var_pop(ra) > 0 and var_pop(rb) > 0 then corr(ra, rb) end, {ROUND})
    as spearman_correlation, count(*) as num_samples
from ranked{tail}"""


def genes(table: str, a: str, b: str, extra: str = "true") -> str:
    return f"""select x.v as a, y.v as b from ({table}) x join ({table}) y using ({STUDY}, sample_unique_id)
               where x.gene = '{a}' and y.gene = '{b}' and {extra}"""


def rounded(df):
    return df.withColumn("spearman_correlation", F.round("spearman_correlation", ROUND))


def bulk(t):
    """Tables whose continuous values belong to the samples that have events and attributes."""
    return t.replace(genetic_alteration_derived=t.sample_expression)


TWO_GENES = """select '{a}' as gene_a, '{b}' as gene_b, '{p}' as profile_type, * from ({sql})"""
BURDEN = f"select {STUDY}, sample_unique_id, count(*)::double as v from genomic_event_derived where {CALLED} group by all"
STUDIES = ", ".join(f"'{s}'" for s in THREE_STUDIES)

CELLS = f"""
with units as (
  select study, sample from ({COVERED}) where kind = 'MUTATION_EXTENDED' and gene = 'GENE3' intersect
  select study, sample from ({COVERED}) where kind = 'MUTATION_EXTENDED' and gene = 'GENE9'),
flags as (
  select study, exists (from genomic_event_derived e where e.sample_unique_id = u.sample and {CALLED} and off_panel = 0
      and hugo_gene_symbol = 'GENE3') as a,
    exists (from genomic_event_derived e where e.sample_unique_id = u.sample and {CALLED} and off_panel = 0
      and hugo_gene_symbol = 'GENE9') as b
  from units u)
select study as {STUDY}, count(*) filter (a and b) as "both", count(*) filter (a and not b) as a_only,
  count(*) filter (b and not a) as b_only, count(*) filter (not a and not b) as neither
from flags group by 1"""

#: All pairs of genes: cells by a join of each sample's genes, the exact test as a sum over tables with the same margins.
SCAN = f"""
with covered as materialized (select study, sample, gene from ({COVERED}) where kind = 'MUTATION_EXTENDED'),
hits as materialized (
  select distinct c.study, c.sample, c.gene from covered c join genomic_event_derived e
    on e.cancer_study_identifier = c.study and e.sample_unique_id = c.sample and e.hugo_gene_symbol = c.gene
  where {CALLED} and off_panel = 0),
flags as (select c.*, h.gene is not null as hit from covered c left join hits h using (study, sample, gene) where (study, gene) in (select study, gene from hits)),
cells as (
  select a.study, a.gene as gene_a, b.gene as gene_b, count(*) filter (a.hit and b.hit) as "both", count(*) filter (a.hit and not b.hit) as a_only,
    count(*) filter (b.hit and not a.hit) as b_only, count(*) filter (not a.hit and not b.hit) as neither
  from flags a join flags b on a.study = b.study and a.sample = b.sample and a.gene < b.gene group by 1, 2, 3),
shapes as (select distinct "both" as a, a_only as b, b_only as c, neither as d from cells),
terms as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from shapes),
weights as (
  select *, -(lgamma(x + 1.0) + lgamma(a + b - x + 1.0) + lgamma(a + c - x + 1.0) + lgamma(d - a + x + 1.0)) as w,
    -(lgamma(a + 1.0) + lgamma(b + 1.0) + lgamma(c + 1.0) + lgamma(d + 1.0)) as own from terms),
scaled as (select *, exp(w - max(w) over (partition by a, b, c, d)) as p from weights),
tests as (select a, b, c, d, round(least(1, sum(p) filter (w <= own + 1e-7) / sum(p)), 12) as p_value from scaled group by 1, 2, 3, 4),
ranked as (
  select *, rank() over (partition by study order by p_value) + count(*) over (partition by study, p_value) - 1 as upto,
    count(*) over (partition by study) as m
  from cells join tests on (a, b, c, d) = ("both", a_only, b_only, neither))
select study as {STUDY}, gene_a, gene_b, "both", a_only, b_only, neither,
  round(ln(("both" + 0.5) * (neither + 0.5) / ((a_only + 0.5) * (b_only + 0.5))), 6) as log_odds_ratio, round(p_value, 6) as p_value,
  round(least(1, min(p_value * m / upto) over (partition by study order by p_value desc range unbounded preceding)), 6) as q_value
from ranked"""

#: Values that are missing for some genes and samples, in several patterns.
SPARSE = "not (hugo_gene_symbol like '%7' and sample_unique_id like '%3') and not (hugo_gene_symbol like 'GENE2%' and sample_unique_id like '%1%')"


def sparse(t):
    return t.replace(genetic_alteration_derived=t.genetic_alteration_derived.where(SPARSE))


def matrix_sql(condition: str = "true") -> str:
    values = f"select * from ({MRNA}) where {condition.replace('hugo_gene_symbol', 'gene')}"
    return spearman_sql(
        f"""select x.{STUDY}, x.gene as gene_a, y.gene as gene_b, x.v as a, y.v as b from ({values}) x join ({values}) y
            using ({STUDY}, sample_unique_id) where x.gene < y.gene""", f"{STUDY}, gene_a, gene_b")


GROUPED = f"""
  select g.{STUDY}, g.attribute_value as group_value, n.v from clinical_data_derived g
  join (select sample_unique_id, {NUM} as v from clinical_data_derived where attribute_name = 'TMB_NONSYNONYMOUS') n
    on n.sample_unique_id = g.sample_unique_id
  where g.attribute_name = 'SAMPLE_TYPE' and n.v is not null"""

QUERIES = {
    "x01_profile_types": Query(
        lambda t: expression.profile_types(t), f"select distinct {STUDY}, profile_type from genetic_alteration_derived"),
    "x02_gene_values": Query(
        lambda t: expression.gene_values(t, None, "mrna").withColumnRenamed(GENE, "gene"), MRNA),
    "x03_gene_pair_coexpression": Query(
        lambda t: rounded(expression.gene_pair_coexpression(t, "expr_study", "GENE1", "GENE2", "mrna")),
        TWO_GENES.format(a="GENE1", b="GENE2", p="mrna", sql=spearman_sql(genes(MRNA, "GENE1", "GENE2")))),
    "x03_too_few_pairs_is_null": Query(
        lambda t: rounded(expression.gene_pair_coexpression(t, "expr_study", "GENE1", "NO_SUCH_GENE", "mrna")),
        TWO_GENES.format(a="GENE1", b="NO_SUCH_GENE", p="mrna", sql=spearman_sql(genes(MRNA, "GENE1", "NO_SUCH_GENE")))),
    "x04_attribute_coexpression": Query(
        lambda t: rounded(expression.attribute_coexpression(bulk(t), None, "mrna_median_Zscores", "TMB_NONSYNONYMOUS")),
        spearman_sql(
            f"""select {STUDY}, gene as hugo_gene_symbol, c.v as a, x.v as b from ({BULK}) x join
                (select {STUDY}, sample_unique_id, {NUM} as v from clinical_data_derived where attribute_name = 'TMB_NONSYNONYMOUS') c
                using ({STUDY}, sample_unique_id) where c.v is not null""", f"{STUDY}, hugo_gene_symbol")),
    "x04_attribute_coexpression_on_samples": Query(
        lambda t: rounded(expression.attribute_coexpression(
            bulk(t), None, "mrna_median_Zscores", "TUMOR_PURITY", "GENE3",
            t.clinical_data_derived.where("attribute_name = 'SAMPLE_TYPE' and attribute_value = 'Primary'"))),
        spearman_sql(
            f"""select {STUDY}, gene as hugo_gene_symbol, c.v as a, x.v as b from ({BULK}) x join
                (select {STUDY}, sample_unique_id, {NUM} as v from clinical_data_derived where attribute_name = 'TUMOR_PURITY') c
                using ({STUDY}, sample_unique_id) where gene = 'GENE3' and sample_unique_id in (select sample_unique_id
                  from clinical_data_derived where attribute_name = 'SAMPLE_TYPE' and attribute_value = 'Primary')""",
            f"{STUDY}, hugo_gene_symbol")),
    "x05_tmb_expression": Query(
        lambda t: rounded(expression.tmb_expression(bulk(t), None, "mrna_median_Zscores")),
        spearman_sql(
            f"""select {STUDY}, gene as hugo_gene_symbol, m.v as a, x.v as b from ({BULK}) x
                join ({BURDEN}) m using ({STUDY}, sample_unique_id)""", f"{STUDY}, hugo_gene_symbol")),
    "x06_coexpression_scan": Query(
        lambda t: rounded(expression.coexpression_scan(t, None, "GENE1", "mrna")),
        spearman_sql(
            f"""select {STUDY}, y.gene as hugo_gene_symbol, x.v as a, y.v as b from ({MRNA}) x join ({MRNA}) y
                using ({STUDY}, sample_unique_id) where x.gene = 'GENE1' and y.gene <> 'GENE1'""",
            f"{STUDY}, hugo_gene_symbol")),
    "x06_correlation_matrix": Query(lambda t: rounded(correlation.correlation_matrix(t, None, "mrna")), matrix_sql()),
    "x06_correlation_matrix_with_gaps": Query(lambda t: rounded(correlation.correlation_matrix(sparse(t), None, "mrna")), matrix_sql(SPARSE)),
    "x07_cooccurrence": Query(lambda t: expression.cooccurrence(t, None, "GENE3", "GENE9"), CELLS),
    "x07_cooccurrence_scan": Query(
        lambda t: cooccurrence.cooccurrence_scan(t).withColumns({c: F.round(c, 6) for c in ("log_odds_ratio", "p_value", "q_value")}), SCAN),
    "x08_contingency": Query(
        lambda t: expression.contingency(t, None, "GENE3"),
        f"""
with hits as (select sample_unique_id from genomic_event_derived where {CALLED} and off_panel = 0 and hugo_gene_symbol = 'GENE3')
select study as {STUDY}, count(*) filter (sample in (from hits)) as altered, count(*) filter (sample not in (from hits)) as unaltered
from ({COVERED}) where kind = 'MUTATION_EXTENDED' and gene = 'GENE3' group by 1"""),
    "x08_contingency_over_event_samples": Query(
        lambda t: expression.contingency(t, None, "GENE3", literal=True),
        f"""
with hits as (select sample_unique_id from genomic_event_derived where off_panel = 0 and variant_type = 'mutation'
  and mutation_status <> 'GERMLINE' and hugo_gene_symbol = 'GENE3')
select {STUDY}, count(distinct sample_unique_id) filter (sample_unique_id in (from hits)) as altered,
  count(distinct sample_unique_id) filter (sample_unique_id not in (from hits)) as unaltered
from genomic_event_derived where off_panel = 0 group by 1"""),
    "x09_group_stats": Query(
        lambda t: expression.group_stats(t, None, "TMB_NONSYNONYMOUS", "SAMPLE_TYPE"),
        f"select {STUDY}, group_value, count(*) as n, avg(v) as mean, median(v) as median from ({GROUPED}) group by 1, 2"),
    "x10_log2p1": Query(
        lambda t: expression.gene_values(bulk(t), None, "mrna_median_Zscores").select(
            "sample_unique_id", GENE, F.round(log2p1(F.col("v")), ROUND).alias("log_value")),
        f"select sample_unique_id, gene as hugo_gene_symbol, round(log2(v + 1), {ROUND}) as log_value from ({BULK})"),
    "x11_resolve_gene": Query(
        lambda t: expression.resolve_gene(t, "gene1"),
        """select hugo_gene_symbol, entrez_gene_id, hugo_gene_symbol = 'GENE1' as exact from gene
           where hugo_gene_symbol like 'GENE1%' order by exact desc, hugo_gene_symbol limit 50"""),
    "x12_pooled_coexpression": Query(
        lambda t: rounded(expression.pooled_coexpression(bulk(t), THREE_STUDIES, "mrna_median_Zscores", "GENE3", "GENE9")),
        f"""select 'GENE3' as gene_a, 'GENE9' as gene_b, * from ({spearman_sql(genes(
            BULK, "GENE3", "GENE9", f"x.{STUDY} in ({STUDIES})"))})"""),
    "x12_pooled_needs_every_study": Query(
        lambda t: rounded(expression.pooled_coexpression(
            bulk(t), [*THREE_STUDIES, "no_such_study"], "mrna_median_Zscores", "GENE3", "GENE9")),
        f"select 'GENE3' as gene_a, 'GENE9' as gene_b, * from ({spearman_sql(genes(BULK, 'GENE3', 'GENE9', 'false'))})"),
    "x13_profile_families": Query(
        lambda t: expression.profile_families(
            t.replace(genetic_alteration_derived=t.genetic_alteration_derived.unionByName(t.sample_expression))),
        f"""select {STUDY}, profile_type, count(*) as "rows",
              case when starts_with(profile_type, 'mrna') then 'mRNA expression' end as family
            from (from genetic_alteration_derived union all by name from sample_expression) group by all"""),
}
