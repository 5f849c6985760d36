"""Group-comparison statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions.values import log2p1
from cohortwise.operators import clinical, expression, frequency, stats
from cohortwise.registry import Query
from cohortwise.registry.clinical import PEOPLE
from cohortwise.registry.expression import BULK, GROUPED, ROUND, bulk

STUDY = "cancer_study_identifier"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def group_rows(t):
    return expression.attribute_groups(t, None, "TMB_NONSYNONYMOUS", "SAMPLE_TYPE")[0]


def logged(t):
    values = expression.gene_values(bulk(t), None, "mrna_median_Zscores").withColumn("v", log2p1(F.col("v")))
    types = t.clinical_data_derived.where("attribute_name = 'SAMPLE_TYPE'")
    return values.join(
        types.select(STUDY, "sample_unique_id", F.col("attribute_value").alias("group_value")), [STUDY, "sample_unique_id"])


LOGGED = f"""
  select x.{STUDY}, x.gene, g.attribute_value as group_value, log2(x.v + 1) as v from ({BULK}) x
  join clinical_data_derived g on g.sample_unique_id = x.sample_unique_id and g.attribute_name = 'SAMPLE_TYPE'"""


def two_by_two(t):
    """Altered and unaltered samples of every gene in two cancer types."""
    wide = frequency.frequency_compare(t, "all_studies_non_redundant", ("BUILDING", "MACHINERY"))
    return wide.select(
        "hugo_gene_symbol",
        F.col("first_altered").alias("a"), (F.col("first_profiled") - F.col("first_altered")).alias("b"),
        F.col("second_altered").alias("c"), (F.col("second_profiled") - F.col("second_altered")).alias("d"),
    ).dropna()


def corrected(t):
    """One number in [0, 1] per study, type and gene, corrected over all of them together."""
    tests = frequency.gene_mutation_frequency_in_study(t, None, min_profiled=0)
    tests = tests.withColumn("p_value", F.col("altered_samples") / (F.col("profiled_samples") + F.lit(1)))
    tests = tests.select(STUDY, "cancer_type", "hugo_gene_symbol", "p_value")
    return rounded(stats.benjamini_hochberg(tests, []), "q_value", "p_value")


def survival(t):
    people = clinical.survival_table(t)
    return people.withColumn("event", F.col("os_status").startswith("1:"))


RANKED = f"""
with g as ({GROUPED}),
ranked as (select {STUDY}, group_value, v, rank() over (partition by {STUDY} order by v)
  + (count(*) over (partition by {STUDY}, v) - 1) / 2e0 as r, count(*) over (partition by {STUDY}) as total from g),
ties as (select {STUDY}, sum(n * n * n - n) as tie_sum from (select {STUDY}, v, count(*)::double as n from g group by 1, 2) group by 1),
sums as (select {STUDY}, group_value, count(*) as n, sum(r) as rank_sum, any_value(total) as total from ranked group by 1, 2)"""

TESTS = """
with p as (select *, altered_samples / (profiled_samples + 1) as p_value from ({frequency})),
ranked as (select *, rank() over (order by p_value) + count(*) over (partition by p_value) - 1 as upto, count(*) over () as m from p)
select cancer_study_identifier, cancer_type, hugo_gene_symbol, round(p_value, 6) as p_value,
  round(least(1, min(p_value * m / upto) over (order by p_value desc range unbounded preceding)), 6) as q_value
from ranked"""


def _tests() -> str:
    from cohortwise.registry.frequency import frequency_sql

    return TESTS.replace("{frequency}", frequency_sql(per_study=True, minimum=0))


def _fisher() -> str:
    """The exact test as a sum over all tables with the same margins."""
    from cohortwise.registry.frequency import QUERIES as FREQUENCY

    def log_weight(x: str) -> str:
        cells = (x, f"(a + b - {x})", f"(a + c - {x})", f"(d - a + {x})")
        return "-(" + " + ".join(f"lgamma({cell} + 1.0)" for cell in cells) + ")"

    return f"""
with compared as ({FREQUENCY["f14_frequency_compare"].sql}),
cells as (
  select hugo_gene_symbol, first_altered as a, first_profiled - first_altered as b, second_altered as c, second_profiled - second_altered as d
  from compared where first_altered is not null and second_altered is not null),
terms as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from cells),
weights as (select *, {log_weight("x")} as w, {log_weight("a")} as own from terms),
scaled as (select *, exp(w - max(w) over (partition by hugo_gene_symbol)) as p from weights)
select hugo_gene_symbol, a, b, c, d, round(a::double * d / nullif(b::double * c, 0), 6) as odds_ratio,
  round(least(1, sum(p) filter (w <= own + 1e-7) / sum(p)), 6) as p_value
from scaled group by hugo_gene_symbol, a, b, c, d"""


def tail_sql(kind: str, *x: str) -> str:
    """p-value of a statistic by the series of the incomplete gamma or beta function, term by term."""
    if kind == "chi2":
        value, a = f"(({x[0]}) / 2)", f"(({x[1]}) / 2.0)"
        return f"""case when {value} <= 0 then 1 else 1 - list_sum(list_transform(range(0, ({value} + 60 * sqrt({value} + {a}) + 300)::int),
          lambda k: exp(({a} + k) * ln({value}) - {value} - lgamma({a} + k + 1)))) end"""

    def part(y: str, a: str, b: str) -> str:
        return f"""list_sum(list_transform(range(0, 6000), lambda k: exp(
          lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b}) + ({a} + k) * ln({y}) + {b} * ln(1 - {y}))))"""

    a, b, y = (f"({v})" for v in x)
    return f"case when {y} >= 1 then 1 when {y} > 0.5 then 1 - {part(f'(1 - {y})', b, a)} else {part(y, a, b)} end"


def with_p(sql: str, tail: str, *columns: str) -> str:
    """The rows of `sql` with the p-value of their statistic; `columns` are rounded after that."""
    cuts = ", ".join(f"round({c}, 6) as {c}" for c in columns)
    return f"select * replace ({cuts}, round(p_value, 9) as p_value) from (select *, {tail} as p_value from ({sql}))"


def cut(df, *columns):
    """p-values are compared to nine digits, as statistics of the same rows are to six."""
    return rounded(df.withColumn("p_value", F.round("p_value", 9)), *columns)


def mutated_patients(t):
    """(study, gene, patient) with a mutation that counts."""
    return frequency.altered_events(t).select(STUDY, "hugo_gene_symbol", "patient_unique_id").distinct()


def gene_survival(t):
    return stats.log_rank(survival(t), mutated_patients(t), [STUDY], ["hugo_gene_symbol"], "patient_unique_id", "os_months", "event")


QUERIES = {
    "h1_fisher_exact": Query(lambda t: rounded(stats.fisher_exact(two_by_two(t)), "odds_ratio", "p_value"), _fisher()),
    "h2_chi_squared": Query(
        lambda t: cut(
            stats.chi_squared(
                clinical.type_hierarchy(t, None, "CANCER_TYPE", "SAMPLE_TYPE"), [STUDY],
                "broad_cancer_type", "detailed_cancer_type", "sample_count"), "chi2", "min_expected"),
        with_p(f"""
with cells as (
  select b.{STUDY}, b.attribute_value as x, d.attribute_value as y, count(*) as n
  from clinical_data_derived b join clinical_data_derived d on d.sample_unique_id = b.sample_unique_id
  where b.attribute_name = 'CANCER_TYPE' and d.attribute_name = 'SAMPLE_TYPE' group by all),
rows_ as (select {STUDY}, x, sum(n) as nx from cells group by 1, 2),
cols as (select {STUDY}, y, sum(n) as ny from cells group by 1, 2),
totals as (select {STUDY}, sum(nx) as total from rows_ group by 1),
grid as (
  select {STUDY}, x, y, coalesce(n, 0) as n, nx * ny / total as expected
  from rows_ join cols using ({STUDY}) join totals using ({STUDY}) left join cells using ({STUDY}, x, y))
select {STUDY}, sum((n - expected) ** 2 / expected) as chi2,
  (count(distinct x) - 1) * (count(distinct y) - 1) as dof, min(expected) as min_expected from grid group by 1""", tail_sql("chi2", "chi2", "dof"), "chi2", "min_expected")),
    "h3_wilcoxon": Query(
        lambda t: cut(stats.wilcoxon(group_rows(t), [STUDY], "group_value", "v"), "z"),
        with_p(f"""{RANKED}
select {STUDY}, group_value, n::bigint as n, rank_sum, rank_sum - n * (n + 1) / 2e0 as u_statistic,
  (rank_sum - n * (n + 1) / 2e0 - n * (total - n) / 2e0)
    / sqrt(n * (total - n) / 12e0 * ((total + 1) - tie_sum / (total * (total - 1)))) as z
from sums join ties using ({STUDY})""", tail_sql("chi2", "z * z", "1"), "z")),
    "h3_kruskal_wallis": Query(
        lambda t: cut(stats.kruskal_wallis(group_rows(t), [STUDY], "group_value", "v"), "h"),
        with_p(f"""{RANKED}
select {STUDY}, (12 / (any_value(total) * (any_value(total) + 1e0)) * sum(rank_sum * rank_sum / n) - 3 * (any_value(total) + 1))
    / (1 - any_value(tie_sum) / (any_value(total)::double ** 3 - any_value(total))) as h,
  count(*) - 1 as dof, min(n) as min_n
from sums join ties using ({STUDY}) group by 1""", tail_sql("chi2", "h", "dof"), "h")),
    "h4_t_statistic": Query(
        lambda t: cut(stats.t_statistic(
            logged(t), ["hugo_gene_symbol"], "group_value", "v", "Primary", "Metastasis"), "t"),
        with_p(f"""
with m as (select gene, group_value, count(*) as n, avg(v) as mean, var_samp(v) as s2 from ({LOGGED}) group by 1, 2)
select a.gene as hugo_gene_symbol, a.n + b.n - 2 as dof,
  (a.mean - b.mean) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) as t
from m a join m b on b.gene = a.gene where a.group_value = 'Primary' and b.group_value = 'Metastasis'""", tail_sql("beta", "dof / 2.0", "0.5", "dof / (dof + t * t)"), "t")),
    "h4_anova": Query(
        lambda t: cut(stats.anova(logged(t), ["hugo_gene_symbol"], "group_value", "v"), "f"),
        with_p(f"""
with rows_ as ({LOGGED}), grand as (select gene, avg(v) as centre, count(*) as total from rows_ group by 1),
g as (select gene, group_value, avg(v) as mean, count(*) as n from rows_ group by 1, 2),
between_ as (select gene, sum(n * (mean - centre) ** 2) as ss, count(*) as k from g join grand using (gene) group by 1),
within_ as (select gene, sum((v - mean) ** 2) as ss from rows_ join g using (gene, group_value) group by 1)
select gene as hugo_gene_symbol, (b.ss / (k - 1)) / (w.ss / (total - k)) as f, k - 1 as dof_between,
  (total - k)::bigint as dof_within
from between_ b join within_ w using (gene) join grand using (gene)""",
            tail_sql("beta", "dof_within / 2.0", "dof_between / 2.0", "dof_within / (dof_within + dof_between * f)"), "f")),
    # values near a billion, whose spread is a billionth of them
    "h4_anova_of_large_values": Query(
        lambda t: rounded(stats.anova(
            logged(t).withColumn("v", F.floor(F.col("v") * 64) + F.lit(1e9)), ["hugo_gene_symbol"], "group_value", "v").drop("p_value"), "f"),
        f"""
with rows_ as (select gene, group_value, floor(v * 64) as v from ({LOGGED})),
grand as (select gene, avg(v) as centre, count(*) as total from rows_ group by 1),
g as (select gene, group_value, avg(v) as mean, count(*) as n from rows_ group by 1, 2),
between_ as (select gene, sum(n * (mean - centre) ** 2) as ss, count(*) as k from g join grand using (gene) group by 1),
within_ as (select gene, sum((v - mean) ** 2) as ss from rows_ join g using (gene, group_value) group by 1)
select gene as hugo_gene_symbol, round((b.ss / (k - 1)) / (w.ss / (total - k)), 6) as f, k - 1 as dof_between,
  (total - k)::bigint as dof_within
from between_ b join within_ w using (gene) join grand using (gene)"""),
    "h5_benjamini_hochberg": Query(corrected, _tests()),
    "h6_kaplan_meier": Query(
        lambda t: rounded(stats.kaplan_meier(survival(t), [STUDY], "os_months", "event"), "survival"),
        f"""
with p as (select {STUDY}, os_months, (os_status = '1:DECEASED')::int as event from ({PEOPLE} group by 1, 2) where os_months is not null),
times as (select {STUDY}, os_months, count(*) as n, sum(event)::bigint as events from p group by 1, 2),
risk as (select *, sum(n) over (partition by {STUDY} order by os_months desc)::bigint as at_risk from times)
select {STUDY}, os_months, at_risk, events,
  round(product(1 - events / at_risk) over (partition by {STUDY} order by os_months), 6) as survival
from risk where events > 0"""),
    "h6_median_survival": Query(
        lambda t: stats.median_survival(survival(t), [], "os_months", "event"),
        f"""
with p as (select os_months, (os_status = '1:DECEASED')::int as event from ({PEOPLE} group by 1, 2) where os_months is not null),
times as (select os_months, count(*) as n, sum(event) as events from p group by 1),
risk as (select *, sum(n) over (order by os_months desc) as at_risk from times),
curve as (select os_months, product(1 - events / at_risk) over (order by os_months) as survival from risk where events > 0)
select min(os_months) as median_months from curve where survival <= 0.5"""),
    "h7_log_rank_per_gene": Query(
        lambda t: cut(gene_survival(t), "expected", "variance", "chi2"),
        f"""
with p as (
  select {STUDY}, patient_unique_id, os_months as tm, (os_status = '1:DECEASED')::int as event
  from ({PEOPLE} group by 1, 2) where os_months is not null and os_status is not null),
times as (select {STUDY}, tm, count(*) as n, sum(event) as d from p group by 1, 2),
risk as (select *, sum(n) over (partition by {STUDY} order by tm desc) as r from times),
members as (
  select distinct e.{STUDY}, hugo_gene_symbol, p.patient_unique_id, p.tm, p.event
  from genomic_event_derived e join p on p.{STUDY} = e.{STUDY} and p.patient_unique_id = e.patient_unique_id
  where variant_type = 'mutation' and mutation_status != 'UNCALLED' and off_panel = 0),
sets as (
  select m.{STUDY}, hugo_gene_symbol, k.tm, any_value(k.d) as d, any_value(k.r) as r, count(*) as m
  from members m join risk k on k.{STUDY} = m.{STUDY} and k.tm <= m.tm where k.d > 0 group by 1, 2, 3),
sums as (
  select {STUDY}, hugo_gene_symbol, sum(d * m / r) as expected,
    sum(case when r > 1 then d * (m / r) * (1 - m / r) * (r - d) / (r - 1) else 0 end) as variance from sets group by 1, 2),
counts as (select {STUDY}, hugo_gene_symbol, count(*) as members, sum(event)::bigint as observed from members group by 1, 2),
tested as (
  select {STUDY}, hugo_gene_symbol, members, observed, coalesce(expected, 0) as expected, coalesce(variance, 0) as variance,
    case when variance > 1e-9 then (observed - expected) ** 2 / variance end as chi2
  from counts left join sums using ({STUDY}, hugo_gene_symbol))
select {STUDY}, hugo_gene_symbol, members, observed, round(expected, 6) as expected, round(variance, 6) as variance, round(chi2, 6) as chi2,
  round({tail_sql("chi2", "chi2", "1")}, 9) as p_value from tested"""),
}
