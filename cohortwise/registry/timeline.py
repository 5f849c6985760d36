"""Treatment and timeline queries."""

from __future__ import annotations

from cohortwise.operators import timeline
from cohortwise.registry import Query

STUDY = "cancer_study_identifier"

# every value of a key on a treatment event, with patient and study
GIVEN = f"""
  select s.{STUDY}, e.patient_id, s.{STUDY} || '_' || p.stable_id as patient_unique_id, e.clinical_event_id, e.start_date, d.key, d.value
  from clinical_event e, clinical_event_data d, patient p, cancer_study s
  where d.clinical_event_id = e.clinical_event_id and p.internal_id = e.patient_id
    and s.cancer_study_id = p.cancer_study_id and lower(e.event_type) = 'treatment'"""


def per_value(key: str, value: str, count: str) -> str:
    return f"""select {STUDY}, value as {value}, count(distinct patient_id) as {count}
               from ({GIVEN}) where key = '{key}' group by 1, 2"""


PAIRS = f"""
  select a.{STUDY}, a.value as agent, b.value as subtype, count(distinct a.patient_id) as patients
  from (select * from ({GIVEN}) where key = 'AGENT') a
    %s join (select * from ({GIVEN}) where key = 'SUBTYPE') b on b.clinical_event_id = a.clinical_event_id
  group by 1, 2, 3"""

QUERIES = {
    "t01_event_types": Query(
        lambda t: timeline.event_types(t),
        f"""select s.{STUDY}, e.event_type, count(*) as event_count from clinical_event e, patient p, cancer_study s
            where p.internal_id = e.patient_id and s.cancer_study_id = p.cancer_study_id group by 1, 2"""),
    "t02_treatment_keys": Query(
        lambda t: timeline.treatment_keys(t), f"select {STUDY}, key, count(*) as cnt from ({GIVEN}) group by 1, 2"),
    "t03_top_agents": Query(
        lambda t: timeline.top_agents(t, n=5),
        f"""select * from ({per_value("AGENT", "agent", "patient_count")})
            qualify row_number() over (partition by {STUDY} order by patient_count desc, agent) <= 5"""),
    "t04_agent_subtype": Query(
        lambda t: timeline.agent_subtype(t),
        f"select {STUDY}, agent, subtype as treatment_subtype, patients from ({PAIRS % 'left'})"),
    "t05_treatment_timing": Query(
        lambda t: timeline.treatment_timing(t),
        f"""
with first_day as (select patient_id, min(start_date) as seq from clinical_event where event_type = 'Sequencing' group by 1)
select {STUDY}, case when start_date < seq then 'Before Sequencing' else 'After Sequencing' end as timing, value as treatment,
  count(distinct g.patient_id) as patients
from ({GIVEN}) g join first_day f on f.patient_id = g.patient_id where key = 'AGENT' group by 1, 2, 3"""),
    "t06_treatments_of_mutated": Query(
        lambda t: timeline.treatments_of_mutated(t, None, "GENE3"),
        f"""select {STUDY}, value as treatment, count(distinct patient_id) as treated_patients from ({GIVEN})
            where key = 'AGENT' and patient_unique_id in (select patient_unique_id from genomic_event_derived
              where variant_type = 'mutation' and hugo_gene_symbol = 'GENE3') group by 1, 2"""),
    "t07_treatment_categories": Query(
        lambda t: timeline.treatment_categories(t), per_value("SUBTYPE", "treatment_category", "patient_count")),
    "t08_agents_per_category": Query(
        lambda t: timeline.agents_per_category(t),
        f"select {STUDY}, agent, subtype as category, patients from ({PAIRS % 'inner'})"),
    "t08_top_agents_per_category": Query(
        lambda t: timeline.agents_per_category(t, n=3),
        f"""select {STUDY}, agent, subtype as category, patients from ({PAIRS % 'inner'})
            qualify row_number() over (partition by {STUDY}, category order by patients desc, agent) <= 3"""),
    "t09_agents_in_category": Query(
        lambda t: timeline.agents_in_category(t, None, "Chemo"),
        f"select {STUDY}, agent, patients from ({PAIRS % 'inner'}) where subtype = 'Chemo'"),
}
