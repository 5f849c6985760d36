"""Clinical attribute queries, computed for every study unless the question names one."""

from __future__ import annotations

from cohortwise.operators import clinical
from cohortwise.registry import Query

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUM = f"case when regexp_matches(attribute_value, '{NUMBER}') then try_cast(trim(attribute_value) as double) end"
STUDY = "cancer_study_identifier"

PEOPLE = f"""
  select {STUDY}, patient_unique_id,
    max(attribute_value) filter (attribute_name = 'SEX') as sex,
    max({NUM}) filter (attribute_name = 'AGE') as age,
    max({NUM}) filter (attribute_name = 'OS_MONTHS') as os_months,
    max(attribute_value) filter (attribute_name = 'OS_STATUS') as os_status
  from clinical_data_derived"""


def units(condition: str, columns: str = "sample_unique_id, patient_unique_id") -> str:
    return f"select distinct {STUDY}, {columns} from clinical_data_derived where {condition}"


CRITERIA = {"SAMPLE_TYPE": "Primary", "CANCER_TYPE": "BUILDING"}
PRIMARY = "attribute_name = 'SAMPLE_TYPE' and attribute_value = 'Primary'"
BUILDING = "attribute_name = 'CANCER_TYPE' and attribute_value = 'BUILDING'"
LONG = ["CANCER_TYPE", "SAMPLE_TYPE", "TMB_NONSYNONYMOUS"]

QUERIES = {
    "c01_clinical_long": Query(
        lambda t: clinical.clinical_long(t, None, LONG),
        f"""select {STUDY}, sample_unique_id, patient_unique_id, attribute_name, attribute_value from clinical_data_derived
            where attribute_name in ('CANCER_TYPE', 'SAMPLE_TYPE', 'TMB_NONSYNONYMOUS')"""),
    "c02_attribute_catalog": Query(
        lambda t: clinical.attribute_catalog(t),
        f"""select s.{STUDY}, m.attr_id, m.description, m.patient_attribute, m.cancer_study_id
            from clinical_attribute_meta m, cancer_study s where s.cancer_study_id = m.cancer_study_id"""),
    "c03_where_attribute": Query(
        lambda t: clinical.where_attribute(t, None, "SAMPLE_TYPE", "primary"),
        units("attribute_name = 'SAMPLE_TYPE' and lower(attribute_value) = 'primary'")),
    "c04_find_attributes": Query(
        lambda t: clinical.find_attributes(t, None, ["purity", "type"], limit=None),
        units("contains(lower(attribute_name), 'purity') or contains(lower(attribute_name), 'type')",
              "attribute_name, attribute_value")),
    "c05_patients_by_type": Query(
        lambda t: clinical.patients_by_type(t, ["NAT1", "NAT2", "NAT7"]),
        f"""select count(distinct patient_unique_id) as patient_count from clinical_data_derived where {STUDY} in
              (select {STUDY} from cancer_study where type_of_cancer_id in ('nat1', 'nat2', 'nat7'))"""),
    "c06_studies_by_type": Query(
        lambda t: clinical.studies_by_type(t, ["NAT1", "NAT2"], ["asia", "nation_2"]),
        f"""select {STUDY}, name, type_of_cancer_id from cancer_study
            where type_of_cancer_id in ('nat1', 'nat2') or contains(lower(name), 'asia') or contains(lower(name), 'nation_2')"""),
    "c07_survival_table": Query(
        lambda t: clinical.survival_table(t),
        f"select {STUDY}, patient_unique_id, os_months, os_status from ({PEOPLE} group by 1, 2)"),
    "c08_median_by_mutation": Query(
        lambda t: clinical.median_by_mutation(t, None, "GENE3"),
        f"""
with mutated as (select distinct {STUDY}, patient_unique_id from genomic_event_derived
  where variant_type = 'mutation' and hugo_gene_symbol = 'GENE3')
select c.{STUDY}, case when m.patient_unique_id is null then 'Wild-type' else 'Mutated' end as group_name,
  median({NUM}) as median_os_months
from clinical_data_derived c left join mutated m on m.{STUDY} = c.{STUDY} and m.patient_unique_id = c.patient_unique_id
where attribute_name = 'OS_MONTHS' group by all"""),
    "c09_samples_any": Query(lambda t: clinical.samples_any(t, None, CRITERIA), units(f"({PRIMARY}) or ({BUILDING})")),
    "c10_samples_all": Query(
        lambda t: clinical.samples_all(t, None, CRITERIA),
        f"{units(PRIMARY)} intersect {units(BUILDING)}"),
    "c11_value_distribution": Query(
        lambda t: clinical.value_distribution(t, None, "SAMPLE_TYPE"),
        f"""select {STUDY}, attribute_value, count(distinct sample_unique_id) as sample_count,
              count(distinct patient_unique_id) as patient_count
            from clinical_data_derived where attribute_name = 'SAMPLE_TYPE' group by all"""),
    "c11_value_distribution_patient_level": Query(
        lambda t: clinical.value_distribution(t, None, "SEX"),
        f"""select {STUDY}, attribute_value, count(distinct nullif(sample_unique_id, '')) as sample_count,
              count(distinct patient_unique_id) as patient_count
            from clinical_data_derived where attribute_name = 'SEX' group by all"""),
    "c12_demographics": Query(
        lambda t: clinical.demographics(t),
        f"""select {STUDY}, sex, count(*) as patient_count, avg(age) as avg_age, min(age) as min_age, max(age) as max_age
            from ({PEOPLE} group by 1, 2) where sex is not null and age is not null group by 1, 2"""),
    "c13_patients_where": Query(
        lambda t: clinical.patients_where(t, None, "Female", 40, 70),
        f"""select {STUDY}, patient_unique_id, sex, age from ({PEOPLE} group by 1, 2)
            where sex = 'Female' and age >= 40 and age <= 70"""),
    "c14_numeric_filter": Query(
        lambda t: clinical.numeric_filter(t, None, "TUMOR_PURITY", ">=", 0.3),
        f"""select distinct {STUDY}, sample_unique_id, patient_unique_id, {NUM} as value from clinical_data_derived
            where attribute_name = 'TUMOR_PURITY' and {NUM} >= 0.3"""),
    "c14_numeric_filter_patient_level": Query(
        lambda t: clinical.numeric_filter(t, None, "AGE", ">", 50),
        f"""select distinct {STUDY}, sample_unique_id, patient_unique_id, {NUM} as value from clinical_data_derived
            where attribute_name = 'AGE' and {NUM} > 50"""),
    "c15_pattern_filter": Query(
        lambda t: clinical.pattern_filter(t, None, "PLATFORM", "%Illumina%"),
        units("attribute_name = 'PLATFORM' and contains(attribute_value, 'Illumina')", "sample_unique_id")),
    "c16_attribute_completeness": Query(
        lambda t: clinical.attribute_completeness(t, "AGE"),
        f"""select {STUDY}, avg({NUM}) as avg_value, count(*) as total_records, count(attribute_value) as non_null_records,
              count({NUM}) as numeric_records from clinical_data_derived where attribute_name = 'AGE' group by 1"""),
    "c17_samples_of_type": Query(lambda t: clinical.samples_of_type(t, None, "Metastasis"),
                                 units("attribute_name = 'SAMPLE_TYPE' and attribute_value = 'Metastasis'")),
    "c17_samples_of_cancer_type": Query(
        lambda t: clinical.samples_of_type(t, None, "BUILDING", "CANCER_TYPE"), units(BUILDING)),
    "c17_count_of_type": Query(
        lambda t: clinical.count_of_type(t, None, "Primary"),
        f"""select {STUDY}, count(distinct sample_unique_id) as samples from clinical_data_derived
            where {PRIMARY} group by 1"""),
    "c18_type_hierarchy": Query(
        lambda t: clinical.type_hierarchy(t),
        f"""select b.{STUDY}, b.attribute_value as broad_cancer_type, d.attribute_value as detailed_cancer_type,
              count(distinct b.sample_unique_id) as sample_count
            from clinical_data_derived b, clinical_data_derived d
            where b.sample_unique_id = d.sample_unique_id and b.{STUDY} = d.{STUDY}
              and b.attribute_name = 'CANCER_TYPE' and d.attribute_name = 'CANCER_TYPE_DETAILED' group by 1, 2, 3"""),
    "c19_exclude_samples": Query(
        lambda t: clinical.exclude_samples(t, None, "SAMPLE_TYPE", ["Metastasis", "Local Recurrence"]),
        f"""{units("sample_unique_id <> ''", "sample_unique_id")} except
            {units("attribute_name = 'SAMPLE_TYPE' and attribute_value in ('Metastasis', 'Local Recurrence')", "sample_unique_id")}"""),
    "c20_with_mutation_data": Query(
        lambda t: clinical.with_mutation_data(t),
        units("sample_unique_id in (select sample_unique_id from genomic_event_derived where variant_type = 'mutation')")),
    "c21_cohort_counts": Query(
        lambda t: clinical.cohort_counts(t),
        f"""select {STUDY}, 'Patient Level' as analysis_level, count(distinct patient_unique_id) as "count"
            from clinical_data_derived group by 1 union all
            select {STUDY}, 'Sample Level', count(distinct sample_unique_id) from clinical_data_derived
            where sample_unique_id <> '' group by 1"""),
    "c22_raw_patient_attr": Query(
        lambda t: clinical.raw_patient_attr(t, None, "SEX"),
        f"""select s.{STUDY}, v.patient_id, v.attr_id, v.attr_value
            from clinical_patient v, patient p, cancer_study s
            where v.attr_id = 'SEX' and p.internal_id = v.patient_id and s.cancer_study_id = p.cancer_study_id"""),
    "c23_raw_sample_attr": Query(
        lambda t: clinical.raw_sample_attr(t, None, "SAMPLE_TYPE"),
        f"""select s.{STUDY}, v.internal_id as sample_id, v.attr_id, v.attr_value
            from clinical_sample v, sample m, patient p, cancer_study s
            where v.attr_id = 'SAMPLE_TYPE' and m.internal_id = v.internal_id and p.internal_id = m.patient_id
              and s.cancer_study_id = p.cancer_study_id"""),
    "c24_study_info": Query(
        lambda t: clinical.study_info(t),
        f"""select s.{STUDY}, s.name as study_name, s.description, count(distinct p.internal_id) as patient_count,
              count(distinct m.internal_id) as sample_count
            from cancer_study s left join patient p on p.cancer_study_id = s.cancer_study_id
              left join sample m on m.patient_id = p.internal_id group by all"""),
    "c25_studies": Query(
        lambda t: clinical.studies(t), f"select {STUDY}, name, description, type_of_cancer_id from cancer_study"),
    "c26_studies_with_all_data": Query(
        lambda t: clinical.studies_with_data(t, ["MUTATION_EXTENDED", "COPY_NUMBER_ALTERATION"]),
        f"""select s.{STUDY}, s.name, s.type_of_cancer_id, 2::bigint as matched_profile_count from cancer_study s
            where exists (from genetic_profile p where p.cancer_study_id = s.cancer_study_id and genetic_alteration_type = 'MUTATION_EXTENDED')
              and exists (from genetic_profile p where p.cancer_study_id = s.cancer_study_id and genetic_alteration_type = 'COPY_NUMBER_ALTERATION')"""),
    "c26_studies_with_any_data": Query(
        lambda t: clinical.studies_with_data(t, ["MRNA_EXPRESSION", "STRUCTURAL_VARIANT"], need=1),
        f"""select {STUDY}, s.name, type_of_cancer_id, count(distinct genetic_alteration_type) as matched_profile_count
            from cancer_study s join genetic_profile p using (cancer_study_id)
            where genetic_alteration_type in ('MRNA_EXPRESSION', 'STRUCTURAL_VARIANT') group by all"""),
    "c27_study_samples": Query(lambda t: clinical.study_samples(t), units("sample_unique_id <> ''")),
    "c28_events_with_clinical": Query(
        lambda t: clinical.events_with_clinical(t),
        f"""select e.{STUDY}, e.sample_unique_id, hugo_gene_symbol, variant_type, mutation_variant, mutation_type,
              attribute_name, attribute_value
            from genomic_event_derived e join clinical_data_derived c
              on c.sample_unique_id = e.sample_unique_id and c.{STUDY} = e.{STUDY}"""),
    "c29_followup_summary": Query(
        lambda t: clinical.followup_summary(t),
        f"""select {STUDY}, count(*) as patients, count(*) filter (os_status = '1:DECEASED') as deceased,
              count(*) filter (os_status = '0:LIVING') as living, min(os_months) as min_months, max(os_months) as max_months
            from ({PEOPLE} where attribute_name like 'OS%' group by 1, 2) group by 1"""),
}
