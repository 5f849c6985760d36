"""Clinical attributes in key-value form: filters, pivots, distributions, counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.values import any_of, contains_any, present, to_number
from cohortwise.plans.ranking import median
from cohortwise.plans.scope import STUDY, by_study, distinct_counts

SAMPLE = "sample_unique_id"
PATIENT = "patient_unique_id"
COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def _name() -> Column:
    return F.col("attribute_name")


def _value() -> Column:
    return F.col("attribute_value")


def _attribute(t, study, attribute: str) -> tuple[DataFrame, list[str]]:
    rows, keys = by_study(t.clinical_data_derived, study)
    return rows.where(_name() == attribute), keys


def _units(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return rows.select(*keys, *columns).distinct()


def patient_pivot(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per patient; each column is the maximum of its expression over the patient's rows."""
    return rows.groupBy(*keys, PATIENT).agg(*[F.max(c).alias(name) for name, c in columns.items()])


def value_of(attribute: str) -> Column:
    return F.when(_name() == attribute, _value())


def number_of(attribute: str) -> Column:
    return F.when(_name() == attribute, to_number(_value()))


def clinical_long(t, study: str | None, attributes: list[str]) -> DataFrame:
    """Rows of the named attributes."""
    rows, keys = by_study(t.clinical_data_derived, study)
    return rows.where(_name().isin(attributes)).select(*keys, SAMPLE, PATIENT, "attribute_name", "attribute_value")


def attribute_catalog(t, study: str | None = None) -> DataFrame:
    """Attributes a study has, sample level first."""
    studies, keys = by_study(t.cancer_study, study)
    return (
        t.clinical_attribute_meta.join(studies.select("cancer_study_id", STUDY), "cancer_study_id")
        .select(*keys, "attr_id", "description", "patient_attribute", "cancer_study_id")
        .orderBy(*keys, "patient_attribute", "attr_id")
    )


def where_attribute(t, study: str | None, attribute: str, value: str) -> DataFrame:
    """Samples and patients whose attribute has the value, ignoring case."""
    rows, keys = _attribute(t, study, attribute)
    return _units(rows.where(F.upper(_value()) == value.upper()), keys, SAMPLE, PATIENT)


def find_attributes(t, study: str | None, terms: list[str], limit: int | None = 200) -> DataFrame:
    """Distinct attributes and values whose name has one of the terms."""
    rows, keys = by_study(t.clinical_data_derived, study)
    found = _units(rows.where(contains_any(["attribute_name"], terms)), keys, "attribute_name", "attribute_value")
    found = found.orderBy(*keys, "attribute_name", "attribute_value")
    return found if limit is None else found.limit(limit)


def patients_by_type(t, codes: list[str]) -> DataFrame:
    """Number of patients in studies of the given disease codes (stored in lower case)."""
    studies = t.cancer_study.where(F.col("type_of_cancer_id").isin([c.lower() for c in codes])).select(STUDY)
    rows = t.clinical_data_derived.join(studies, STUDY, "left_semi")
    return rows.agg(F.count_distinct(PATIENT).alias("patient_count"))


def studies_by_type(t, codes: list[str], terms: list[str]) -> DataFrame:
    """Studies with one of the disease codes or one of the terms in the name."""
    of_type = F.col("type_of_cancer_id").isin([c.lower() for c in codes])
    return (
        t.cancer_study.where(of_type | contains_any(["name"], terms))
        .select(STUDY, "name", "type_of_cancer_id")
        .orderBy("name", STUDY)
    )


def survival_table(t, study: str | None = None) -> DataFrame:
    """One row per patient: `os_months` as a number and `os_status` as text."""
    rows, keys = by_study(t.clinical_data_derived, study)
    return patient_pivot(rows, keys, {"os_months": number_of("OS_MONTHS"), "os_status": value_of("OS_STATUS")})


def median_by_mutation(t, study: str | None, gene: str, attribute: str = "OS_MONTHS") -> DataFrame:
    """Exact median of a numeric attribute for patients with and without a mutation of the gene."""
    rows, keys = _attribute(t, study, attribute)
    events, _ = by_study(t.genomic_event_derived, study)
    mutated = (
        events.where((F.col("variant_type") == "mutation") & (F.col("hugo_gene_symbol") == gene))
        .select(*keys, PATIENT)
        .distinct()
        .withColumn("group_name", F.lit("Mutated"))
    )
    counted = rows.groupBy(*keys, PATIENT, to_number(_value()).alias("value")).agg(F.count("*").alias("copies"))
    grouped = (
        counted.where(F.col("value").isNotNull())
        .join(mutated, [*keys, PATIENT], "left")
        .select(*keys, F.coalesce("group_name", F.lit("Wild-type")).alias("group_name"), "value", "copies")
    )
    result = median(grouped, [*keys, "group_name"], "value", "copies")
    return result.select(*keys, "group_name", F.col("median").alias(f"median_{attribute.lower()}"))


def _matches(criteria: dict[str, str]) -> Column:
    return any_of((_name() == a) & (_value() == v) for a, v in criteria.items())


def samples_any(t, study: str | None, criteria: dict[str, str]) -> DataFrame:
    """Samples with at least one of the attribute values."""
    rows, keys = by_study(t.clinical_data_derived, study)
    return _units(rows.where(_matches(criteria)), keys, SAMPLE, PATIENT)


def samples_all(t, study: str | None, criteria: dict[str, str]) -> DataFrame:
    """Samples with every one of the attribute values."""
    rows, keys = by_study(t.clinical_data_derived, study)
    # one flag per criterion: partial aggregation keeps a fixed-size row per sample
    flags = [F.max(F.when((_name() == a) & (_value() == v), 1)) for a, v in criteria.items()]
    return (
        rows.where(_matches(criteria))
        .groupBy(*keys, SAMPLE, PATIENT)
        .agg(*[f.alias(f"_{i}") for i, f in enumerate(flags)])
        .where(reduce(and_, [F.col(f"_{i}") == 1 for i in range(len(flags))]))
        .select(*keys, SAMPLE, PATIENT)
    )


def value_distribution(t, study: str | None, attribute: str) -> DataFrame:
    """Samples and patients per value; patient-level rows count no sample."""
    rows, keys = _attribute(t, study, attribute)
    return distinct_counts(rows, [*keys, "attribute_value"], {"sample_count": present(SAMPLE), "patient_count": F.col(PATIENT)})


def _sex_and_age(t, study) -> tuple[DataFrame, list[str]]:
    rows, keys = by_study(t.clinical_data_derived, study)
    rows = rows.where(_name().isin("SEX", "AGE"))
    return patient_pivot(rows, keys, {"sex": value_of("SEX"), "age": number_of("AGE")}), keys


def demographics(t, study: str | None = None) -> DataFrame:
    """Patients with known sex and age: count, mean, youngest and oldest by sex."""
    patients, keys = _sex_and_age(t, study)
    return (
        patients.where(F.col("sex").isNotNull() & F.col("age").isNotNull())
        .groupBy(*keys, "sex")
        .agg(
            F.count("*").alias("patient_count"), F.avg("age").alias("avg_age"),
            F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        )
    )


def patients_where(t, study: str | None, sex: str, lo: float, hi: float) -> DataFrame:
    """Patients of one sex within an age range, ends included."""
    patients, _ = _sex_and_age(t, study)
    return patients.where((F.col("sex") == sex) & F.col("age").between(lo, hi))


def numeric_filter(t, study: str | None, attribute: str, op: str, x: float) -> DataFrame:
    """Samples and patients whose attribute, read as a number, compares as asked."""
    rows, keys = _attribute(t, study, attribute)
    return (
        rows.select(*keys, SAMPLE, PATIENT, to_number(_value()).alias("value"))
        .where(COMPARISONS[op](F.col("value"), F.lit(float(x))))
        .distinct()
    )


def pattern_filter(t, study: str | None, attribute: str, like: str) -> DataFrame:
    """Samples whose attribute matches a LIKE pattern."""
    rows, keys = _attribute(t, study, attribute)
    return _units(rows.where(_value().like(like)), keys, SAMPLE)


def attribute_completeness(t, attribute: str, study: str | None = None, pooled: bool = False) -> DataFrame:
    """Mean, rows and non-null rows of an attribute, and how many rows read as a number."""
    rows, keys = _attribute(t, study, attribute)
    return rows.groupBy(*([] if pooled else keys)).agg(
        F.avg(to_number(_value())).alias("avg_value"),
        F.count("*").alias("total_records"),
        F.count("attribute_value").alias("non_null_records"),
        F.count(to_number(_value())).alias("numeric_records"),
    )


def samples_of_type(t, study: str | None, sample_type: str, attribute: str = "SAMPLE_TYPE") -> DataFrame:
    """Samples of one sample type (or one value of another attribute, such as CANCER_TYPE)."""
    rows, keys = _attribute(t, study, attribute)
    return _units(rows.where(_value() == sample_type), keys, SAMPLE, PATIENT)


def count_of_type(t, study: str | None, sample_type: str, attribute: str = "SAMPLE_TYPE") -> DataFrame:
    """Number of samples of one sample type."""
    rows, keys = _attribute(t, study, attribute)
    return rows.where(_value() == sample_type).groupBy(*keys).agg(F.count_distinct(present(SAMPLE)).alias("samples"))


def type_hierarchy(t, study: str | None = None, broad: str = "CANCER_TYPE",
                   detailed: str = "CANCER_TYPE_DETAILED") -> DataFrame:
    """Samples per (broad, detailed) value pair; a sample with several values counts in each pair."""
    rows, keys = by_study(t.clinical_data_derived, study)
    unit = [*keys, SAMPLE]

    def values(attribute: str, name: str) -> DataFrame:
        # distinct first: a value repeated for a sample neither counts nor multiplies rows
        chosen = rows.where((_name() == attribute) & (F.col(SAMPLE) != ""))
        return chosen.select(*unit, _value().alias(name)).distinct()

    return (
        values(broad, "broad_cancer_type")
        .join(values(detailed, "detailed_cancer_type"), unit)
        .groupBy(*keys, "broad_cancer_type", "detailed_cancer_type")
        .agg(F.count("*").alias("sample_count"))
        .orderBy(*keys, "broad_cancer_type", F.desc("sample_count"), "detailed_cancer_type")
    )


def exclude_samples(t, study: str | None, attribute: str, values: list[str]) -> DataFrame:
    """Samples of a study except those whose attribute has one of the values."""
    rows, keys = by_study(t.clinical_data_derived, study)
    # one flag per sample replaces the anti join: the table is read once
    return (
        rows.where(F.col(SAMPLE) != "")
        .groupBy(*keys, SAMPLE)
        .agg(F.max(F.when((_name() == attribute) & _value().isin(values), 1).otherwise(0)).alias("excluded"))
        .where(F.col("excluded") == 0)
        .select(*keys, SAMPLE)
    )


def with_mutation_data(t, study: str | None = None, variant_type: str = "mutation") -> DataFrame:
    """Samples that have at least one event of the kind."""
    rows, keys = by_study(t.clinical_data_derived, study)
    have = t.genomic_event_derived.where(F.col("variant_type") == variant_type).select(SAMPLE).distinct()
    return _units(rows, keys, SAMPLE, PATIENT).join(have, SAMPLE, "left_semi").select(*keys, SAMPLE, PATIENT)


def cohort_counts(t, study: str | None = None) -> DataFrame:
    """Two rows: number of patients and number of samples."""
    rows, keys = by_study(t.clinical_data_derived, study)
    counted = distinct_counts(rows, keys, {"patients": F.col(PATIENT), "samples": present(SAMPLE)})
    # the stack turns the counts into rows
    return counted.select(
        *keys, F.expr("stack(2, 'Patient Level', patients, 'Sample Level', samples) as (analysis_level, `count`)")
    )


def raw_patient_attr(t, study: str | None, attribute: str) -> DataFrame:
    """Patient attribute values from the raw tables."""
    studies, keys = by_study(t.cancer_study, study)
    patients = t.patient.join(studies.select("cancer_study_id", STUDY), "cancer_study_id")
    return (
        t.clinical_patient.where(F.col("attr_id") == attribute)
        .join(patients.select(F.col("internal_id").alias("patient_id"), STUDY), "patient_id")
        .select(*keys, "patient_id", "attr_id", "attr_value")
    )


def raw_sample_attr(t, study: str | None, attribute: str) -> DataFrame:
    """Sample attribute values from the raw tables."""
    studies, keys = by_study(t.cancer_study, study)
    patients = t.patient.join(studies.select("cancer_study_id", STUDY), "cancer_study_id")
    samples = t.sample.join(patients.select(F.col("internal_id").alias("patient_id"), STUDY), "patient_id")
    return (
        t.clinical_sample.where(F.col("attr_id") == attribute)
        .join(samples.select("internal_id", STUDY), "internal_id")
        .select(*keys, F.col("internal_id").alias("sample_id"), "attr_id", "attr_value")
    )


def study_info(t, study: str | None = None) -> DataFrame:
    """Study with its patients and samples counted from the base tables; 0 where it has none."""
    studies, _ = by_study(t.cancer_study, study)
    per_patient = t.sample.groupBy("patient_id").agg(F.count_distinct("internal_id").alias("samples"))
    counts = (
        t.patient.select("cancer_study_id", F.col("internal_id").alias("patient_id"))
        .join(per_patient, "patient_id", "left")
        .groupBy("cancer_study_id")
        .agg(
            F.count_distinct("patient_id").alias("patient_count"),
            F.coalesce(F.sum("samples"), F.lit(0)).alias("sample_count"),
        )
    )
    return studies.join(counts, "cancer_study_id", "left").select(
        STUDY, F.col("name").alias("study_name"), "description",
        F.coalesce("patient_count", F.lit(0)).alias("patient_count"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
    )


def studies(t) -> DataFrame:
    """All studies by id."""
    return t.cancer_study.select(STUDY, "name", "description", "type_of_cancer_id").orderBy(STUDY)


def studies_with_data(t, types: list[str], code: str | None = None, need: int | None = None) -> DataFrame:
    """Studies that have all the data types, or at least `need` of them."""
    chosen = t.cancer_study if code is None else t.cancer_study.where(F.col("type_of_cancer_id") == code.lower())
    profiles = t.genetic_profile.where(F.col("genetic_alteration_type").isin(types))
    return (
        chosen.select("cancer_study_id", STUDY, "name", "type_of_cancer_id")
        .join(profiles.select("cancer_study_id", "genetic_alteration_type"), "cancer_study_id")
        .groupBy(STUDY, "name", "type_of_cancer_id")
        .agg(F.count_distinct("genetic_alteration_type").alias("matched_profile_count"))
        .where(F.col("matched_profile_count") >= (len(set(types)) if need is None else need))
        .orderBy(STUDY)
    )


def study_samples(t, study: str | None = None) -> DataFrame:
    """All samples of a study with their patients."""
    rows, keys = by_study(t.clinical_data_derived, study)
    return _units(rows.where(F.col(SAMPLE) != ""), keys, SAMPLE, PATIENT)


def events_with_clinical(t, study: str | None = None) -> DataFrame:
    """Genomic events with each clinical row of their sample."""
    events, keys = by_study(t.genomic_event_derived, study)
    rows, _ = by_study(t.clinical_data_derived, study)
    events = events.select(*keys, SAMPLE, "hugo_gene_symbol", "variant_type", "mutation_variant", "mutation_type")
    rows = rows.where(F.col(SAMPLE) != "").select(*keys, SAMPLE, "attribute_name", "attribute_value")
    return events.join(rows, [*keys, SAMPLE])


def followup_summary(t, study: str | None = None) -> DataFrame:
    """Patients, deceased, living, and the follow-up range in months."""
    rows, keys = by_study(t.clinical_data_derived, study)
    rows = rows.where(_name().isin("OS_MONTHS", "OS_STATUS"))
    patients = patient_pivot(rows, keys, {"os_months": number_of("OS_MONTHS"), "os_status": value_of("OS_STATUS")})
    return patients.groupBy(*keys).agg(
        F.count("*").alias("patients"),
        F.count(F.when(F.col("os_status").startswith("1:"), 1)).alias("deceased"),
        F.count(F.when(F.col("os_status").startswith("0:"), 1)).alias("living"),
        F.min("os_months").alias("min_months"),
        F.max("os_months").alias("max_months"),
    )
