from __future__ import annotations

import pytest
from conftest import rows
from tiny import ROWS, clinical as row, tiny

from cohortwise.operators import catalog, clinical


def test_empty_sample_id_is_no_sample(spark):
    t = tiny(spark)
    assert rows(clinical.cohort_counts(t, "b_2020")) == [("Patient Level", 4), ("Sample Level", 5)]
    assert rows(clinical.value_distribution(t, "b_2020", "SEX")) == [("Female", 0, 2), ("Male", 0, 1)]
    listed = {r[0]: r.sample_count for r in catalog.list_studies(t).collect()}
    assert listed == {"b_2020": 5, "a_tcga_pan_can_atlas_2018": 0, "empty_2021": 0}


def test_demographics_pivot_sex_and_age_per_patient(spark):
    assert rows(clinical.demographics(tiny(spark), "b_2020")) == [("Female", 2, 50.5, 40.0, 61.0)]


def test_any_and_all_criteria(spark):
    t = tiny(spark)
    criteria = {"CANCER_TYPE": "Lung", "SAMPLE_TYPE": "Primary"}
    some = rows(clinical.samples_any(t, "b_2020", criteria))
    both = rows(clinical.samples_all(t, "b_2020", criteria))
    assert [r[0] for r in both] == ["b_2020_s1", "b_2020_s3"]
    assert set(both) < set(some) and len(some) == 4


def test_repeated_value_does_not_stand_for_another_criterion(spark):
    t = tiny(spark, clinical_data_derived=[row("s1", "p1", "b_2020", "SAMPLE_TYPE", "Primary")] * 2)
    assert rows(clinical.samples_all(t, "b_2020", {"SAMPLE_TYPE": "Primary", "CANCER_TYPE": "Lung"})) == []


def test_exclusion_keeps_samples_without_the_attribute(spark):
    got = rows(clinical.exclude_samples(tiny(spark), "b_2020", "SAMPLE_TYPE", ["Metastasis"]))
    assert [r[0] for r in got] == ["b_2020_s1", "b_2020_s3", "b_2020_s4", "b_2020_s5"]


def test_exclusion_is_not_undone_by_a_null_value(spark):
    more = [*ROWS["clinical_data_derived"], (None, None, "b_2020", "SAMPLE_TYPE", "Metastasis", "sample")]
    got = rows(clinical.exclude_samples(tiny(spark, clinical_data_derived=more), "b_2020", "SAMPLE_TYPE", ["Metastasis"]))
    assert len(got) == 4


def test_survival(spark):
    t = tiny(spark)
    got = {r[0]: r[1:] for r in rows(clinical.survival_table(t, "b_2020"))}
    assert got["b_2020_p1"] == (12.0, "1:DECEASED") and got["b_2020_p3"] == (None, "0:LIVING")
    assert got["b_2020_p4"] == (None, None)
    assert rows(clinical.followup_summary(t, "b_2020")) == [(3, 1, 2, 12.0, 30.0)]


def test_median_by_mutation(spark):
    t = tiny(spark)
    assert rows(clinical.median_by_mutation(t, "b_2020", "KRAS")) == [("Mutated", 21.0)]
    assert rows(clinical.median_by_mutation(t, "b_2020", "ONLY_EXOME")) == [("Wild-type", 21.0)]


def test_filters(spark):
    t = tiny(spark)
    assert rows(clinical.where_attribute(t, "b_2020", "SAMPLE_TYPE", "PRIMARY")) == [
        ("b_2020_s1", "b_2020_p1"), ("b_2020_s3", "b_2020_p2")]
    # '9' would sort above '50' as text
    assert [r[1] for r in rows(clinical.numeric_filter(t, "b_2020", "AGE", ">", 50))] == ["b_2020_p1"]
    assert rows(clinical.patients_where(t, "b_2020", "Female", 40, 61)) == [
        ("b_2020_p1", "Female", 61.0), ("b_2020_p3", "Female", 40.0)]
    assert rows(clinical.attribute_completeness(t, "AGE", "b_2020")) == [(50.5, 3, 3, 2)]
    assert rows(clinical.with_mutation_data(t, "b_2020"))[0] == ("b_2020_s1", "b_2020_p1")
    assert rows(clinical.count_of_type(t, "b_2020", "Primary")) == [(2,)]


def test_study_info_counts_zero(spark):
    got = {r[0]: r[3:] for r in rows(clinical.study_info(tiny(spark)))}
    assert got == {"b_2020": (4, 5), "empty_2021": (0, 0), "a_tcga_pan_can_atlas_2018": (0, 0)}


def test_unknown_comparison(spark):
    with pytest.raises(KeyError):
        clinical.numeric_filter(tiny(spark), "b_2020", "AGE", "~", 1)
