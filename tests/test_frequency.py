from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tiny import ROWS, coverage, event, tiny

from cohortwise.operators import coverage as cov
from cohortwise.operators import events, frequency

STUDY = "cancer_study_identifier"


def test_golden_rows(tables):
    got = rows(frequency.gene_mutation_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE3"))
    # 7 / 560 is exactly 1.25 %: ties go to even
    assert got == [
        ("AUTOMOBILE", 7, 560, 1.2), ("BUILDING", 11, 641, 1.7), ("FURNITURE", 11, 654, 1.7),
        ("HOUSEHOLD", 21, 700, 3.0), ("MACHINERY", 16, 663, 2.4),
    ]


def test_sample_on_exome_and_panel_counts_once(spark):
    t = tiny(spark)
    got = rows(frequency.gene_mutation_frequency_by_cancer_type(t, "mine", "TP53", min_profiled=0))
    # s1 altered (twice); s2 has no status, s3 is uncalled; s1..s4 profiled
    assert got == [("Lung", 1, 4, 25.0)]


def test_all_genes_agree_with_each_gene(spark):
    t = tiny(spark)
    every = frequency.gene_mutation_frequency_by_cancer_type(t, "mine", None, min_profiled=0)
    for gene in ("TP53", "KRAS", "ONLY_EXOME"):
        one = rows(frequency.gene_mutation_frequency_by_cancer_type(t, "mine", gene, min_profiled=0))
        assert rows(every.where(F.col("hugo_gene_symbol") == gene).drop("hugo_gene_symbol")) == one


def test_floor_and_zero_types(spark):
    t = tiny(spark)
    assert rows(frequency.gene_mutation_frequency_by_cancer_type(t, "mine", "TP53")) == []
    more = tiny(spark, sample_to_gene_panel_derived=[*ROWS["sample_to_gene_panel_derived"], coverage("s5", "b_2020", "P1")])
    got = frequency.gene_mutation_frequency_by_cancer_type(more, "mine", "TP53", min_profiled=0, include_zero=True)
    assert rows(got) == [("Lung", 1, 4, 25.0), ("Skin", 0, 1, 0.0)]
    assert rows(frequency.gene_mutation_frequency_by_cancer_type(more, "mine", "TP53", min_profiled=0)) == [("Lung", 1, 4, 25.0)]


def test_top_genes_count_exome_and_panel_unless_deduped(spark):
    t = tiny(spark)
    plain = {r[0]: r[1:] for r in rows(frequency.top_mutated_genes_in_cohort(t, "mine"))}
    deduped = {r[0]: r[1:] for r in rows(frequency.top_mutated_genes_in_cohort(t, "mine", dedupe=True))}
    assert plain["TP53"] == (1, 5, 20.0, 2)
    assert deduped["TP53"] == (1, 4, 25.0, 2)
    assert plain["ONLY_EXOME"] == (1, 2, 50.0, 1)
    # a repeated preference row does not repeat events
    assert plain["KRAS"][3] == 1


def test_top_n_order(spark):
    got = frequency.top_mutated_genes_in_cohort(tiny(spark), "mine", top_n=2).collect()
    assert [r[0] for r in got] == ["KRAS", "ONLY_EXOME"]


def test_tokens(spark):
    t = tiny(spark)
    amplified = frequency.gene_alteration_frequency_by_cancer_type(t, "mine", "TP53", "amplification", min_profiled=0)
    assert rows(amplified) == [("Skin", 1, 1, 100.0)]
    assert rows(frequency.gene_alteration_frequency_by_cancer_type(t, "mine", "TP53", "nonsense", min_profiled=0)) == []


def test_token_mutation_equals_mutation_query(tables):
    a = frequency.gene_alteration_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE7", "mutation")
    b = frequency.gene_mutation_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE7")
    assert rows(a) == rows(b)


def test_one_study_forms_agree(tables):
    study = "nation_1_msk_2024"
    one = rows(frequency.gene_mutation_frequency_in_study(tables, study, "GENE3"))
    assert one == rows(frequency.gene_mutation_frequency_in_studies(tables, [study], "GENE3"))
    assert one == rows(frequency.gene_mutation_frequency_by_cancer_type(tables, "large_genomic_cohort", "GENE3"))
    every = frequency.gene_mutation_frequency_in_study(tables, None)
    picked = every.where((F.col(STUDY) == study) & (F.col("hugo_gene_symbol") == "GENE3")).drop(STUDY, "hugo_gene_symbol")
    assert rows(picked) == one


def test_no_percentage_over_100(tables):
    got = frequency.gene_mutation_frequency_by_cancer_type(tables, "all_studies_non_redundant", None, min_profiled=0)
    assert got.where("frequency_pct > 100").count() == 0


def test_wrong_recipes_change_the_answer(tables):
    """Exome-blind, off-panel and uncalled rows, and all samples as denominator each give other numbers."""
    right = {r[0]: r[1:] for r in rows(frequency.gene_mutation_frequency_by_cancer_type(tables, "pan_cancer_tcga", "GENE3"))}
    assert right["HOUSEHOLD"] == (21, 700, 3.0)
    cohort = frequency.cohort_studies(tables.cancer_study_query_preferences, "pan_cancer_tcga")
    typed = tables.clinical_data_derived.where("attribute_name = 'CANCER_TYPE' and attribute_value = 'HOUSEHOLD'")
    typed = typed.join(cohort, STUDY, "left_semi").select("sample_unique_id")
    gene = tables.genomic_event_derived.where("hugo_gene_symbol = 'GENE3' and variant_type = 'mutation'")

    def altered(condition):
        return gene.where(condition).join(typed, "sample_unique_id", "left_semi").select("sample_unique_id").distinct().count()

    assert altered("off_panel = 0 and mutation_status <> 'UNCALLED'") == 21
    assert altered("mutation_status <> 'UNCALLED'") == 33
    assert altered("off_panel = 0") == 23
    panels_only = cov.panel_gene_coverage(tables).where("hugo_gene_symbol = 'GENE3'")
    assert panels_only.join(typed, "sample_unique_id", "left_semi").select("sample_unique_id").distinct().count() == 466
    assert typed.count() == 1187


def test_assert_frequency(spark):
    good = spark.createDataFrame([(99.9,), (None,)], "frequency_pct double")
    assert rows(frequency.assert_frequency(good)) == [(99.9,), (None,)]
    bad = spark.createDataFrame([(172.0,)], "frequency_pct double")
    with pytest.raises(Exception, match="over 100"):
        frequency.assert_frequency(bad).collect()


def test_patient_frequency_needs_a_profiled_altered_sample(spark):
    # p4's only altered sample is not profiled for mutations; s2 (same patient as s1) is
    t = tiny(spark, genomic_event_derived=[*ROWS["genomic_event_derived"], event("s5", "p4", "b_2020", "TP53")])
    assert rows(frequency.patient_frequency(t, gene="TP53")) == [("b_2020", 1, 3, 33.3)]
    every = frequency.patient_frequency(t)
    assert rows(every.where("hugo_gene_symbol = 'TP53'").drop("hugo_gene_symbol")) == [("b_2020", 1, 3, 33.3)]
    assert rows(frequency.patient_frequency(t, "b_2020", "ONLY_EXOME")) == [(1, 2, 50.0)]


def test_denominators(spark):
    t = tiny(spark)
    assert rows(frequency.profiled_count(t, "TP53", "b_2020")) == [(4,)]
    assert rows(frequency.profiled_count(t, "TP53", "b_2020", wes_aware=False)) == [(3,)]
    assert rows(frequency.profiled_count_wes_study(t, "b_2020")) == [(4,)]
    aware = {r[0]: r for r in rows(frequency.study_gene_frequency(t, "b_2020"))}
    assert aware["ONLY_EXOME"] == ("ONLY_EXOME", 1, 1, 2, 50.0)
    blind = {r[0]: r for r in rows(frequency.study_gene_frequency(t, "b_2020", wes_aware=False))}
    assert "ONLY_EXOME" not in blind and blind["TP53"][3] == 3
    assert cov.profiled_samples(t, "TP53").count() == 5


def test_events(spark):
    t = tiny(spark)
    assert rows(events.variant_samples(t, "b_2020", "TP53", "p.C2D")) == [("b_2020_s1", "b_2020_p1")]
    assert rows(events.variant_samples(t, "b_2020", "TP53", "p.V600V")) == []
    assert len(rows(events.gene_variants(t, "b_2020", "TP53", n=2))) == 2
    assert rows(events.cna_level_counts(t, "b_2020")) == [(2, 1, 1, "Amplification")]
    with pytest.raises(ValueError, match="driver"):
        events.driver_events(t, "b_2020", "TP53")


def test_preference_summary_counts_rows(spark):
    assert rows(frequency.preference_summary(tiny(spark))) == [("mine", 3, "again")]


def test_unknown_alteration_has_no_rows(spark, tables):
    assert frequency.gene_alteration_frequency_by_cancer_type(tables, "all_studies_non_redundant", None, "methylated").count() == 0
