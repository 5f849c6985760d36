"""A cohort small enough to count by hand, with the edge rows the sample tables lack."""

from __future__ import annotations

import re

from cohortwise.sources import projection
from cohortwise.sources.tables import Tables

SCHEMAS = {
    "cancer_study": "cancer_study_id int, cancer_study_identifier string, name string, description string, type_of_cancer_id string",
    "patient": "internal_id long, stable_id string, cancer_study_id int",
    "sample": "internal_id long, stable_id string, patient_id long",
    "gene": "entrez_gene_id long, hugo_gene_symbol string",
    "gene_panel": "internal_id int, stable_id string",
    "gene_panel_list": "internal_id int, gene_id long",
    "sample_to_gene_panel_derived":
        "sample_unique_id string, cancer_study_identifier string, alteration_type string, gene_panel_id string",
    "genomic_event_derived":
        "sample_unique_id string, patient_unique_id string, cancer_study_identifier string, hugo_gene_symbol string, "
        "entrez_gene_id long, variant_type string, mutation_status string, mutation_variant string, mutation_type string, "
        "cna_alteration int, off_panel int",
    "clinical_data_derived":
        "sample_unique_id string, patient_unique_id string, cancer_study_identifier string, attribute_name string, "
        "attribute_value string, type string",
    "cancer_study_query_preferences": "preference_name string, cancer_study_identifier string, notes string",
    "genetic_alteration_derived":
        "sample_unique_id string, cancer_study_identifier string, hugo_gene_symbol string, profile_type string, alteration_value string",
    "clinical_event": "clinical_event_id long, patient_id long, event_type string, start_date int, stop_date int",
    "clinical_event_data": "clinical_event_id long, key string, value string",
}


def event(sample, patient, study, gene, status="Somatic", off_panel=0, kind="mutation", cna=None, change="p.A1B",
          mutation_type="Missense_Mutation"):
    return (f"{study}_{sample}", f"{study}_{patient}", study, gene, 0, kind, status, change, mutation_type, cna, off_panel)


def clinical(sample, patient, study, name, value):
    level = "sample" if sample else "patient"
    return (f"{study}_{sample}" if sample else "", f"{study}_{patient}", study, name, value, level)


def coverage(sample, study, panel, kind="MUTATION_EXTENDED"):
    return (f"{study}_{sample}", study, kind, panel)


ROWS = {
    "cancer_study": [
        (1, "a_tcga_pan_can_atlas_2018", "Study A", "first", "aa"),
        (2, "b_2020", "Study B", "second", "bb"),
        (3, "empty_2021", "No rows", "third", "bb"),
    ],
    "gene": [(10, "TP53"), (11, "KRAS"), (12, "ONLY_EXOME")],
    "gene_panel": [(1, "P1"), (2, "P2")],
    "gene_panel_list": [(1, 10), (2, 10), (2, 11)],
    # s1: panel and exome; s2: P1; s3: P2; s4: exome; s5: P1 but not for mutations
    "sample_to_gene_panel_derived": [
        coverage("s1", "b_2020", "WES"), coverage("s1", "b_2020", "P1"), coverage("s2", "b_2020", "P1"),
        coverage("s3", "b_2020", "P2"), coverage("s4", "b_2020", "WES"),
        coverage("s5", "b_2020", "P1", "COPY_NUMBER_ALTERATION"),
    ],
    "genomic_event_derived": [
        event("s1", "p1", "b_2020", "TP53"), event("s1", "p1", "b_2020", "TP53", change="p.C2D"),
        event("s2", "p1", "b_2020", "TP53", status=None),
        event("s3", "p2", "b_2020", "TP53", status="UNCALLED"),
        event("s3", "p2", "b_2020", "KRAS", status="Germline"),
        event("s2", "p1", "b_2020", "KRAS", off_panel=1),
        event("s4", "p3", "b_2020", "ONLY_EXOME"),
        event("s5", "p4", "b_2020", "TP53", kind="cna", cna=2, status="NA"),
    ],
    "clinical_data_derived": [
        *[clinical(s, p, "b_2020", "CANCER_TYPE", "Lung") for s, p in
          (("s1", "p1"), ("s2", "p1"), ("s3", "p2"), ("s4", "p3"))],
        clinical("s5", "p4", "b_2020", "CANCER_TYPE", "Skin"),
        clinical("s1", "p1", "b_2020", "SAMPLE_TYPE", "Primary"), clinical("s2", "p1", "b_2020", "SAMPLE_TYPE", "Metastasis"),
        clinical("s3", "p2", "b_2020", "SAMPLE_TYPE", "Primary"),
        clinical("", "p1", "b_2020", "SEX", "Female"), clinical("", "p1", "b_2020", "AGE", "61"),
        clinical("", "p2", "b_2020", "SEX", "Male"), clinical("", "p2", "b_2020", "AGE", "NA"),
        clinical("", "p3", "b_2020", "SEX", "Female"), clinical("", "p3", "b_2020", "AGE", "40"),
        clinical("", "p1", "b_2020", "OS_MONTHS", "12"), clinical("", "p1", "b_2020", "OS_STATUS", "1:DECEASED"),
        clinical("", "p2", "b_2020", "OS_MONTHS", "30"), clinical("", "p2", "b_2020", "OS_STATUS", "0:LIVING"),
        clinical("", "p3", "b_2020", "OS_MONTHS", ""), clinical("", "p3", "b_2020", "OS_STATUS", "0:LIVING"),
    ],
    "cancer_study_query_preferences": [("mine", "b_2020", "n1"), ("mine", "b_2020", "again"), ("mine", "empty_2021", "n2")],
    "patient": [(1, "p1", 2), (2, "p2", 2), (3, "p3", 2), (4, "p4", 2)],
    "sample": [(1, "s1", 1), (2, "s2", 1), (3, "s3", 2), (4, "s4", 3), (5, "s5", 4)],
    "genetic_alteration_derived": [],
    "clinical_event": [
        (1, 1, "Sequencing", 10, 10), (2, 1, "Sequencing", 30, 30), (3, 1, "Treatment", 10, 12), (4, 1, "TREATMENT", 5, 6),
        (5, 2, "Treatment", 1, 2), (6, 1, "Treatment", None, 2), (7, 3, "Sequencing", None, None), (8, 3, "Treatment", 4, 4),
    ],
    "clinical_event_data": [
        (3, "AGENT", "X"), (3, "SUBTYPE", "Chemo"), (4, "AGENT", "X"), (5, "AGENT", "X"), (6, "AGENT", "Y"),
        (8, "AGENT", "X"), (8, "SUBTYPE", "Chemo"), (8, "AGENT", "Z"),
    ],
}


def tiny(spark, **changes) -> Tables:
    content = {**ROWS, **changes}
    frames = {n: spark.createDataFrame(content[n], SCHEMAS[n]) for n in SCHEMAS}
    text = projection.VIEWS["clinical_event_derived"]
    for name in ("clinical_event_data", "clinical_event", "patient", "cancer_study"):
        text = re.sub(rf"(?<=from |join ){name}\b", f"{{{name}}}", text)
    parts = {n: frames[n] for n in ("clinical_event_data", "clinical_event", "patient", "cancer_study")}
    return Tables.of(spark, **frames, clinical_event_derived=spark.sql(text, **parts))
