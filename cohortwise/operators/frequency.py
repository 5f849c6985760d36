"""Alteration frequencies: altered over profiled, per cancer type, study, gene or patient.

`preference` names a cohort, `study` one study (None: every study, with its id as a
key), and `gene=None` computes every gene in the same job, with the symbol as a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.labels import COVERAGE_TYPE
from cohortwise.functions.values import percent
from cohortwise.operators.coverage import (
    GENE,
    SAMPLE,
    WHOLE_EXOME,
    covered_samples,
    covering_panels,
    panel_genes,
    panel_sets,
    profiled_per_gene,
    profiled_rows,
)
from cohortwise.plans.ranking import top, top_per_group
from cohortwise.plans.scope import STUDY, by_study, cohort_studies, in_cohort

TYPE = "cancer_type"


def altered_rows(alteration: str) -> Column:
    """Events that count as the alteration; an unknown token matches nothing."""
    kind = F.col("variant_type")
    rules = {
        # a missing status is dropped along with UNCALLED
        "mutation": (kind == "mutation") & (F.col("mutation_status") != "UNCALLED"),
        "amplification": (kind == "cna") & (F.col("cna_alteration") == 2),
        "deep_deletion": (kind == "cna") & (F.col("cna_alteration") == -2),
        "structural_variant": kind == "structural_variant",
    }
    return rules.get(alteration, F.lit(False))


def altered_events(t, alteration: str = "mutation", on_panel: bool = True) -> DataFrame:
    events = t.genomic_event_derived.where(altered_rows(alteration))
    return events.where(F.col("off_panel") == 0) if on_panel else events


def _frequency(t, studies, study_keys: list[str], gene: str | None, alteration: str,
               min_profiled: int, include_zero: bool) -> DataFrame:
    """Altered, profiled and percentage per (study keys, cancer type[, gene]).

    Types, altered genes and panels are made distinct per sample before they meet, so no
    sample is heavy in the joins, and everything after the joins is counts.
    """
    unit = [*study_keys, SAMPLE]
    group = [*study_keys, TYPE]
    types = (
        in_cohort(t.clinical_data_derived, studies)
        .where((F.col("attribute_name") == "CANCER_TYPE") & (F.col(SAMPLE) != ""))
        .select(*unit, F.col("attribute_value").alias(TYPE))
        .distinct()
    )
    events = in_cohort(altered_events(t, alteration), studies)

    def count(units: DataFrame, name: str, *more: str) -> DataFrame:
        return units.join(types, unit).groupBy(*group, *more).agg(F.count("*").alias(name))

    if gene is not None:
        altered = events.where(F.col(GENE) == gene).select(*unit).distinct()
        covered = covered_samples(t, gene, alteration, studies).select(*unit).distinct()
        counts = count(covered, "profiled_samples").join(
            count(altered, "altered_samples"), group, "left" if include_zero else "inner"
        )
    else:
        altered = count(events.select(*unit, GENE).distinct(), "altered_samples", GENE)
        sets = count(panel_sets(t, COVERAGE_TYPE.get(alteration, ""), unit, studies), "units", "panels")
        named, exome = profiled_per_gene(t, sets, group)
        group = [*group, GENE]
        counts = (
            altered.join(named, group, "left")
            .join(exome, group[:-1], "left")
            .withColumn("profiled_samples", _sum_of("panel_units", "exome_units"))
        )
    altered_count = F.coalesce("altered_samples", F.lit(0))
    return counts.where(F.col("profiled_samples") >= min_profiled).select(
        *group,
        altered_count.alias("altered_samples"),
        "profiled_samples",
        percent(altered_count, F.col("profiled_samples")).alias("frequency_pct"),
    )


def _sum_of(*columns: str) -> Column:
    first, second = columns
    return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))


def gene_alteration_frequency_by_cancer_type(
    t, preference: str, gene: str | None, alteration: str, min_profiled: int = 50, include_zero: bool = False
) -> DataFrame:
    """(cancer_type, altered_samples, profiled_samples, frequency_pct) in a named cohort.

    Types with fewer than `min_profiled` profiled samples are left out, and so are types
    without an altered sample unless `include_zero` (single gene only).
    """
    studies = cohort_studies(t.cancer_study_query_preferences, preference)
    return _frequency(t, studies, [], gene, alteration, min_profiled, include_zero)


def gene_mutation_frequency_by_cancer_type(t, preference: str, gene: str | None = None, **options) -> DataFrame:
    """Mutation frequency per cancer type in a named cohort."""
    return gene_alteration_frequency_by_cancer_type(t, preference, gene, "mutation", **options)


def gene_mutation_frequency_in_study(
    t, study: str | None, gene: str | None = None, min_profiled: int = 50, include_zero: bool = False
) -> DataFrame:
    """Mutation frequency per cancer type of one study, or of each study."""
    studies, keys = (None, [STUDY]) if study is None else ([study], [])
    return _frequency(t, studies, keys, gene, "mutation", min_profiled, include_zero)


def gene_mutation_frequency_in_studies(
    t, studies: list[str], gene: str | None = None, min_profiled: int = 50, include_zero: bool = False
) -> DataFrame:
    """Mutation frequency per cancer type over studies that share no samples (the caller's promise)."""
    return _frequency(t, list(studies), [], gene, "mutation", min_profiled, include_zero)


def contributing_studies(t, preference: str) -> DataFrame:
    """(cancer_type, studies): how many studies of the cohort use each label."""
    studies = cohort_studies(t.cancer_study_query_preferences, preference)
    typed = in_cohort(t.clinical_data_derived, studies).where(F.col("attribute_name") == "CANCER_TYPE")
    return typed.groupBy(F.col("attribute_value").alias(TYPE)).agg(F.count_distinct(STUDY).alias("studies"))


def _denominators(t, studies, keys: list[str], dedupe: bool, named_only: bool = False):
    sets = (
        panel_sets(t, "MUTATION_EXTENDED", [*keys, SAMPLE], studies)
        .groupBy(*keys, "panels")
        .agg(F.count("*").alias("units"))
    )
    return profiled_per_gene(t, sets, keys, named_only=named_only, dedupe=dedupe)


def top_mutated_genes_in_cohort(t, preference: str, top_n: int | None = 20, dedupe: bool = False) -> DataFrame:
    """Genes of a cohort by altered samples, with coverage-aware percentage and event count.

    The denominator adds whole-exome and panel samples, so a sample on both counts twice;
    `dedupe` counts it once.
    """
    studies = cohort_studies(t.cancer_study_query_preferences, preference)
    altered = (
        in_cohort(altered_events(t), studies)
        .groupBy(GENE)
        .agg(F.count_distinct(SAMPLE).alias("altered_samples"), F.count("*").alias("total_mutation_events"))
    )
    named, exome = _denominators(t, studies, [], dedupe)
    profiled = F.coalesce("panel_units", F.lit(0)) + F.coalesce(exome.scalar(), F.lit(0))
    genes = (
        altered.join(named, GENE, "left")
        .withColumn("profiled_samples", profiled)
        .select(
            GENE,
            "altered_samples",
            "profiled_samples",
            percent(F.col("altered_samples"), F.col("profiled_samples")).alias("frequency_pct"),
            "total_mutation_events",
        )
    )
    return top(genes, [F.desc("altered_samples"), F.asc(GENE)], top_n)


def altered_counts(t, study: str | None = None, pooled: bool = False) -> DataFrame:
    """Per gene: altered samples, those on panel, and events; over all studies when `pooled`."""
    events, keys = by_study(altered_events(t, on_panel=False), study)
    group = [*([] if pooled else keys), GENE, "entrez_gene_id"]
    # one row per sample, whether it is on the panel being a flag of it: no row is expanded for a second distinct count
    samples = events.groupBy(*group, SAMPLE).agg(F.max(F.col("off_panel") == 0).alias("_on_panel"), F.count("*").alias("_events"))
    return samples.groupBy(*group).agg(
        F.count(SAMPLE).alias("altered_samples"),
        F.count(F.when(F.col("_on_panel"), F.col(SAMPLE))).alias("altered_samples_on_panel"),
        F.sum("_events").alias("total_mutation_events"),
    )


def profiled_count(t, gene: str, study: str | None = None, wes_aware: bool = True) -> DataFrame:
    """Samples profiled for a gene; `wes_aware=False` counts named panels only."""
    rows, keys = by_study(profiled_rows(t), study)
    panels = covering_panels(t, gene)
    if not wes_aware:
        panels = panels.where(F.col("gene_panel_id") != WHOLE_EXOME)
    return (
        rows.join(panels, "gene_panel_id", "left_semi")
        .groupBy(*keys)
        .agg(F.count_distinct(SAMPLE).alias("profiled_samples"))
    )


def profiled_count_wes_study(t, study: str | None = None) -> DataFrame:
    """Samples with any mutation profiling: the denominator of every gene in an exome study."""
    rows, keys = by_study(profiled_rows(t), study)
    return rows.groupBy(*keys).agg(F.count_distinct(SAMPLE).alias("profiled_samples"))


def study_gene_frequency(t, study: str | None = None, wes_aware: bool = True) -> DataFrame:
    """Per gene of a study: events, altered samples on panel, profiled samples, percentage.

    `wes_aware=False` leaves exome samples out of the denominator, and with them the genes
    that no named panel lists.
    """
    studies, keys = (None, [STUDY]) if study is None else ([study], [])
    altered = altered_counts(t, study)
    named, exome = _denominators(t, studies, keys, dedupe=True, named_only=not wes_aware)
    if not wes_aware:
        counts = altered.join(named, [*keys, GENE]).withColumn("profiled_samples", F.col("panel_units"))
    else:
        whole = F.coalesce("exome_units", F.lit(0)) if keys else F.coalesce(exome.scalar(), F.lit(0))
        counts = altered.join(named, [*keys, GENE], "left")
        if keys:
            counts = counts.join(exome, keys, "left")
        counts = counts.withColumn("profiled_samples", F.coalesce("panel_units", F.lit(0)) + whole)
    return counts.where(F.col("profiled_samples") > 0).select(
        *keys,
        GENE,
        F.col("total_mutation_events").alias("mutations"),
        F.col("altered_samples_on_panel").alias("altered_samples"),
        "profiled_samples",
        percent(F.col("altered_samples_on_panel"), F.col("profiled_samples")).alias("sample_frequency_percent"),
    )


def top_genes_per_cancer_type(t, preference: str, n: int | None = 10, min_profiled: int = 50) -> DataFrame:
    """The `n` most often mutated genes of each cancer type, by altered samples, then symbol."""
    rows = gene_mutation_frequency_by_cancer_type(t, preference, None, min_profiled=min_profiled)
    return top_per_group(rows, [TYPE], [F.desc("altered_samples"), F.asc(GENE)], n)


def frequency_compare(t, preference: str, types: tuple[str, str], gene: str | None = None, **options) -> DataFrame:
    """One row per gene with the frequency in two cancer types side by side and the difference."""
    rows = gene_mutation_frequency_by_cancer_type(t, preference, gene, **options)
    if gene is not None:
        rows = rows.withColumn(GENE, F.lit(gene))
    sides = {"first": types[0], "second": types[1]}
    columns = [
        F.max(F.when(F.col(TYPE) == cancer, F.col(column))).alias(f"{side}_{short}")
        for side, cancer in sides.items()
        for column, short in (("altered_samples", "altered"), ("profiled_samples", "profiled"), ("frequency_pct", "pct"))
    ]
    return rows.where(F.col(TYPE).isin(*types)).groupBy(GENE).agg(*columns)


def _sample_patients(t, studies) -> DataFrame:
    rows = in_cohort(t.clinical_data_derived, studies).where(F.col(SAMPLE) != "")
    return rows.select(STUDY, SAMPLE, "patient_unique_id").distinct()


def patient_frequency(t, study: str | None = None, gene: str | None = None) -> DataFrame:
    """Patients with a mutated profiled sample over patients with any sample profiled for the gene."""
    studies, keys = (None, [STUDY]) if study is None else ([study], [])
    patients = _sample_patients(t, studies)
    events = in_cohort(altered_events(t), studies)
    unit = [STUDY, SAMPLE]
    if gene is not None:
        altered = events.where(F.col(GENE) == gene).select(*unit).distinct().withColumn("hit", F.lit(1))
        per_patient = (
            covered_samples(t, gene, "mutation", studies)
            .join(altered, unit, "left")
            .join(patients, unit)
            .groupBy(STUDY, "patient_unique_id")
            .agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
        )
        counts = per_patient.groupBy(*keys).agg(
            F.coalesce(F.sum("hit"), F.lit(0)).alias("altered_patients"), F.count("*").alias("profiled_patients")
        )
        group = keys
    else:
        group = [*keys, GENE]
        panels = panel_sets(t, "MUTATION_EXTENDED", unit, studies).join(patients, unit)
        sets = (
            panels.groupBy(STUDY, "patient_unique_id")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("panels")))).alias("panels"))
            .groupBy(*keys, "panels")
            .agg(F.count("*").alias("units"))
        )
        named, exome = profiled_per_gene(t, sets, keys)
        # the genes of each set of panels, made once per set
        listed = (
            panels.select("panels").distinct()
            .select("panels", F.explode("panels").alias("gene_panel_id"))
            .join(panel_genes(t), "gene_panel_id")
            .select("panels", GENE).distinct().withColumn("listed", F.lit(True))
        )
        altered = (
            events.select(*unit, GENE).distinct()
            .join(panels, unit)
            .join(listed, ["panels", GENE], "left")
            .where(F.col("listed") | F.array_contains("panels", WHOLE_EXOME))
            .groupBy(*group)
            .agg(F.count_distinct(STUDY, "patient_unique_id").alias("altered_patients"))
        )
        whole = F.coalesce("exome_units", F.lit(0)) if keys else F.coalesce(exome.scalar(), F.lit(0))
        counts = altered.join(named, group, "left")
        if keys:
            counts = counts.join(exome, keys, "left")
        counts = counts.withColumn("profiled_patients", F.coalesce("panel_units", F.lit(0)) + whole)
    return counts.select(
        *group,
        "altered_patients",
        "profiled_patients",
        percent(F.col("altered_patients"), F.col("profiled_patients")).alias("patient_frequency_pct"),
    )


def assert_frequency(df: DataFrame, column: str = "frequency_pct") -> DataFrame:
    """The same rows; the job fails on a percentage over 100, the sign of a wrong denominator."""
    message = F.concat(F.lit(f"{column} is over 100: "), F.col(column).cast("string"))
    return df.withColumn(column, F.when(F.col(column) > 100, F.raise_error(message).cast("double")).otherwise(F.col(column)))


def preference_summary(t) -> DataFrame:
    """Named cohorts: studies in each and one of its notes."""
    return t.cancer_study_query_preferences.groupBy("preference_name").agg(
        F.count("*").alias("studies"), F.min("notes").alias("note")
    )
