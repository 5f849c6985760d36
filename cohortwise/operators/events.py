"""Genomic events themselves: counts, variants, classes, copy-number levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.labels import cna_label, mutation_classes
from cohortwise.functions.values import contains_any
from cohortwise.operators.coverage import GENE, SAMPLE
from cohortwise.plans.scope import STUDY, by_study


def event_counts(t, study: str | None = None, per_gene: bool = False, pooled: bool = False,
                 on_panel: bool = False, called: bool = False) -> DataFrame:
    """Number of events; optionally on-panel ones, called mutations only, per gene, over all studies."""
    events, keys = by_study(t.genomic_event_derived, study)
    if on_panel:
        events = events.where(F.col("off_panel") == 0)
    if called:
        events = events.where((F.col("variant_type") == "mutation") & (F.col("mutation_status") != "UNCALLED"))
    keys = [*([] if pooled else keys), *([GENE] if per_gene else [])]
    return events.groupBy(*keys).agg(F.count("*").alias("events"))


def cna_gene_counts(t, study: str | None = None, level: int = 2) -> DataFrame:
    """Samples per gene with a copy-number level (2 amplified, -2 deleted)."""
    events, keys = by_study(t.genomic_event_derived, study)
    return (
        events.where((F.col("variant_type") == "cna") & (F.col("cna_alteration") == level))
        .groupBy(*keys, GENE)
        .agg(F.count_distinct(SAMPLE).alias("samples"))
    )


def cna_level_counts(t, study: str | None = None) -> DataFrame:
    """Events and samples per copy-number level, with its name."""
    events, keys = by_study(t.genomic_event_derived, study)
    return (
        events.where(F.col("cna_alteration").isNotNull())
        .groupBy(*keys, "cna_alteration")
        .agg(F.count("*").alias("events"), F.count_distinct(SAMPLE).alias("samples"))
        .withColumn("label", cna_label("cna_alteration"))
    )


def gene_variants(t, study: str | None, gene: str, n: int | None = None) -> DataFrame:
    """Mutations of a gene; with `n`, the first ones by sample and variant."""
    events, keys = by_study(t.genomic_event_derived, study)
    rows = events.where((F.col("variant_type") == "mutation") & (F.col(GENE) == gene)).select(
        *keys, SAMPLE, GENE, "mutation_variant", "mutation_type"
    )
    return rows if n is None else rows.orderBy(SAMPLE, "mutation_variant", "mutation_type").limit(n)


def variant_samples(t, study: str | None, gene: str, change: str) -> DataFrame:
    """Samples with exactly this protein change; no row is a valid answer."""
    events, keys = by_study(t.genomic_event_derived, study)
    return (
        events.where((F.col("variant_type") == "mutation") & (F.col(GENE) == gene) & (F.col("mutation_variant") == change))
        .select(*keys, SAMPLE, "patient_unique_id")
        .distinct()
    )


def mutation_class_counts(t, study: str | None = None, gene: str | None = None) -> DataFrame:
    """Events and samples per mutation class; classes overlap, so an event may count in several."""
    events, keys = by_study(t.genomic_event_derived, study)
    events = events.where(F.col("variant_type") == "mutation")
    if gene is not None:
        events = events.where(F.col(GENE) == gene)
    return (
        events.select(*keys, SAMPLE, F.explode(mutation_classes("mutation_type")).alias("mutation_class"))
        .groupBy(*keys, "mutation_class")
        .agg(F.count("*").alias("events"), F.count_distinct(SAMPLE).alias("samples"))
    )


def promoter_profiles(t, study: str | None = None, term: str = "promoter") -> DataFrame:
    """Profiles whose name has the term; events of the gene as a whole are never counted for it."""
    studies, keys = by_study(t.cancer_study, study)
    return (
        t.genetic_profile.where(contains_any(["name"], [term]))
        .withColumnRenamed("name", "profile_name")
        .join(studies.select("cancer_study_id", STUDY), "cancer_study_id")
        .select(*keys, "profile_name", "genetic_alteration_type", "datatype")
    )


def driver_events(t, study: str | None, gene: str | None = None, column: str = "driver_filter") -> DataFrame:
    """Mutations with a driver annotation; refused when the data has no such column."""
    if column not in t.genomic_event_derived.columns:
        raise ValueError(f"driver annotations are not available: no column {column}")
    events, keys = by_study(t.genomic_event_derived, study)
    if gene is not None:
        events = events.where(F.col(GENE) == gene)
    return events.where((F.col("variant_type") == "mutation") & F.col(column).isNotNull()).select(
        *keys, SAMPLE, GENE, "mutation_variant", column
    )
