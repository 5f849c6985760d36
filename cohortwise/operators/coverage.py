"""Which samples were profiled for which genes: named panels plus whole exome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.labels import COVERAGE_TYPE
from cohortwise.plans.scope import STUDY, in_cohort

SAMPLE = "sample_unique_id"
GENE = "hugo_gene_symbol"
# Fixed value: panel id of whole-exome samples; it is not a row of `gene_panel`.
WHOLE_EXOME = "WES"


def panel_genes(t) -> DataFrame:
    """(gene_panel_id, hugo_gene_symbol) of every named panel: one row per row of the panel lists."""
    return (
        t.gene_panel.withColumnRenamed("stable_id", "gene_panel_id")
        .join(t.gene_panel_list, "internal_id")
        .join(t.gene, F.col("gene_id") == F.col("entrez_gene_id"))
        .select("gene_panel_id", GENE)
    )


def covering_panels(t, gene: str) -> DataFrame:
    """Ids of the panels that cover a gene, whole exome included: at most one more than there are panels."""
    named = panel_genes(t).where(F.col(GENE) == gene).select("gene_panel_id")
    exome = t.spark.range(1).select(F.lit(WHOLE_EXOME).alias("gene_panel_id"))
    return named.union(exome).distinct()


def profiled_rows(t, alteration_type: str = "MUTATION_EXTENDED") -> DataFrame:
    """(sample, panel) rows of one kind of profiling."""
    return t.sample_to_gene_panel_derived.where(F.col("alteration_type") == alteration_type)


def panel_gene_coverage(t, alteration_type: str = "MUTATION_EXTENDED") -> DataFrame:
    """(sample, study, gene, panel): every gene of the sample's named panel."""
    return (
        profiled_rows(t, alteration_type)
        .join(panel_genes(t), "gene_panel_id")
        .select(SAMPLE, STUDY, GENE, "gene_panel_id")
    )


def wes_coverage(t, alteration_type: str = "MUTATION_EXTENDED") -> DataFrame:
    """(sample, study) of whole-exome samples, which cover every gene."""
    return profiled_rows(t, alteration_type).where(F.col("gene_panel_id") == WHOLE_EXOME).select(SAMPLE, STUDY)


def profiled_samples(t, gene: str, alteration: str = "mutation") -> DataFrame:
    """(sample, study) rows profiled for a gene: panel rows, then whole-exome rows, duplicates kept."""
    kind = COVERAGE_TYPE.get(alteration, "")
    panel = panel_gene_coverage(t, kind).where(F.col(GENE) == gene).select(SAMPLE, STUDY)
    return panel.unionByName(wes_coverage(t, kind))


def covered_samples(t, gene: str, alteration: str = "mutation", studies=None) -> DataFrame:
    """Distinct (study, sample) profiled for a gene, in one pass over the coverage table."""
    rows = in_cohort(profiled_rows(t, COVERAGE_TYPE.get(alteration, "")), studies)
    return rows.join(covering_panels(t, gene), "gene_panel_id", "left_semi").select(STUDY, SAMPLE).distinct()


def panel_sets(t, alteration_type: str, keys: list[str], studies=None) -> DataFrame:
    """One row per `keys` with `panels`, the sorted set of panel ids.

    There are few different sets, so counting units per set replaces the product of
    units and genes.
    """
    rows = in_cohort(profiled_rows(t, alteration_type), studies)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("gene_panel_id")).alias("panels"))


def profiled_per_gene(
    t, sets: DataFrame, group: list[str], named_only: bool = False, dedupe: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Profiled units per gene from unit counts per panel set (`panels`, `units`, group keys).

    Returns (per gene on named panels, whole exome per group): a gene's denominator is the
    sum of both. With `dedupe` a unit on the exome and on a named panel counts once;
    without it, or with `named_only`, named panels are counted whatever else the unit is on.
    """
    exome = F.array_contains("panels", WHOLE_EXOME)
    named = sets if named_only or not dedupe else sets.where(~exome)
    genes = (
        named.select(*group, "panels", "units", F.explode("panels").alias("gene_panel_id"))
        .join(panel_genes(t), "gene_panel_id")
        .select(*group, "panels", "units", GENE)
        .distinct()
        .groupBy(*group, GENE)
        .agg(F.sum("units").alias("panel_units"))
    )
    whole = sets.where(exome & F.lit(not named_only)).groupBy(*group).agg(F.sum("units").alias("exome_units"))
    return genes, whole
