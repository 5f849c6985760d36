"""Continuous per-gene values: rank correlation, contingency tables, group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.labels import profile_family
from cohortwise.functions.values import to_number
from cohortwise.operators.coverage import GENE, SAMPLE, WHOLE_EXOME, covered_samples, panel_genes, profiled_rows
from cohortwise.operators.frequency import altered_events
from cohortwise.plans.ranking import median, null_safe_join, spearman
from cohortwise.plans.scope import STUDY, by_study


def profile_types(t, study: str | None = None) -> DataFrame:
    """Profile types of a study."""
    rows, keys = by_study(t.genetic_alteration_derived, study)
    return rows.select(*keys, "profile_type").distinct()


def profile_families(t, study: str | None = None) -> DataFrame:
    """Rows per profile type with the family it belongs to."""
    rows, keys = by_study(t.genetic_alteration_derived, study)
    counts = rows.groupBy(*keys, "profile_type").agg(F.count("*").alias("rows"))
    return counts.withColumn("family", profile_family("profile_type"))


def gene_values(t, study: str | list[str] | None, profile: str, gene: str | None = None) -> DataFrame:
    """(study, sample, gene, v): values that read as a number; '' and 'NA' are missing."""
    rows, _ = by_study(t.genetic_alteration_derived, study)
    rows = rows.where(F.col("profile_type") == profile)
    if gene is not None:
        rows = rows.where(F.col(GENE) == gene)
    known = F.col("v").isNotNull() & F.col(STUDY).isNotNull() & F.col(SAMPLE).isNotNull() & F.col(GENE).isNotNull()
    return rows.select(STUDY, SAMPLE, GENE, to_number("alteration_value").alias("v")).where(known)


def _counted(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct values per sample with their copies: repeated rows multiply pairs, not join rows."""
    return values.groupBy(*keys, F.col("v").alias(name)).agg(F.count("*").alias(f"{name}_copies"))


def _correlate(a: DataFrame, b: DataFrame, unit: list[str], keys: list[str]) -> DataFrame:
    """Spearman of two value tables on the samples they share; `b` may add group keys."""
    left = _counted(a, unit, "a")
    right = _counted(b, [*unit, *[k for k in keys if k not in unit]], "b")
    pairs = left.join(right, unit).withColumn("copies", F.col("a_copies") * F.col("b_copies"))
    return spearman(pairs, keys, "a", "b", "copies")


def gene_pair_coexpression(t, study: str | None, gene_a: str, gene_b: str, profile_type: str) -> DataFrame:
    """One row: Spearman correlation of two genes on shared samples, NULL under 3 of them."""
    _, keys = by_study(t.genetic_alteration_derived, study)
    a, b = (gene_values(t, study, profile_type, g) for g in (gene_a, gene_b))
    return _correlate(a, b, [STUDY, SAMPLE], keys).select(
        *keys,
        F.lit(gene_a).alias("gene_a"),
        F.lit(gene_b).alias("gene_b"),
        F.lit(profile_type).alias("profile_type"),
        "spearman_correlation",
        "num_samples",
    )


def attribute_coexpression(
    t, study: str | None, profile: str, attribute: str, gene: str | None = None, samples: DataFrame | None = None
) -> DataFrame:
    """Spearman of a gene (or of every gene) with a numeric clinical attribute, optionally on given samples."""
    clinical, study_keys = by_study(t.clinical_data_derived, study)
    values = clinical.where(F.col("attribute_name") == attribute).select(
        STUDY, SAMPLE, to_number("attribute_value").alias("v")
    )
    expression = gene_values(t, study, profile, gene)
    if samples is not None:
        expression = expression.join(samples, SAMPLE, "left_semi")
    return _correlate(values.where(F.col("v").isNotNull()), expression, [STUDY, SAMPLE], [*study_keys, GENE])


def tmb_expression(t, study: str | None, profile: str, gene: str | None = None) -> DataFrame:
    """Spearman of the sample's number of mutations with a gene (or with every gene)."""
    events, study_keys = by_study(altered_events(t, on_panel=False), study)
    burden = events.groupBy(STUDY, SAMPLE).agg(F.count("*").cast("double").alias("v"))
    return _correlate(burden, gene_values(t, study, profile, gene), [STUDY, SAMPLE], [*study_keys, GENE])


def coexpression_scan(t, study: str | None, gene: str, profile: str) -> DataFrame:
    """Spearman of one gene with each other gene of the profile."""
    _, study_keys = by_study(t.genetic_alteration_derived, study)
    others = gene_values(t, study, profile).where(F.col(GENE) != gene)
    return _correlate(gene_values(t, study, profile, gene), others, [STUDY, SAMPLE], [*study_keys, GENE])


def pooled_coexpression(t, studies: list[str], profile: str, gene_a: str, gene_b: str) -> DataFrame:
    """Spearman over several studies; no pairs (hence NULL) unless every one has the profile."""
    a, b = (gene_values(t, list(studies), profile, g) for g in (gene_a, gene_b))
    rows, _ = by_study(t.genetic_alteration_derived, list(studies))
    having = rows.where(F.col("profile_type") == profile).agg(F.count_distinct(STUDY)).scalar()
    complete = a.where(having == F.lit(len(set(studies))))
    return _correlate(complete, b, [STUDY, SAMPLE], []).select(
        F.lit(gene_a).alias("gene_a"), F.lit(gene_b).alias("gene_b"), "spearman_correlation", "num_samples"
    )


def cooccurrence(t, study: str | None, gene_a: str, gene_b: str) -> DataFrame:
    """Two-by-two counts of mutated samples among those profiled for both genes."""
    rows, keys = by_study(profiled_rows(t), study)
    events, _ = by_study(altered_events(t), study)
    genes = {"a": gene_a, "b": gene_b}
    covers = (
        panel_genes(t)
        .where(F.col(GENE).isin(gene_a, gene_b))
        .groupBy("gene_panel_id")
        .agg(*[F.max((F.col(GENE) == g).cast("int")).alias(f"covers_{k}") for k, g in genes.items()])
    )
    exome = F.col("gene_panel_id") == WHOLE_EXOME
    profiled = (
        rows.join(covers, "gene_panel_id", "left")
        .groupBy(STUDY, SAMPLE)
        .agg(*[F.max(F.when(exome, 1).otherwise(F.col(f"covers_{k}"))).alias(f"covers_{k}") for k in genes])
        .where((F.col("covers_a") == 1) & (F.col("covers_b") == 1))
    )
    hits = (
        events.where(F.col(GENE).isin(gene_a, gene_b))
        .groupBy(STUDY, SAMPLE)
        .agg(*[F.max((F.col(GENE) == g).cast("int")).alias(k) for k, g in genes.items()])
    )
    flags = profiled.join(hits, [STUDY, SAMPLE], "left").fillna(0, list(genes))
    cells = {"both": (1, 1), "a_only": (1, 0), "b_only": (0, 1), "neither": (0, 0)}
    return flags.groupBy(*keys).agg(
        *[F.count(F.when((F.col("a") == x) & (F.col("b") == y), 1)).alias(c) for c, (x, y) in cells.items()]
    )


def contingency(t, studies: list[str] | None, gene: str, literal: bool = False) -> DataFrame:
    """Altered and unaltered samples per study, over samples profiled for the gene.

    `literal` takes all samples with an on-panel event as the denominator and leaves out
    status GERMLINE instead of UNCALLED, which undercounts the unaltered.
    """
    if literal:
        events, _ = by_study(t.genomic_event_derived, studies)
        hit = (F.col(GENE) == gene) & (F.col("variant_type") == "mutation") & (F.col("mutation_status") != "GERMLINE")
        units = events.where(F.col("off_panel") == 0).groupBy(STUDY, SAMPLE).agg(F.max(hit).alias("hit"))
    else:
        events, _ = by_study(altered_events(t), studies)
        mutated = events.where(F.col(GENE) == gene).select(STUDY, SAMPLE).distinct().withColumn("hit", F.lit(True))
        units = covered_samples(t, gene, "mutation", studies).join(mutated, [STUDY, SAMPLE], "left")
    hit = F.coalesce("hit", F.lit(False))
    return units.groupBy(STUDY).agg(
        F.count(F.when(hit, 1)).alias("altered"), F.count(F.when(~hit, 1)).alias("unaltered")
    )


def attribute_groups(t, study: str | None, attribute: str, group: str) -> tuple[DataFrame, list[str]]:
    """(study, sample, group value, number) of samples that have both attributes."""
    rows, keys = by_study(t.clinical_data_derived, study)
    name, text = F.col("attribute_name"), F.col("attribute_value")
    wide = (
        rows.where(name.isin(attribute, group) & (F.col(SAMPLE) != ""))
        .groupBy(STUDY, SAMPLE)
        .agg(
            F.max(F.when(name == group, text)).alias("group_value"),
            F.max(F.when(name == attribute, to_number(text))).alias("v"),
        )
    )
    return wide.where(F.col("group_value").isNotNull() & F.col("v").isNotNull()), keys


def group_stats(t, study: str | None, attribute: str, group: str) -> DataFrame:
    """Samples, mean and exact median of a numeric attribute per value of another attribute."""
    rows, keys = attribute_groups(t, study, attribute, group)
    by = [*keys, "group_value"]
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return null_safe_join(means, median(rows, by, "v").drop("n_total"), by)


def resolve_gene(t, term: str, limit: int | None = 50) -> DataFrame:
    """Gene symbols equal to the term, then those starting with it, ignoring case; never merged."""
    symbol = F.upper(GENE)
    found = (
        t.gene.where(symbol.startswith(term.upper()))
        .select(GENE, "entrez_gene_id", (symbol == term.upper()).alias("exact"))
        .distinct()
    )
    return found if limit is None else found.orderBy(F.desc("exact"), GENE, "entrez_gene_id").limit(limit)
