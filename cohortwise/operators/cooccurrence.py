"""Which genes are altered together, or in each other's place: every pair of genes of a study at once.

Pairs are made in blocks (`pairs_within`), so neither a study of very many genes nor a sample with
very many altered genes is one task's work. How many samples are profiled for both genes of a pair depends only on the panel sets
that cover each gene; genes covered by the same sets form a class, and there are few classes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.coverage import GENE, SAMPLE, WHOLE_EXOME, panel_genes, panel_sets
from cohortwise.operators.frequency import altered_events
from cohortwise.operators.stats import benjamini_hochberg, fisher_exact
from cohortwise.plans.ranking import null_safe_join
from cohortwise.plans.scope import STUDY, by_study
from cohortwise.session import shared_dir

#: Rows of a group that are paired with one another by one task.
BLOCK = 512


def pairs_within(rows: DataFrame, keys: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """Pairs of rows with equal `keys`, whose `item` is less in the first: columns `<name>_a` and `<name>_b` besides the keys.

    A group is cut into blocks by a hash of the item, and every pair of blocks is joined on its own. Items are
    distinct within a group.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    part = F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int")
    placed = null_safe_join(rows, sizes, keys).withColumn("_part", part)
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.withColumns({"_i": F.least("_part", "_other"), "_j": F.greatest("_part", "_other")})
    values = [c for c in rows.columns if c not in keys]
    unit = [*keys, "_i", "_j"]
    a = placed.select(*unit, F.col("_part").alias("_part_a"), *[F.col(c).alias(f"{c}_a") for c in values])
    b = placed.select(*[F.col(c).alias(f"_r_{c}") for c in unit], F.col("_part").alias("_part_b"), *[F.col(c).alias(f"{c}_b") for c in values])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_i") == F.col("_r__i"), F.col("_j") == F.col("_r__j")])
    once = (F.col(f"{item}_a") < F.col(f"{item}_b")) & ((F.col("_i") == F.col("_j")) | (F.col("_part_a") != F.col("_part_b")))
    return a.join(b, same & once).select(*keys, *[f"{c}_{side}" for side in "ab" for c in values])


def cooccurrence_scan(t, study: str | None = None, min_altered: int = 1) -> DataFrame:
    """Each pair of genes of a study: cells of the 2x2 table, log odds ratio, exact p-value and its correction over the study.

    Genes altered in at least `min_altered` samples of the study are paired. The cells (`both`, `a_only`, `b_only`, `neither`)
    count samples profiled for both genes; pairs without such samples are left out. The odds ratio has 0.5 added to every
    cell, so that its logarithm (`log_odds_ratio`) is finite: above 0 for genes altered together, below for genes that exclude each other.
    """
    studies = None if study is None else [study]
    sets = panel_sets(t, "MUTATION_EXTENDED", [STUDY, SAMPLE], studies).withColumn("panel_set", F.xxhash64("panels"))
    events, _ = by_study(altered_events(t), studies)
    listed = (
        sets.select("panel_set", "panels").distinct()
        .select("panel_set", F.explode("panels").alias("gene_panel_id"))
        .join(panel_genes(t), "gene_panel_id")
        .select("panel_set", GENE).distinct().withColumn("listed", F.lit(True))
    )
    exome = F.array_contains("panels", WHOLE_EXOME)
    # altered genes of each sample that is profiled for them
    altered = (
        events.select(STUDY, SAMPLE, GENE).distinct()
        .join(sets, [STUDY, SAMPLE])
        .join(listed, ["panel_set", GENE], "left")
        .where(F.col("listed") | exome)
        .select(STUDY, SAMPLE, GENE, "panel_set")
    )
    per_set = altered.groupBy(STUDY, GENE, "panel_set").agg(F.count("*").alias("n"))
    enough = per_set.groupBy(STUDY, GENE).agg(F.sum("n").alias("n")).where(F.col("n") >= min_altered).select(STUDY, GENE)
    units = sets.groupBy(STUDY, "panel_set").agg(F.count("*").alias("units"), F.max(exome).alias("exome"))
    named = units.where(~F.col("exome")).join(listed, "panel_set").select(STUDY, "panel_set", GENE)
    whole = units.where(F.col("exome")).select(STUDY, "panel_set").join(enough, STUDY)
    covering = named.join(enough, [STUDY, GENE], "left_semi").unionByName(whole)
    # a gene's class is the list of the panel sets that cover it
    genes = covering.groupBy(STUDY, GENE).agg(F.xxhash64(F.array_sort(F.collect_set("panel_set"))).alias("class"))
    of_class = covering.join(genes, [STUDY, GENE]).select(STUDY, "class", "panel_set").distinct()
    # samples profiled for both classes, and samples with a gene altered that are profiled for another class
    both_classes = of_class.toDF(STUDY, "class_a", "panel_set").join(of_class.toDF(STUDY, "class_b", "panel_set"), [STUDY, "panel_set"])
    profiled = both_classes.join(units, [STUDY, "panel_set"]).groupBy(STUDY, "class_a", "class_b").agg(F.sum("units").alias("profiled"))
    beside = per_set.join(of_class, [STUDY, "panel_set"]).groupBy(STUDY, GENE, "class").agg(F.sum("n").alias("n"))
    together = pairs_within(altered.select(STUDY, SAMPLE, GENE), [STUDY, SAMPLE], GENE).groupBy(STUDY, f"{GENE}_a", f"{GENE}_b").agg(
        F.count("*").alias("both"))
    pairs = (
        pairs_within(genes, [STUDY], GENE)
        .join(profiled, [STUDY, "class_a", "class_b"])
        .join(beside.toDF(STUDY, f"{GENE}_a", "class_b", "n_a"), [STUDY, f"{GENE}_a", "class_b"], "left")
        .join(beside.toDF(STUDY, f"{GENE}_b", "class_a", "n_b"), [STUDY, f"{GENE}_b", "class_a"], "left")
        .join(together, [STUDY, f"{GENE}_a", f"{GENE}_b"], "left")
        .fillna(0, ["n_a", "n_b", "both"])
    )
    both, n_a, n_b = F.col("both"), F.col("n_a"), F.col("n_b")
    cells = pairs.select(
        STUDY, F.col(f"{GENE}_a").alias("gene_a"), F.col(f"{GENE}_b").alias("gene_b"), "both", (n_a - both).alias("a_only"),
        (n_b - both).alias("b_only"), (F.col("profiled") - n_a - n_b + both).alias("neither"))
    more = {c: F.col(c) + F.lit(0.5) for c in ("both", "a_only", "b_only", "neither")}
    odds = F.ln(more["both"] * more["neither"] / (more["a_only"] * more["b_only"]))
    tested = fisher_exact(cells, "both", "a_only", "b_only", "neither").drop("odds_ratio").withColumn("log_odds_ratio", odds)
    # the correction reads the tests several times over
    shared_dir(t.spark)
    scan = benjamini_hochberg(tested.checkpoint(), [STUDY])
    columns = ["gene_a", "gene_b", "both", "a_only", "b_only", "neither", "log_odds_ratio", "p_value", "q_value"]
    return scan.select(*([STUDY] if study is None else []), *columns)
