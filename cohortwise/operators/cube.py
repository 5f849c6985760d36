"""Mutation frequencies of any cohort from stored counts of its studies.

A sample belongs to one study, so counts of samples per study, cancer type and gene add up over the studies of a cohort,
and so do profiled samples per panel set. Both are stored in one folder per study; when studies
change, only theirs are counted and written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.labels import COVERAGE_TYPE
from cohortwise.functions.values import percent
from cohortwise.operators.coverage import GENE, SAMPLE, panel_sets, profiled_per_gene
from cohortwise.operators.frequency import TYPE, altered_events
from cohortwise.plans.scope import STUDY, in_cohort

PARTS = ("altered", "profiled")


def counts(t, alteration: str = "mutation", studies: list[str] | None = None) -> dict[str, DataFrame]:
    """What is stored: `altered` samples per study, type and gene, and `profiled` samples per study, type and panel set."""
    unit = [STUDY, SAMPLE]
    types = (
        in_cohort(t.clinical_data_derived, studies)
        .where((F.col("attribute_name") == "CANCER_TYPE") & (F.col(SAMPLE) != ""))
        .select(*unit, F.col("attribute_value").alias(TYPE))
        .distinct()
    )
    events = in_cohort(altered_events(t, alteration), studies).select(*unit, GENE).distinct()
    sets = panel_sets(t, COVERAGE_TYPE.get(alteration, ""), unit, studies)
    return {
        "altered": events.join(types, unit).groupBy(STUDY, TYPE, GENE).agg(F.count("*").alias("units")),
        "profiled": sets.join(types, unit).groupBy(STUDY, TYPE, "panels").agg(F.count("*").alias("units")),
    }


def refresh(t, path: str, studies: list[str] | None = None, alteration: str = "mutation") -> None:
    """Count the given studies (None: all) and replace their folders under `path`; other studies' files are not touched.

    Each folder is replaced when its new files are complete, so a run that fails leaves it as it was and can be
    repeated. A study that has lost all its rows gets a folder without counts.
    """
    listed = t.cancer_study.select(STUDY).distinct() if studies is None else t.spark.createDataFrame([(s,) for s in dict.fromkeys(studies)], f"{STUDY} string")
    for part, rows in counts(t, alteration, studies).items():
        # a row without a type stands for the study itself
        kept = rows.unionByName(listed.select(STUDY), allowMissingColumns=True)
        layout = kept.repartition(STUDY).sortWithinPartitions(STUDY, *(c for c in (TYPE, GENE) if c in rows.columns))
        layout.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(STUDY).parquet(f"{path}/{part}")


def _stored(t, path: str, part: str) -> DataFrame:
    shape = {"altered": f"{TYPE} string, {GENE} string", "profiled": f"{TYPE} string, panels array<string>"}[part]
    rows = t.spark.read.schema(f"{shape}, units long, {STUDY} string").parquet(f"{path}/{part}")
    return rows.where(F.col(TYPE).isNotNull())


def frequencies(t, path: str, min_profiled: int = 50) -> DataFrame:
    """(preference_name, cancer_type, gene, altered_samples, profiled_samples, frequency_pct) of every named cohort, in one job.

    Equal to `gene_mutation_frequency_by_cancer_type` of each cohort; only stored counts are read. Filter on
    `preference_name` for one cohort: then only the folders of its studies are read.
    """
    cohorts = t.cancer_study_query_preferences.select("preference_name", STUDY).distinct()
    group = ["preference_name", TYPE]
    altered, sets = (_stored(t, path, part).join(cohorts, STUDY) for part in PARTS)
    altered = altered.groupBy(*group, GENE).agg(F.sum("units").alias("altered_samples"))
    named, exome = profiled_per_gene(t, sets.groupBy(*group, "panels").agg(F.sum("units").alias("units")), group)
    profiled = F.coalesce("panel_units", F.lit(0)) + F.coalesce("exome_units", F.lit(0))
    rows = altered.join(named, [*group, GENE], "left").join(exome, group, "left").withColumn("profiled_samples", profiled)
    return rows.where(F.col("profiled_samples") >= min_profiled).select(
        *group, GENE, "altered_samples", "profiled_samples", percent(F.col("altered_samples"), F.col("profiled_samples")).alias("frequency_pct"))
