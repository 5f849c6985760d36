"""Scoping helpers: one study, a named cohort, or everything grouped by study."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUDY = "cancer_study_identifier"


def by_study(df: DataFrame, study: str | list[str] | None) -> tuple[DataFrame, list[str]]:
    """Rows of the study (or studies) and the extra grouping keys.

    A named study adds no key, so results have the columns of a single-study report.
    With `None` every study is computed in the same job and its id becomes a key.
    """
    if study is None:
        return df, [STUDY]
    return df.where(F.col(STUDY).isin(study if isinstance(study, list) else [study])), []


def cohort_studies(preferences: DataFrame, preference: str) -> DataFrame:
    """Distinct study ids of a named cohort; a repeated preference row counts once."""
    return preferences.where(F.col("preference_name") == preference).select(STUDY).distinct()


def in_cohort(df: DataFrame, studies: DataFrame | list[str] | None) -> DataFrame:
    """Rows whose study belongs to the cohort (semi join), a literal list, or all rows."""
    if studies is None:
        return df
    if isinstance(studies, list):
        return df.where(F.col(STUDY).isin(studies))
    return df.join(studies, STUDY, "left_semi")


def distinct_counts(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """(keys, number of distinct values of each column), nulls not counted.

    Combinations are made distinct once; each column is then counted from them on its own, so no row is expanded.
    """
    combinations = rows.select(*keys, *[c.alias(name) for name, c in columns.items()]).distinct()
    counts = [combinations.select(*keys, name).distinct().groupBy(*keys).agg(F.count(name).alias(name)) for name in columns]
    if not keys:
        counts = [c.withColumn("_one", F.lit(1)) for c in counts]
    on = keys or ["_one"]
    first, *rest = counts
    for count in rest:
        other = count.withColumnsRenamed({k: f"_r_{k}" for k in on})
        same = [first[k].eqNullSafe(other[f"_r_{k}"]) for k in on]
        first = first.join(other, reduce(and_, same)).drop(*[f"_r_{k}" for k in on])
    return first.select(*keys, *columns)
