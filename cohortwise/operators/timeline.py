"""Treatment and other timeline events. Counts of patients only: who was treated elsewhere is unknown.

All reports read `clinical_event_derived`: one row per event, key and value with the event's study and
patient (key and value are missing for an event without any), stored by study. A named study is
a filter on that one table, before anything is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.plans.ranking import top_per_group
from cohortwise.plans.scope import STUDY, by_study

# Both spellings of the treatment event type.
TREATMENT = ("Treatment", "TREATMENT")
EVENT = "clinical_event_id"


def _events(t, study) -> tuple[DataFrame, list[str]]:
    return by_study(t.clinical_event_derived, study)


def _given(t, study, key: str, name: str) -> tuple[DataFrame, list[str]]:
    """Rows of one key of treatment events, the value under `name`, and the extra keys."""
    rows, keys = _events(t, study)
    given = rows.where(F.col("event_type").isin(*TREATMENT) & (F.col("key") == key) & F.col("value").isNotNull())
    return given.select(*keys, "patient_id", "patient_unique_id", EVENT, "start_date", F.col("value").alias(name)), keys


def _patients_per_value(t, study, value: str, key: str, count: str, keep: DataFrame | None = None) -> DataFrame:
    given, keys = _given(t, study, key, value)
    if keep is not None:
        given = given.join(keep, "patient_unique_id", "left_semi")
    return given.select(*keys, "patient_id", value).distinct().groupBy(*keys, value).agg(F.count("*").alias(count))


def event_types(t, study: str | None = None) -> DataFrame:
    """Event types with their number of events."""
    rows, keys = _events(t, study)
    return rows.select(*keys, "event_type", EVENT).distinct().groupBy(*keys, "event_type").agg(F.count("*").alias("event_count"))


def treatment_keys(t, study: str | None = None) -> DataFrame:
    """Keys found on treatment events with their number of rows."""
    rows, keys = _events(t, study)
    found = rows.where(F.col("event_type").isin(*TREATMENT) & F.col("key").isNotNull())
    return found.groupBy(*keys, "key").agg(F.count("*").alias("cnt"))


def top_agents(t, study: str | None = None, n: int | None = 20) -> DataFrame:
    """Treatment agents by number of patients, the first `n` of each study (None: all)."""
    counts = _patients_per_value(t, study, "agent", "AGENT", "patient_count")
    order = [F.desc("patient_count"), F.asc("agent")]
    if n is None:
        return counts
    if study is None:
        return top_per_group(counts, [STUDY], order, n)
    return counts.orderBy(*order).limit(n)


def _agent_subtype(t, study, how: str) -> DataFrame:
    agents, keys = _given(t, study, "AGENT", "agent")
    subtypes, _ = _given(t, study, "SUBTYPE", "treatment_subtype")
    subtypes = subtypes.select(F.col(EVENT).alias("_event"), "treatment_subtype").distinct()
    pairs = agents.join(subtypes, F.col(EVENT) == F.col("_event"), how)
    pairs = pairs.select(*keys, "patient_id", "agent", "treatment_subtype").distinct()
    return pairs.groupBy(*keys, "agent", "treatment_subtype").agg(F.count("*").alias("patients"))


def agent_subtype(t, study: str | None = None) -> DataFrame:
    """Patients per agent and subtype; NULL subtype where the event has none."""
    return _agent_subtype(t, study, "left")


def agents_per_category(t, study: str | None = None, n: int | None = None) -> DataFrame:
    """Patients per category and agent, for events that have both; with `n`, the first of each category."""
    counts = _agent_subtype(t, study, "inner").withColumnRenamed("treatment_subtype", "category")
    if n is None:
        return counts
    keys = [STUDY] if study is None else []
    return top_per_group(counts, [*keys, "category"], [F.desc("patients"), F.asc("agent")], n)


def agents_in_category(t, study: str | None, subtype: str) -> DataFrame:
    """Patients per agent of one category."""
    return agents_per_category(t, study).where(F.col("category") == subtype).drop("category")


def treatment_timing(t, study: str | None = None) -> DataFrame:
    """Patients per agent before and after their first sequencing; a tie or an unknown day is after."""
    rows, _ = _events(t, study)
    first = rows.where(F.col("event_type") == "Sequencing").groupBy("patient_id").agg(F.min("start_date").alias("seq_date"))
    given, keys = _given(t, study, "AGENT", "treatment")
    # the earliest and latest day per patient and agent decide both labels
    days = given.groupBy(*keys, "patient_id", "treatment").agg(
        F.min("start_date").alias("earliest"),
        F.max("start_date").alias("latest"),
        F.max(F.col("start_date").isNull()).alias("undated"),
    )
    before = F.coalesce(F.col("earliest") < F.col("seq_date"), F.lit(False))
    after = F.col("undated") | F.col("seq_date").isNull() | (F.col("latest") >= F.col("seq_date"))
    labels: Column = F.array_compact(F.array(F.when(before, "Before Sequencing"), F.when(after, "After Sequencing")))
    return (
        days.join(first, "patient_id")
        .select(*keys, "treatment", F.explode(labels).alias("timing"))
        .groupBy(*keys, "timing", "treatment")
        .agg(F.count("*").alias("patients"))
    )


def treatments_of_mutated(t, study: str | None, gene: str) -> DataFrame:
    """Agents of patients with a mutation of the gene."""
    events, _ = by_study(t.genomic_event_derived, study)
    mutated = (
        events.where((F.col("hugo_gene_symbol") == gene) & (F.col("variant_type") == "mutation"))
        .select("patient_unique_id")
        .distinct()
    )
    return _patients_per_value(t, study, "treatment", "AGENT", "treated_patients", keep=mutated)


def treatment_categories(t, study: str | None = None) -> DataFrame:
    """Patients per treatment category."""
    return _patients_per_value(t, study, "treatment_category", "SUBTYPE", "patient_count")
