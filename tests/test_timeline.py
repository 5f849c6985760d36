from __future__ import annotations

from conftest import rows
from tiny import tiny

from cohortwise.operators import timeline


def test_timing_against_the_first_sequencing(spark):
    got = rows(timeline.treatment_timing(tiny(spark), "b_2020"))
    # X on day 5 is before, X on the day itself is after; no day, or no sequencing day, is after
    assert got == [
        ("After Sequencing", "X", 2), ("After Sequencing", "Y", 1), ("After Sequencing", "Z", 1),
        ("Before Sequencing", "X", 1),
    ]


def test_agents_count_patients_not_events(spark):
    t = tiny(spark)
    assert rows(timeline.top_agents(t, "b_2020", 2)) == [("X", 3), ("Y", 1)]
    assert rows(timeline.treatment_categories(t, "b_2020")) == [("Chemo", 2)]
    assert rows(timeline.agents_in_category(t, "b_2020", "Chemo")) == [("X", 2), ("Z", 1)]
    assert rows(timeline.agents_per_category(t, "b_2020", 1), "category", "agent", "patients") == [("Chemo", "X", 2)]
    assert rows(timeline.agent_subtype(t, "b_2020")) == [("X", "Chemo", 2), ("X", None, 2), ("Y", None, 1), ("Z", "Chemo", 1)]


def test_keys_and_types(spark):
    t = tiny(spark)
    assert rows(timeline.treatment_keys(t, "b_2020")) == [("AGENT", 6), ("SUBTYPE", 2)]
    assert rows(timeline.event_types(t, "b_2020")) == [("Sequencing", 3), ("TREATMENT", 1), ("Treatment", 4)]
    assert rows(timeline.event_types(t, "empty_2021")) == []


def test_treatments_of_mutated(spark):
    t = tiny(spark)
    assert rows(timeline.treatments_of_mutated(t, "b_2020", "KRAS")) == [("X", 2), ("Y", 1)]
    assert rows(timeline.treatments_of_mutated(t, "b_2020", "NONE")) == []


def test_a_named_study_is_a_filter_on_the_scan(spark, tables):
    for frame in (timeline.top_agents(tables, "nation_1_msk_2024"), timeline.treatment_timing(tables, "nation_1_msk_2024")):
        scans = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
        assert scans and all("cancer_study_identifier" in line.split("PushedFilters")[1] for line in scans)
