from __future__ import annotations

import pytest
from conftest import rows
from tiny import tiny

from cohortwise.operators import catalog

FIELDS = "code string, name string, main_type string, tissue string, parent string, level int, revocations array<string>, precursors array<string>"
TREE = [
    ("LUNG", "Lung", None, "Lung", None, 1, None, None),
    ("NSCLC", "Non-Small Cell Lung Cancer", "Non-Small Cell Lung Cancer", "Lung", "LUNG", 2, None, None),
    ("LUAD", "Lung Adenocarcinoma", "Non-Small Cell Lung Cancer", "Lung", "NSCLC", 3, ["OLDLU"], ["PRE1", "pre2"]),
    ("ALL2", "B-Cell Leukemia", "Leukemia", "Lymphoid", "MISSING", 2, ["ALL"], None),
    ("TLL", "T-Cell Leukemia", "Leukemia", "Lymphoid", "MISSING", 2, ["ALL"], None),
    ("CYC1", "Cycle One", "Cycle", "Other", "CYC2", 2, None, None),
    ("CYC2", "Cycle Two", "Cycle", "Other", "CYC1", 2, None, None),
]
TERMS = ["luad", " LUAD ", "all", "lung", "non-small cell lung cancer", "leukemia", "cell", "lymph", "c", "pre2", "a%", "  ", "zzz", "cyc"]


@pytest.fixture(scope="module")
def onco(spark):
    return spark.createDataFrame(TREE, FIELDS)


def expected(term):
    """The rules stated one by one, the first that holds decides."""
    q = term.strip().lower()
    found = []
    for code, name, main, tissue, _, _, revoked, precursors in TREE:
        code_, name_, main_, tissue_ = (x.lower() if x else "" for x in (code, name, main, tissue))
        old = [x.lower() for x in (revoked or []) + (precursors or [])]
        holds = [
            (100, q == code_), (90, q in old), (80, q == name_), (70, code_.startswith(q)), (65, q == main_),
            (60, name_.startswith(q)), (50, q in name_), (45, q in main_), (40, q in tissue_),
        ]
        score = next((s for s, ok in holds if ok), 0) if q else 0
        if score:
            found.append((term, code, score))
    return found


def test_search_follows_the_rules(spark, onco):
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "luad"]], "term string")
    got = rows(catalog.search_taxonomy(onco, terms), "term", "code", "score")
    assert set(got) == {x for t in TERMS for x in expected(t)}
    assert len(got) == len(set(got))


def test_search_details(spark, onco):
    terms = spark.createDataFrame([("luad",), ("pre2",)], "term string")
    hit = catalog.search_taxonomy(onco, terms).where("term = 'pre2'").first()
    assert (hit.code, hit.score, hit.hierarchy, hit.replaced_codes) == ("LUAD", 90, "LUNG > NSCLC > LUAD", "OLDLU,PRE1,pre2")


def test_search_limit_prefers_score_then_code(spark, onco):
    terms = spark.createDataFrame([("l",)], "term string")
    got = catalog.search_taxonomy(onco, terms, limit=2).select("code", "score").collect()
    best = sorted(expected("l"), key=lambda r: (-r[2], r[1]))[:2]
    assert sorted(map(tuple, got)) == sorted((c, s) for _, c, s in best)


def test_paths_end_at_unknown_parent_and_cycle(onco):
    paths = dict(rows(catalog.taxonomy_paths(onco)))
    assert paths["LUAD"] == "LUNG > NSCLC > LUAD"
    assert paths["TLL"] == "TLL"
    assert paths["CYC1"] == "CYC2 > CYC1" and paths["CYC2"] == "CYC1 > CYC2"


def test_retired_codes(onco):
    assert rows(catalog.retired_codes(onco)) == [
        ("ALL", "ALL2"), ("ALL", "TLL"), ("OLDLU", "LUAD"), ("PRE1", "LUAD"), ("pre2", "LUAD")]


def test_resolve_and_similar(spark):
    t = tiny(spark)
    requested = spark.createDataFrame([("B_2020",), ("xx_2020",), ("b-20",), ("bad id",)], "requested_id string")
    got = {r[0]: r[1:] for r in rows(catalog.resolve_studies(t, requested))}
    assert got["B_2020"] == ("b_2020", True, True)
    assert got["xx_2020"] == (None, False, True) and got["bad id"] == (None, False, False)
    # parts under three characters are ignored
    assert rows(catalog.similar_studies(t, requested), "requested_id", "cancer_study_identifier") == [
        ("B_2020", "b_2020"), ("xx_2020", "b_2020")]


def test_similar_is_limited_per_request(spark):
    studies = [(i, f"lung_{i:03d}", "n", "d", "x") for i in range(30)]
    t = tiny(spark, cancer_study=studies)
    requested = spark.createDataFrame([("lung_x",), ("LUNG-y",)], "requested_id string")
    got = rows(catalog.similar_studies(t, requested), "requested_id", "cancer_study_identifier")
    assert [g[1] for g in got if g[0] == "lung_x"] == [f"lung_{i:03d}" for i in range(10)]
    assert len(got) == 20


def test_list_limit_is_clamped(spark):
    t = tiny(spark, cancer_study=[(i, f"s{i:03d}", "n", "d", "x") for i in range(130)])
    assert catalog.list_studies(t, limit=1000).count() == 100
    everything = t.cancer_study.count()
    assert catalog.list_studies(t, limit=1000, at_most=None).count() == catalog.list_studies(t, limit=None, at_most=None).count() == everything > 100
    assert catalog.list_studies(t, limit=-5).count() == 1
    assert rows(catalog.list_studies(t, search="S00", limit=3, guides=("s001",)), "cancer_study_identifier", "has_guide") == [
        ("s000", False), ("s001", True), ("s002", False)]


def test_search_term_wildcards_are_literal(spark):
    assert catalog.list_studies(tiny(spark), search="%").count() == 0


def test_profile_of_a_study_without_rows(spark):
    t = tiny(spark).replace(genetic_profile=spark.createDataFrame(
        [], "cancer_study_id int, genetic_alteration_type string, datatype string, name string"))
    got = rows(catalog.study_profile(t, "empty_2021"), "section", "name", "detail", "count")
    assert got[:3] == [("counts", "patients", None, 0), ("counts", "samples", None, 0), ("header", "cancer_type", "bb", None)]


def test_rollup_counts_each_unit_once_per_ancestor(spark):
    onco = spark.createDataFrame(
        [("R", None), ("A", "R"), ("B", "R"), ("A1", "A"), ("A2", "A"), ("A11", "A1"), ("LONE", "GONE"), ("X", "Y"), ("Y", "X")], "code string, parent string")
    coded = spark.createDataFrame(
        [("a11", 1), ("A1", 1), ("A2", 1), ("B", 1), ("a2", 2), ("A2", 2), ("lone", 3), ("x", 4), ("y", 4), ("unknown", 5), (None, 6), ("A", None)],
        "code string, unit int")
    got = {r.code: (r.depth, r.own, r.total) for r in catalog.taxonomy_rollup(onco, coded, "unit").collect()}
    assert got == {"R": (1, 0, 2), "A": (2, 0, 2), "B": (2, 1, 1), "A1": (3, 1, 1), "A2": (3, 2, 2), "A11": (4, 1, 1), "LONE": (1, 1, 1), "X": (2, 1, 1), "Y": (2, 1, 1)}
    by = catalog.taxonomy_rollup(onco, coded.selectExpr("*", "unit % 2 as odd"), "unit", ["odd"])
    assert {(r.odd, r.code): r.total for r in by.collect() if r.total} == {
        (1, "R"): 1, (1, "A"): 1, (1, "B"): 1, (1, "A1"): 1, (1, "A2"): 1, (1, "A11"): 1, (1, "LONE"): 1, (0, "R"): 1, (0, "A"): 1, (0, "A2"): 1, (0, "X"): 1, (0, "Y"): 1}


def test_paths_deeper_than_any_limit(spark):
    chain = spark.range(3000).selectExpr("cast(id as string) as code", "if(id = 0, null, cast(id - 1 as string)) as parent")
    longest = catalog.taxonomy_closure(chain).groupBy().max("distance").first()[0]
    assert longest == 2999
