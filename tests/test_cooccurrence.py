from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from conftest import rows

from cohortwise.operators import cooccurrence, cube, expression, frequency
from cohortwise.plans.scope import STUDY


@pytest.mark.parametrize("block", [1, 3, 512])
def test_pairs_within_are_all_pairs_once(spark, block):
    rng = random.Random(3)
    groups = {k: rng.sample(range(100), n) for k, n in (("a", 40), ("b", 1), ("c", 7), (None, 5))}
    frame = spark.createDataFrame([(k, i, i * 2) for k, own in groups.items() for i in own], "k string, item int, twice int")
    got = [tuple(r) for r in cooccurrence.pairs_within(frame, ["k"], "item", block).collect()]
    want = {(k, x, 2 * x, y, 2 * y) for k, own in groups.items() for x, y in combinations(sorted(own), 2)}
    assert len(got) == len(want) and set(got) == want


def test_cells_equal_those_of_a_pair(tables):
    scan = cooccurrence.cooccurrence_scan(tables).where("gene_a = 'GENE3' and gene_b = 'GENE9'")
    pair = expression.cooccurrence(tables, None, "GENE3", "GENE9")
    cells = [STUDY, "both", "a_only", "b_only", "neither"]
    assert rows(scan, *cells) == rows(pair, *cells)
    r = scan.first()
    assert r.log_odds_ratio == pytest.approx(math.log((r.both + 0.5) * (r.neither + 0.5) / ((r.a_only + 0.5) * (r.b_only + 0.5))))
    assert 0 < r.p_value <= r.q_value <= 1


def test_genes_altered_too_rarely_are_not_paired(tables):
    study = tables.cancer_study.orderBy(STUDY).first()[STUDY]
    few = cooccurrence.cooccurrence_scan(tables, study, min_altered=10**6)
    assert few.count() == 0 and STUDY not in few.columns


def files(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def test_a_changed_study_rewrites_only_its_folder(tables, tmp_path):
    path = tmp_path / "cube"
    cube.refresh(tables, str(path))
    before, names = files(path), sorted(r[STUDY] for r in tables.cancer_study.select(STUDY).collect())
    changed = tables.replace(genomic_event_derived=tables.genomic_event_derived.where(f"{STUDY} != '{names[2]}' or hugo_gene_symbol != 'GENE3'"))
    cube.refresh(changed, str(path), [names[2]])
    after = files(path)
    touched = {str(f) for f in set(before) ^ set(after)} | {str(f) for f in set(before) & set(after) if before[f] != after[f]}
    assert touched and all(f"{STUDY}={names[2]}" in f for f in touched)
    for cohort in [r[0] for r in tables.cancer_study_query_preferences.select("preference_name").distinct().collect()]:
        got = cube.frequencies(changed, str(path)).where(f"preference_name = '{cohort}'").drop("preference_name")
        want = frequency.gene_mutation_frequency_by_cancer_type(changed, cohort)
        assert rows(got, *want.columns) == rows(want)


def test_a_study_that_lost_its_rows_is_forgotten(tables, tmp_path):
    path = str(tmp_path / "cube")
    cube.refresh(tables, path)
    names = [r[STUDY] for r in tables.cancer_study.select(STUDY).collect()]
    empty = tables.replace(genomic_event_derived=tables.genomic_event_derived.limit(0), clinical_data_derived=tables.clinical_data_derived.limit(0))
    cube.refresh(empty, path, names)
    assert cube.frequencies(tables, path, 0).count() == 0
