from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from cohortwise.operators import correlation
from cohortwise.sources.tables import Tables


def table(spark, values: pd.DataFrame):
    frame = values.assign(profile_type="mrna").rename(columns={"study": "cancer_study_identifier", "sample": "sample_unique_id", "gene": "hugo_gene_symbol"})
    return Tables.of(spark, genetic_alteration_derived=spark.createDataFrame(frame.assign(alteration_value=frame.pop("v").astype(str))))


def made(seed: int, genes: int, samples: int, missing: float) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = [
        (study, f"{study}_s{s}", f"g{g}", float(rng.integers(0, 12) if g else 7))
        for study in ("one", "two") for g in range(genes) for s in range(samples) if rng.random() >= missing * (g % 3)]
    return pd.DataFrame(rows, columns=["study", "sample", "gene", "v"])


@pytest.mark.parametrize("missing", [0.0, 0.3])
def test_like_pairwise_ranks(spark, monkeypatch, missing):
    """Several blocks of genes, several patterns of missing values, and a gene that does not vary."""
    monkeypatch.setattr(correlation, "GENES", 3)
    monkeypatch.setattr(correlation, "SAMPLES", 8)
    values = made(4, 8, 25, missing)
    got = {(r.cancer_study_identifier, r.gene_a, r.gene_b): r for r in correlation.correlation_matrix(table(spark, values), None, "mrna").collect()}
    want = 0
    for study, part in values.groupby("study"):
        wide = part.pivot(index="sample", columns="gene", values="v")
        for a in wide:
            for b in wide:
                both = wide[[a, b]].dropna()
                if a >= b or both.empty:
                    continue
                want += 1
                r, ranks = got[study, a, b], both.rank()
                assert r.num_samples == len(both)
                if len(both) < 3 or ranks[a].std() == 0 or ranks[b].std() == 0:
                    assert r.spearman_correlation is None
                else:
                    assert r.spearman_correlation == pytest.approx(np.corrcoef(ranks[a], ranks[b])[0, 1], abs=1e-9)
    assert len(got) == want


def test_genes_that_share_few_or_no_samples(spark):
    rows = [("one", s, g, v) for g, samples in (("a", "123"), ("b", "23"), ("c", "9")) for v, s in enumerate(samples)]
    out = correlation.correlation_matrix(table(spark, pd.DataFrame(rows, columns=["study", "sample", "gene", "v"])), "one", "mrna")
    assert [tuple(r) for r in out.collect()] == [("a", "b", None, 2)]
    assert correlation.correlation_matrix(table(spark, pd.DataFrame(rows, columns=["study", "sample", "gene", "v"])), "none", "mrna").count() == 0


def test_ranks_over_many_ranges_and_slices_without_rows_per_pair(spark, monkeypatch):
    """Ties that cross chunks, ranges of a few places; no step has a row per sample and pair of genes."""
    monkeypatch.setattr(correlation, "GENES", 6)
    monkeypatch.setattr(correlation, "SAMPLES", 20)
    monkeypatch.setattr(correlation, "RANGE", 4)
    monkeypatch.setattr(correlation, "SLICE", 3)
    rng = np.random.default_rng(6)
    rows = [("one", f"s{s}", f"g{g}", float(rng.integers(0, 9) if g % 2 else rng.normal()))
            for g in range(12) for s in range(60) if (s + g) % 7]
    values = pd.DataFrame(rows, columns=["study", "sample", "gene", "v"])
    sizes, real = [], correlation.mean_ranks
    monkeypatch.setattr(correlation, "mean_ranks", lambda rows, *rest: sizes.append(rows.count()) or real(rows, *rest))
    out = correlation.correlation_matrix(table(spark, values), "one", "mrna").collect()
    wide = values.pivot(index="sample", columns="gene", values="v")
    assert len(out) == 66 and sizes == [len(values)]
    for r in out:
        assert r.num_samples == len(wide[[r.gene_a, r.gene_b]].dropna())
        both = wide[[r.gene_a, r.gene_b]].dropna().rank()
        assert r.spearman_correlation == pytest.approx(np.corrcoef(both[r.gene_a], both[r.gene_b])[0, 1], abs=1e-9)
