from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortwise.plans import ranking


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def brute_spearman(a, b):
    a, b = pd.Series(a).rank(), pd.Series(b).rank()
    if len(a) < 3 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def sample(seed, n=400):
    rng = np.random.default_rng(seed)
    group = rng.choice(["g", "h", "one"], n, p=[0.7, 0.29, 0.01])
    # a third of the values are zero, others lie on both sides and over several magnitudes
    value = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n) * 10.0 ** rng.integers(-3, 6, n)).round(4)
    return pd.DataFrame({"g": group, "a": value, "b": np.where(rng.random(n) < 0.3, 0.0, rng.normal(size=n).round(2))})


def test_mean_ranks(spark):
    pdf = sample(1)
    got = ranking.mean_ranks(frame(spark, pdf), ["g"], "a").toPandas().set_index(["g", "a"])["rank"].to_dict()
    want = pdf.assign(r=pdf.groupby("g")["a"].rank()).groupby(["g", "a"])["r"].first().to_dict()
    assert got == want


def test_median_matches_and_weights_count(spark):
    pdf = sample(2)
    got = {r.g: (r.n_total, r.median) for r in ranking.median(frame(spark, pdf), ["g"], "a").collect()}
    assert got == {g: (len(x), pytest.approx(x["a"].median())) for g, x in pdf.groupby("g")}
    weighted = spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, w long")
    assert rows(ranking.median(weighted, [], "v", "w")) == [(4, 1.0)]


def test_median_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "g string, v double")
    assert rows(ranking.median(df, ["g"], "v")) == [("x", 1, 5.0), (None, 2, 2.0)]


def test_spearman_per_group(spark):
    pdf = sample(3)
    got = {r.g: (r.spearman_correlation, r.num_samples) for r in ranking.spearman(frame(spark, pdf), ["g"], "a", "b").collect()}
    for g, x in pdf.groupby("g"):
        assert got[g][1] == len(x)
        assert got[g][0] == pytest.approx(brute_spearman(x["a"], x["b"]))


def test_spearman_properties(spark):
    pdf = sample(4)
    df = frame(spark, pdf)
    ab = ranking.spearman(df, [], "a", "b").first()
    ba = ranking.spearman(df, [], "b", "a").first()
    assert ab.spearman_correlation == pytest.approx(ba.spearman_correlation)
    same = ranking.spearman(df.selectExpr("a", "a as b"), [], "a", "b").first()
    assert same.spearman_correlation == pytest.approx(1.0)


def test_spearman_edges(spark):
    schema = "a double, b double"
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], schema)
    assert rows(ranking.spearman(constant, [], "a", "b")) == [(None, 3)]
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], schema)
    assert rows(ranking.spearman(two, [], "a", "b")) == [(None, 2)]
    assert rows(ranking.spearman(spark.createDataFrame([], schema), [], "a", "b")) == [(None, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e6, 1e6, width=32), st.integers(-3, 3).map(float)), min_size=1, max_size=30))
def test_spearman_any_values(spark, pairs):
    got = ranking.spearman(spark.createDataFrame(pairs, "a double, b double"), [], "a", "b").first()
    want = brute_spearman(*zip(*pairs))
    if want is None:
        assert got.spearman_correlation is None
    else:
        assert got.spearman_correlation == pytest.approx(want, abs=1e-9)


def largest_window(df, column):
    """Shares of the distinct values that meet in one task of the three ordered steps."""
    slice_, part = ranking.sliced(ranking.value_scale(df[column]))
    cut = df.select(column).distinct().select(slice_.alias("s"), part.alias("p")).toPandas()
    n = len(cut)
    parts = cut.drop_duplicates()
    return parts["s"].nunique() / n, parts.groupby("s").size().max() / n, cut.groupby(["s", "p"]).size().max() / n


@pytest.mark.parametrize("low, high", [(1.60e9, 1.61e9), (0.0, 1.0), (-3.0, 3.0), (0.0, 1e300)])
def test_no_task_ranks_a_whole_group(spark, low, high):
    """Also values that lie close together are cut: the leaf holds a hundredth of them at most."""
    df = spark.range(20000).selectExpr(f"{low}D + ({high}D - {low}D) * id / 20000 as v")
    assert largest_window(df, "v")[2] < 0.01
    assert ranking.median(df, [], "v").first().median == pytest.approx(low + (high - low) * 9999.5 / 20000)


def test_ranks_of_extreme_values(spark):
    values = [-1e308, -1.0, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 2.0, 1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.v, r.n_below) for r in ranking.cumulative(df, [], "v").orderBy("v").collect()]
    assert got == [(-1e308, 0), (-1.0, 1), (0.0, 2), (5e-324, 4), (1.0, 5), (1.0000000000000002, 6), (2.0, 7), (1e308, 8)]
