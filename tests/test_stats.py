from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cohortwise.operators import stats


def brute_fisher(a, b, c, d):
    row, col, total = a + b, a + c, a + b + c + d
    weights = {x: math.comb(row, x) * math.comb(total - row, col - x) for x in range(max(0, col - total + row), min(row, col) + 1)}
    return sum(w for w in weights.values() if w <= weights[a] * (1 + 1e-7)) / math.comb(total, col)


def test_fisher(spark):
    rng = np.random.default_rng(5)
    cells = [(3, 1, 1, 3), (0, 5, 5, 0), (10, 0, 0, 0), (0, 0, 3, 4), (12, 5, 29, 2), (1, 9, 11, 3)]
    cells += [tuple(int(x) for x in rng.integers(0, 60, 4)) for _ in range(60)]
    got = stats.fisher_exact(spark.createDataFrame(cells, "a long, b long, c long, d long")).collect()
    for r in got:
        assert r.p_value == pytest.approx(brute_fisher(r.a, r.b, r.c, r.d), rel=1e-6, abs=1e-300)
        assert r.odds_ratio == (None if r.b * r.c == 0 else pytest.approx(r.a * r.d / (r.b * r.c)))


def test_fisher_on_large_counts(spark):
    df = spark.createDataFrame([(10**6, 9 * 10**6, 10**6 + 500, 9 * 10**6)], "a long, b long, c long, d long")
    p = stats.fisher_exact(df).first().p_value
    assert 0 < p < 1


def grouped(spark, seed, n=300, groups="xyz"):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice(["p", "q"], n), "g": rng.choice(list(groups), n), "v": rng.integers(0, 40, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_chi_squared_with_an_empty_cell(spark):
    counts = [("x", "a", 10), ("x", "b", 20), ("y", "a", 30)]
    got = stats.chi_squared(spark.createDataFrame(counts, "r string, c string, n long"), [], "r", "c", "n").first()
    table = np.array([[10, 20], [30, 0]])
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert got.chi2 == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert got.dof == 1 and got.min_expected == pytest.approx(expected.min())


def test_rank_tests(spark):
    pdf, df = grouped(spark, 6)
    for k, part in pdf.groupby("k"):
        ranks = part["v"].rank()
        n, ties = len(part), sum(c**3 - c for c in Counter(part["v"]).values())
        sums = ranks.groupby(part["g"]).agg(["sum", "count"])
        h = (12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["count"]).sum() - 3 * (n + 1)) / (1 - ties / (n**3 - n))
        got = stats.kruskal_wallis(df, ["k"], "g", "v").where(f"k = '{k}'").first()
        assert got.h == pytest.approx(h) and got.dof == 2
        w = stats.wilcoxon(df, ["k"], "g", "v").where(f"k = '{k}' and g = 'x'").first()
        size = sums.loc["x", "count"]
        u = sums.loc["x", "sum"] - size * (size + 1) / 2
        sigma = math.sqrt(size * (n - size) / 12 * ((n + 1) - ties / (n * (n - 1))))
        assert w.u_statistic == pytest.approx(u) and w.z == pytest.approx((u - size * (n - size) / 2) / sigma)


def test_moments_tests(spark):
    pdf, df = grouped(spark, 7)
    x, y = (pdf.loc[pdf.g == g, "v"] for g in "xy")
    pooled = ((len(x) - 1) * x.var() + (len(y) - 1) * y.var()) / (len(x) + len(y) - 2)
    got = stats.t_statistic(df, [], "g", "v", "x", "y").first()
    assert got.t == pytest.approx((x.mean() - y.mean()) / math.sqrt(pooled * (1 / len(x) + 1 / len(y))))
    means, sizes = pdf.groupby("g")["v"].mean(), pdf.groupby("g")["v"].count()
    between = (sizes * (means - pdf["v"].mean()) ** 2).sum() / 2
    within = ((pdf["v"] - pdf["g"].map(means)) ** 2).sum() / (len(pdf) - 3)
    assert stats.anova(df, [], "g", "v").first().f == pytest.approx(between / within)


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([10.0 ** -rng.uniform(1, 12, 150), rng.random(100).round(2), [0.0, 1.0]])
    order = np.argsort(p)
    adjusted = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(adjusted[::-1])[::-1], 1)
    want = {i: q[r] for r, i in enumerate(order)}
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(p)], "i int, p_value double")
    got = {r.i: r.q_value for r in stats.benjamini_hochberg(df, []).collect()}
    assert len(got) == len(p)
    for i, x in got.items():
        assert x == pytest.approx(want[i], rel=1e-9)


def test_kaplan_meier(spark):
    data = [(6.0, True), (6.0, True), (6.0, True), (6.0, False), (7.0, True), (9.0, False), (10.0, True), (10.0, False),
            (11.0, False), (13.0, True), (16.0, True), (None, True), (17.0, False)]
    df = spark.createDataFrame(data, "m double, e boolean")
    known = [x for x in data if x[0] is not None]
    survival, want = 1.0, []
    for time in sorted({m for m, e in known if e}):
        risk = sum(m >= time for m, _ in known)
        died = sum(m == time and e for m, e in known)
        survival *= 1 - died / risk
        want.append((time, risk, died, survival))
    got = [tuple(r) for r in stats.kaplan_meier(df, [], "m", "e").orderBy("m").collect()]
    assert got == [(*w[:3], pytest.approx(w[3])) for w in want]
    assert stats.median_survival(df, [], "m", "e").first()[0] == next(t for t, *_, s in want if s <= 0.5)


def test_survival_that_ends_at_zero_and_never_reaches_half(spark):
    ends = spark.createDataFrame([(1.0, True), (2.0, True)], "m double, e boolean")
    assert [r.survival for r in stats.kaplan_meier(ends, [], "m", "e").orderBy("m").collect()] == [pytest.approx(0.5), 0.0]
    stays = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, False), (4.0, False)], "m double, e boolean")
    assert stats.median_survival(stays, [], "m", "e").first()[0] is None


def test_anova_of_large_values(spark):
    """Values near a billion: the spread between groups is a difference of large sums unless it is taken about the mean."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": ["a"] * 100 + ["b"] * 100, "v": 1e9 + np.concatenate((rng.normal(0, 1, 100), rng.normal(1, 1, 100)))})
    centred = pdf["v"] - 1e9
    a, b = centred[:100], centred[100:]
    between = 100 * ((a.mean() - centred.mean()) ** 2 + (b.mean() - centred.mean()) ** 2)
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    got = stats.anova(spark.createDataFrame(pdf), [], "g", "v").first()
    assert got.f == pytest.approx(between / (within / 198), rel=1e-5) and 0 < got.p_value < 1e-6
    assert stats.anova(spark.createDataFrame(pdf).where("g = 'c'"), ["g"], "g", "v").count() == 0


def test_anova_reads_the_values_once(spark):
    """The mean of all values comes from the groups, whatever the keys; missing keys and groups are such of their own."""
    values = [(k, g, float(v)) for k in ("x", None) for g, v in [("a", 1), ("a", 2), ("b", 4), ("b", 7), (None, 3), (None, 5)]]
    frame = spark.createDataFrame(values, "k string, g string, v double").repartition(2, "v")
    found = stats.anova(frame, ["k"], "g", "v")
    got = {r.k: (r.f, r.dof_between, r.dof_within) for r in found.collect()}
    assert got == {k: (pytest.approx(3.5), 2, 3) for k in ("x", None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def gamma_series(a, x):
    n = int(x + 60 * math.sqrt(x + a) + 400)
    return 1 - math.fsum(math.exp((a + k) * math.log(x) - x - math.lgamma(a + k + 1)) for k in range(n))


def beta_series(x, a, b):
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_series(1 - x, b, a)
    log = math.lgamma(a + b), math.lgamma(b)
    return math.fsum(
        math.exp(math.lgamma(a + b + k) - math.lgamma(a + k + 1) - log[1] + (a + k) * math.log(x) + b * math.log1p(-x)) for k in range(60_000))


def test_tails_like_their_series(spark):
    from pyspark.sql import functions as F

    from cohortwise.functions import distributions as tails

    grid = [(float(x), d) for x in (1e-9, 0.3, 1, 5, 30, 100, 1000) for d in (1, 2, 3, 10, 99, 1000)]
    x, d = F.col("x"), F.col("d")
    out = spark.createDataFrame(grid, "x double, d int").select(
        "x", "d", tails.chi_squared_tail(x, d).alias("chi2"), tails.normal_two_sided(F.sqrt("x")).alias("z"),
        tails.t_two_sided(F.sqrt("x"), d).alias("t"), tails.f_tail(x, F.lit(3), d).alias("f"), tails.log_gamma(d / 2).alias("log_gamma"))
    for r in out.collect():
        assert r.chi2 == pytest.approx(gamma_series(r.d / 2, r.x / 2), abs=1e-10)
        assert r.z == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-11, abs=1e-300)
        assert r.t == pytest.approx(beta_series(r.d / (r.d + r.x), r.d / 2, 0.5), abs=1e-10)
        assert r.f == pytest.approx(beta_series(r.d / (r.d + 3 * r.x), r.d / 2, 1.5), abs=1e-10)
        assert r.log_gamma == pytest.approx(math.lgamma(r.d / 2), rel=1e-13, abs=1e-13)


def test_tails_at_their_ends(spark):
    from pyspark.sql import functions as F

    from cohortwise.functions import distributions as tails

    rows = [(0.0, 1), (None, 1), (1.0, None), (1.0, 0), (-1e-12, 2), (1e6, 3)]
    x, d = F.col("x"), F.col("d")
    got = [tuple(r) for r in spark.createDataFrame(rows, "x double, d int").select(
        tails.chi_squared_tail(x, d), tails.f_tail(x, F.lit(2), d), tails.t_two_sided(x, d)).collect()]
    assert got[0] == (1.0, 1.0, 1.0) and got[1] == got[2] == got[3] == (None, None, None)
    assert got[4][0] == 1.0 and got[5][0] < 1e-300 and got[5][2] < 1e-15


def test_log_rank_like_its_definition(spark):
    rng = np.random.default_rng(8)
    people = pd.DataFrame({
        "k": rng.choice(["p", "q"], 240), "id": np.arange(240), "m": rng.integers(0, 25, 240).astype(float), "e": rng.integers(0, 2, 240).astype(bool)})
    sets = [(k, g, i) for k, i in zip(people["k"], people["id"]) for g in "xyz" if rng.random() < {"x": 0.5, "y": 0.1, "z": 0.9}[g]]
    sets += sets[:20] + [("p", "none", 9999), ("p", "all", None)] + [("q", "all", i) for k, i in zip(people["k"], people["id"]) if k == "q"]
    frame = spark.createDataFrame(people).union(spark.createDataFrame([("p", 5000, None, True), ("p", 5001, 3.0, None)], "k string, id long, m double, e boolean"))
    out = stats.log_rank(frame, spark.createDataFrame(sets, "k string, g string, id long"), ["k"], ["g"], "id", "m", "e")
    got = {(r.k, r.g): r for r in out.collect()}
    assert set(got) == {(k, g) for k in "pq" for g in "xyz"} | {("q", "all")}
    for (k, g), r in got.items():
        rows = people[people["k"] == k]
        mine = rows["id"].isin({i for a, b, i in sets if (a, b) == (k, g)})
        expected = variance = 0.0
        for at in sorted(rows["m"].unique()):
            risk = rows["m"] >= at
            d, n, m = int((rows["e"] & (rows["m"] == at)).sum()), int(risk.sum()), int((risk & mine).sum())
            expected += d * m / n
            variance += d * (m / n) * (1 - m / n) * (n - d) / (n - 1) if n > 1 else 0.0
        assert r.members == mine.sum() and r.observed == (rows["e"] & mine).sum()
        assert r.expected == pytest.approx(expected) and r.variance == pytest.approx(variance, abs=1e-9)
        if variance > 1e-9:
            assert r.chi2 == pytest.approx((r.observed - expected) ** 2 / variance)
            assert r.p_value == pytest.approx(gamma_series(0.5, r.chi2 / 2), abs=1e-9)
        else:
            assert r.chi2 is None and r.p_value is None
