"""Group-comparison statistics on counts and ranks made by Spark.

The counting, ranking and summing run as DataFrame aggregations over all rows; only the
finished tables of counts (one row per comparison) reach the p-value function.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortwise.functions.distributions import chi_squared_tail, f_tail, normal_two_sided, t_two_sided
from cohortwise.plans.ranking import cumulative, mean_ranks, null_safe_join, running_sum, sliced, value_scale


def fisher_exact(tables: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Two-by-two tables with `odds_ratio` and two-sided `p_value`, one comparison per row."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_fisher(*map(int, cells)) for cells in zip(a, b, c, d)], dtype="float64")

    cells = [F.col(x).cast("bigint") for x in (a, b, c, d)]
    ratio = (cells[0].cast("double") * cells[3]) / F.nullif(cells[1].cast("double") * cells[2], F.lit(0e0))
    return tables.withColumn("odds_ratio", ratio).withColumn("p_value", p_value(*cells))


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: probability of all tables with the same margins that are no more likely.

    Walks outwards from the mode with the ratio of neighbouring terms and stops where the
    terms no longer add to the sum, so the cost follows the spread and not the table size.
    """
    row, col, total = a + b, a + c, a + b + c + d
    low, high = max(0, col - (total - row)), min(row, col)
    if low == high:
        return 1.0
    mode = min(high, max(low, (row + 1) * (col + 1) // (total + 2)))

    def up(x: int) -> float:
        return (row - x) * (col - x) / ((x + 1) * (total - row - col + x + 1))

    def log_weight(x: int) -> float:
        return -sum(math.lgamma(v + 1) for v in (x, row - x, col - x, total - row - col + x))

    top = log_weight(mode)
    limit = math.exp(log_weight(a) - top) * (1 + 1e-7)
    whole = tail = 0.0
    for start, step in ((mode, 1), (mode - 1, -1)):
        if not low <= start <= high:
            continue
        weight = 1.0 if step == 1 else 1.0 / up(start)
        x = start
        while True:
            whole += weight
            if weight <= limit:
                tail += weight
            if x == (high if step == 1 else low) or weight < 1e-18 * min(limit, 1.0):
                break
            weight = weight * up(x) if step == 1 else weight / up(x - 1)
            x += step
    return min(1.0, tail / whole)


def chi_squared(counts: DataFrame, keys: list[str], row: str, column: str, n: str) -> DataFrame:
    """Chi-squared statistic per `keys` of a contingency table in long form.

    Returns `chi2`, `dof`, `min_expected` (a value under 5 makes the test unreliable) and `p_value`.
    Cells without a row count as zero: their expected counts add up to what is missing.
    """
    cells = counts.groupBy(*keys, row, column).agg(F.sum(n).alias("_n"))
    rows = cells.groupBy(*keys, row).agg(F.sum("_n").alias("_row"))
    columns = cells.groupBy(*keys, column).agg(F.sum("_n").alias("_col"))
    totals = rows.groupBy(*keys).agg(
        F.sum("_row").alias("_total"), F.count("*").alias("_rows"), F.min("_row").alias("_min_row")
    )
    widths = columns.groupBy(*keys).agg(F.count("*").alias("_cols"), F.min("_col").alias("_min_col"))
    # chi2 = N * (sum n^2 / (row * col) - 1), which needs the present cells only
    share = F.col("_n").cast("double") * F.col("_n") / (F.col("_row").cast("double") * F.col("_col"))
    sums = _with(_with(cells, rows, [*keys, row]), columns, [*keys, column]).groupBy(*keys).agg(
        F.sum(share).alias("_share"), F.max("_row").alias("_any")
    )
    both = _with(_with(sums, totals, keys), widths, keys)
    tested = both.select(
        *keys,
        (F.col("_total") * (F.col("_share") - 1)).alias("chi2"),
        ((F.col("_rows") - 1) * (F.col("_cols") - 1)).alias("dof"),
        (F.col("_min_row").cast("double") * F.col("_min_col") / F.col("_total")).alias("min_expected"),
    )
    return tested.withColumn("p_value", chi_squared_tail(F.col("chi2"), F.col("dof")))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys; tables without keys have one row each and meet on a literal."""
    if keys:
        return null_safe_join(left, right, keys)
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def rank_sums(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Per group: size, rank sum and Mann-Whitney U against all other groups together."""
    counted = values.groupBy(*keys, group, value).agg(F.count("*").alias("_copies"))
    ranks = mean_ranks(counted, keys, value, "_copies").select(*keys, value, "rank", "n_total")
    summed = null_safe_join(counted, ranks, [*keys, value]).groupBy(*keys, group).agg(
        F.sum("_copies").alias("n"),
        F.sum(F.col("_copies") * F.col("rank")).alias("rank_sum"),
        F.max("n_total").alias("n_total"),
    )
    n = F.col("n")
    return summed.withColumn("u_statistic", F.col("rank_sum") - n * (n + 1) / F.lit(2e0))


def wilcoxon(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Rank sums per group with the normal-approximation z score, ties corrected, and its two-sided p-value."""
    ties = _ties(values, keys, value)
    sums = rank_sums(values, keys, group, value)
    n, rest, total = F.col("n"), F.col("n_total") - F.col("n"), F.col("n_total")
    tie_free = (total + 1) - F.col("_tie_sum") / F.nullif(total * (total - 1), F.lit(0))
    spread = F.sqrt(n.cast("double") * rest / 12 * tie_free)
    z = (F.col("u_statistic") - n.cast("double") * rest / 2) / F.nullif(spread, F.lit(0e0))
    tested = _with(sums, ties, keys).select(*keys, group, "n", "rank_sum", "u_statistic", z.alias("z"))
    return tested.withColumn("p_value", normal_two_sided(F.col("z")))


def kruskal_wallis(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H per `keys`, ties corrected, with its degrees of freedom and p-value."""
    sums = rank_sums(values, keys, group, value)
    total = F.max("n_total").cast("double")
    h = F.lit(12e0) / (total * (total + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (total + 1)
    folded = sums.groupBy(*keys).agg(
        h.alias("_h"), F.count("*").alias("groups"), total.alias("_total"), F.min("n").alias("min_n")
    )
    n = F.col("_total")
    correction = F.lit(1e0) - F.col("_tie_sum") / F.nullif(n * n * n - n, F.lit(0e0))
    tested = _with(folded, _ties(values, keys, value), keys).select(
        *keys, (F.col("_h") / F.nullif(correction, F.lit(0e0))).alias("h"), (F.col("groups") - 1).alias("dof"), "min_n"
    )
    return tested.withColumn("p_value", chi_squared_tail(F.col("h"), F.col("dof")))


def _ties(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    n = F.col("n").cast("double")
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.sum(n * n * n - n).alias("_tie_sum"))


def moments(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    return values.groupBy(*keys, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")
    )


def t_statistic(values: DataFrame, keys: list[str], group: str, value: str, first: str, second: str) -> DataFrame:
    """Student's t of two groups with pooled variance, its degrees of freedom and two-sided p-value."""
    stats = moments(values.where(F.col(group).isin(first, second)), keys, group, value)

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col(group) == name, F.col(column)))

    n1, n2 = of(first, "n"), of(second, "n")
    dof = n1 + n2 - 2
    pooled = ((n1 - 1) * of(first, "variance") + (n2 - 1) * of(second, "variance")) / F.nullif(dof, F.lit(0))
    error = F.sqrt(pooled * (F.lit(1e0) / n1 + F.lit(1e0) / n2))
    t = (of(first, "mean") - of(second, "mean")) / F.nullif(error, F.lit(0e0))
    return stats.groupBy(*keys).agg(t.alias("t"), dof.alias("dof")).withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))


def anova(values: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way F from group sizes, means and variances, with its degrees of freedom and p-value.

    The spread between groups is summed from their distances to the mean of all values, so it
    keeps its digits when the values are large against it.
    """
    groups = moments(values.where(F.col(value).isNotNull()), keys, group, value)
    size = F.col("n")
    # over the few rows of `groups`, so that the values are read once
    alike = W.partitionBy(*keys, "_one")
    grand = F.sum(size * F.col("mean")).over(alike) / F.sum(size).over(alike)
    apart = F.col("mean") - F.col("_grand")
    sums = groups.withColumn("_one", F.lit(1)).withColumn("_grand", grand).groupBy(*keys).agg(
        F.sum(size * apart * apart).alias("_between"), F.sum((size - 1) * F.coalesce("variance", F.lit(0e0))).alias("_within"),
        F.sum(size).alias("_total"), F.count("*").alias("_groups"))
    between, within = F.col("_groups") - 1, F.col("_total") - F.col("_groups")
    f = (F.col("_between") / F.nullif(between, F.lit(0))) / F.nullif(F.col("_within") / F.nullif(within, F.lit(0)), F.lit(0e0))
    tested = sums.select(*keys, f.alias("f"), between.alias("dof_between"), within.alias("dof_within"))
    return tested.withColumn("p_value", f_tail(F.col("f"), F.col("dof_between"), F.col("dof_within")))


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str = "p_value") -> DataFrame:
    """The tests with `q_value`: smallest p * m / rank at or above the test's own p.

    Ranks come from the sliced ranking, so one long list of tests is not sorted in one task;
    the running minimum is likewise taken over slices and then inside each slice. Slices are
    cut on a log scale, since small p-values are the ones that crowd.
    """
    scale = F.log(F.greatest(F.col(p), F.lit(1e-300))) * F.lit(64.0)
    levels = cumulative(tests.where(F.col(p).isNotNull()), keys, p, scale=scale)
    raw = F.col(p) * F.col("n_total") / (F.col("n_below") + F.col("n"))
    slice_, part = sliced(scale)
    cut = levels.withColumns({"_raw": raw, "_slice": slice_, "_part": part})
    following = 1, W.unboundedFollowing
    parts = cut.groupBy(*keys, "_slice", "_part").agg(F.min("_raw").alias("_min"))
    slices = parts.groupBy(*keys, "_slice").agg(F.min("_min").alias("_min")).withColumn("_one", F.lit(1))
    after = W.partitionBy("_one", *keys).orderBy("_slice").rowsBetween(*following)
    above = slices.select(*keys, "_slice", F.min("_min").over(after).alias("_above_slice"))
    within = W.partitionBy(*keys, "_slice").orderBy("_part").rowsBetween(*following)
    inner = parts.select(*keys, "_slice", "_part", F.min("_min").over(within).alias("_above_part"))
    inside = W.partitionBy(*keys, "_slice", "_part").orderBy(p).rowsBetween(0, W.unboundedFollowing)
    bounds = null_safe_join(inner, above, [*keys, "_slice"])
    quality = null_safe_join(cut.withColumn("_here", F.min("_raw").over(inside)), bounds, [*keys, "_slice", "_part"]).select(
        *keys, p, F.least(F.col("_here"), F.col("_above_part"), F.col("_above_slice"), F.lit(1e0)).alias("q_value")
    )
    return null_safe_join(tests, quality, [*keys, p], "left")


def kaplan_meier(patients: DataFrame, keys: list[str], months: str, event: str) -> DataFrame:
    """Survival estimate at each time with an event: at risk, events, survival.

    Patients are counted per distinct time first. The product of the step factors is a
    running sum of logs, taken over slices of the time and then inside the slice; a step to
    zero, possible only at the last time of all, ends the curve.
    """
    known = patients.where(F.col(months).isNotNull() & F.col(event).isNotNull())
    deaths = known.groupBy(*keys, months).agg(F.sum(F.col(event).cast("int")).alias("events"))
    times = null_safe_join(cumulative(known, keys, months), deaths, [*keys, months])
    times = times.where(F.col("events") > 0).withColumn("at_risk", F.col("n_total") - F.col("n_below"))
    last = F.col("events") == F.col("at_risk")
    factor = F.when(~last, F.log(F.lit(1e0) - F.col("events") / F.col("at_risk"))).otherwise(0e0)
    curve = running_sum(times.withColumn("log_step", factor), keys, months, value_scale(F.col(months)), "log_step")
    survival = F.when(last, 0e0).otherwise(F.exp("log_step_upto"))
    return curve.select(*keys, months, "at_risk", "events", survival.alias("survival"))


def log_rank(
    patients: DataFrame, members: DataFrame, keys: list[str], groups: list[str], patient: str, months: str, event: str
) -> DataFrame:
    """Survival of a group's patients against that of all other patients of the same `keys`, by risk sets.

    `patients` has one row per keys and patient, `members` the (keys, groups, patient) of each group, for any
    number of groups in one job. Returns per keys and group `members`, `observed` and `expected` events, `variance`, `chi2` (one degree
    of freedom) and `p_value`; chi2 is null where the variance is zero. Patients without a time or event are left out.

    All groups of a key share the times and risk sets of its patients. With d events among r patients at a time,
    of whom m belong to the group, expected is the sum of m d / r: each member brings the running sum of
    d / r up to its own time. The variance, the sum of c (m / r) (1 - m / r) with c = d (r - d) / (r - 1), is likewise one
    running sum per member, less one that is weighted by the members that are followed at least as long. So the work
    follows the members, not groups times times.
    """
    known = patients.where(F.col(months).isNotNull() & F.col(event).isNotNull()).select(
        *keys, patient, F.col(months).cast("double").alias("_at"), F.col(event).cast("int").alias("_event"))
    deaths = known.groupBy(*keys, "_at").agg(F.sum("_event").alias("_deaths"))
    times = null_safe_join(cumulative(known, keys, "_at"), deaths, [*keys, "_at"]).withColumn("_risk", F.col("n_total") - F.col("n_below"))
    d, r = F.col("_deaths").cast("double"), F.col("_risk").cast("double")
    spread = d * (r - d) / F.greatest(r - 1, F.lit(1e0))
    hazard = running_sum(
        times.select(*keys, "_at", (d / r).alias("_h"), (spread / r).alias("_a"), (spread / (r * r)).alias("_k")),
        keys, "_at", value_scale(F.col("_at")), "_h", "_a", "_k")
    unit = [*keys, *groups]
    followed = null_safe_join(members.select(*unit, patient).distinct(), known, [*keys, patient])
    counts = followed.groupBy(*unit, "_at").agg(F.count("*").alias("_n"), F.sum("_event").alias("_d"))
    # a group's members still followed at each of its times
    ranked = null_safe_join(counts, cumulative(followed, unit, "_at"), [*unit, "_at"])
    m = (F.col("n_total") - F.col("n_below")).cast("double")
    later = m - F.col("_n")
    sums = null_safe_join(ranked, hazard, [*keys, "_at"]).groupBy(*unit).agg(
        F.sum("_n").alias("members"), F.sum("_d").alias("observed"), F.sum(F.col("_n") * F.col("_h_upto")).alias("expected"),
        (F.sum(F.col("_n") * F.col("_a_upto")) - F.sum(F.col("_k_upto") * (m * m - later * later))).alias("variance"))
    apart = F.col("observed") - F.col("expected")
    chi2 = F.when(F.col("variance") > 1e-9, apart * apart / F.col("variance"))
    return sums.withColumn("chi2", chi2).withColumn("p_value", chi_squared_tail(F.col("chi2"), F.lit(1)))


def median_survival(patients: DataFrame, keys: list[str], months: str, event: str) -> DataFrame:
    """First time at which the survival estimate is at or under one half; NULL if never reached."""
    curve = kaplan_meier(patients, keys, months, event)
    # half exactly may come out of the logs slightly above
    reached = F.when(F.col("survival") <= F.lit(0.5 + 1e-12), F.col(months))
    return curve.groupBy(*keys).agg(F.min(reached).alias("median_months"))
