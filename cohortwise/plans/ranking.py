"""Exact ranks, medians and top-k without putting a whole group into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES_PER_UNIT = 64
PARTS_PER_SLICE = 1 << 20


def value_scale(value: Column) -> Column:
    """Place of a value on a scale of slices: linear below 1 and logarithmic above, 64 to a unit."""
    return F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(SLICES_PER_UNIT))


def sliced(scale: Column) -> tuple[Column, Column]:
    """(slice, part of the slice) of a place on a scale, both non-decreasing in it.

    They depend on the value only, hence a re-run task cuts the same ones. Doubles have at most
    about 90,000 slices of `value_scale`, each 2**20 parts, so clustered values fall apart as
    well, and no ordered step sees more rows than that unless values agree to a millionth of
    a slice.
    """
    part = F.floor((scale - F.floor(scale)) * F.lit(float(PARTS_PER_SLICE)))
    return F.floor(scale), F.least(part, F.lit(PARTS_PER_SLICE - 1))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL group keys with each other."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _upto(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """`rows` (one per keys, slice, part and `order` value) with, for each of `columns`, `_upto_<column>`, its sum up to
    and including the row, and `_total_<column>` over the keys.

    Sums per slice are added up first, then those of the parts of a slice, then the rows of a part.
    """
    sizes = [f"_size_{c}" for c in columns]
    parts = rows.groupBy(*keys, "_slice", "_part").agg(*[F.sum(c).alias(size) for c, size in zip(columns, sizes)])
    slices = parts.groupBy(*keys, "_slice").agg(*[F.sum(size).alias(size) for size in sizes]).withColumn("_one", F.lit(1))
    before = W.unboundedPreceding, -1
    group = W.partitionBy("_one", *keys)

    def below(window, size: str) -> Column:
        return F.coalesce(F.sum(size).over(window.rowsBetween(*before)), F.lit(0))

    bases = slices.select(
        *keys, "_slice", *[below(group.orderBy("_slice"), size).alias(f"_slice{size}") for size in sizes],
        *[F.sum(size).over(group).alias(f"_total_{c}") for c, size in zip(columns, sizes)])
    within = W.partitionBy(*keys, "_slice").orderBy("_part")
    inner = parts.select(*keys, "_slice", "_part", *[below(within, size).alias(f"_part{size}") for size in sizes])
    inside = W.partitionBy(*keys, "_slice", "_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumns({f"_inside_{c}": F.sum(c).over(inside) for c in columns})
    summed = null_safe_join(summed, null_safe_join(inner, bases, [*keys, "_slice"]), [*keys, "_slice", "_part"])
    return summed.withColumns({
        f"_upto_{c}": F.col(f"_slice{size}") + F.col(f"_part{size}") + F.col(f"_inside_{c}") for c, size in zip(columns, sizes)})


def cumulative(
    values: DataFrame, keys: list[str], value: str, weight: str | None = None, scale: Column | None = None
) -> DataFrame:
    """One row per (keys, value): `n` rows with it, `n_below` rows under it, `n_total` in the group.

    Rows are first counted per distinct value (map-side combined) and the counts summed over
    slices of the value range and their parts, so a large group is ranked by many tasks.
    `scale` replaces the rule that cuts the value range; it must not decrease as the value grows.
    """
    n = F.sum(weight) if weight else F.count("*")
    slice_, part = sliced(value_scale(F.col(value)) if scale is None else scale)
    counts = values.groupBy(*keys, value).agg(n.alias("n")).withColumns({"_slice": slice_, "_part": part})
    return _upto(counts, keys, value, ["n"]).select(
        *keys, value, "n", (F.col("_upto_n") - F.col("n")).alias("n_below"), F.col("_total_n").alias("n_total"))


def running_sum(rows: DataFrame, keys: list[str], order: str, scale: Column, *columns: str) -> DataFrame:
    """`rows` (one per keys and `order` value) with `<column>_upto`: its sum up to and including the row."""
    slice_, part = sliced(scale)
    summed = _upto(rows.withColumns({"_slice": slice_, "_part": part}), keys, order, list(columns))
    return summed.select(*rows.columns, *[F.col(f"_upto_{c}").alias(f"{c}_upto") for c in columns])


def mean_ranks(values: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """`cumulative` plus `rank`: the mean 1-based rank shared by tied rows."""
    return cumulative(values, keys, value, weight).withColumn(
        "rank", F.col("n_below") + (F.col("n") + F.lit(1)) / F.lit(2e0)
    )


def median(values: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, n_total, median), exact; the mean of the two middle values for an even count."""
    below, above = F.col("n_below"), F.col("n_below") + F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < above), F.col(value)))

    low = at(F.floor((F.col("n_total") - 1) / 2))
    high = at(F.floor(F.col("n_total") / 2))
    return (
        cumulative(values, keys, value, weight)
        .groupBy(*keys)
        .agg(F.max("n_total").alias("n_total"), ((low + high) / F.lit(2e0)).alias("median"))
    )


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """(keys, spearman_correlation, num_samples) of two numeric columns; one row when `keys` is empty.

    Pearson correlation of mean ranks. NULL for fewer than 3 pairs or a constant side.
    Equal pairs are counted first; the rank of `b` is attached, folded per value of `a`
    (partial sums), and only then meets the rank of `a`.
    """
    copies = F.sum(weight) if weight else F.count("*")
    # stated once here, the filter is not inferred anew in each branch, so the branches share the exchange
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, a, b)])
    counted = pairs.where(known).groupBy(*keys, a, b).agg(copies.alias("_pairs"))
    # half the rank range is the mean rank, whatever the ties
    centred = (F.col("rank") - (F.col("n_total") + F.lit(1)) / F.lit(2e0)).alias("_db")
    ranks_a = mean_ranks(counted, keys, a, "_pairs")
    ranks_b = mean_ranks(counted, keys, b, "_pairs")
    folded = (
        counted.join(ranks_b.select(*keys, b, centred), [*keys, b])
        .groupBy(*keys, a)
        .agg(
            F.sum("_pairs").alias("_n"),
            F.sum(F.col("_pairs") * F.col("_db")).alias("_sum_db"),
            F.sum(F.col("_pairs") * F.col("_db") * F.col("_db")).alias("_sum_db2"),
        )
    )
    both = folded.join(ranks_a.select(*keys, a, centred.alias("_da")), [*keys, a])
    spread = F.sum(F.col("_n") * F.col("_da") * F.col("_da")) * F.sum("_sum_db2")
    return both.groupBy(*keys).agg(
        F.when(
            (F.sum("_n") >= 3) & (spread > 0),
            F.sum(F.col("_sum_db") * F.col("_da")) / F.sqrt(spread),
        ).alias("spearman_correlation"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("num_samples"),
    )


def top(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """First `k` rows in a total order; all of them, in no order, for None."""
    return df if k is None else df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """First `k` rows per group of an already aggregated table, all of them for None; `order` must be total."""
    if k is None:
        return df
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
