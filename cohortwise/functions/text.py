"""Substring keys, so that "term occurs in text" becomes an equi-join instead of a cross join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substrings(column: Column, shortest: int = 1) -> Column:
    """All distinct substrings of at least `shortest` characters of a short text."""
    size = F.length(column)
    # an empty range stands for a text shorter than `shortest`
    starts = F.when(size >= shortest, F.sequence(F.lit(1), size - F.lit(shortest - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda at: F.transform(
                    F.sequence(F.lit(shortest), size - at + 1), lambda length: F.substring(column, at, length)
                ),
            )
        )
    )


def id_tokens(column: Column, shortest: int = 3) -> Column:
    """Lower-case parts of an id between `_` and `-`, short parts dropped."""
    return F.filter(F.split(F.lower(column), "[_-]+"), lambda part: F.length(part) >= shortest)
