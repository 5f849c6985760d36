"""Column expressions for missing values, text numbers and percentages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(column: Column | str) -> Column:
    """The text, or NULL where it is empty: patient-level rows carry an empty sample id."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def to_number(column: Column | str) -> Column:
    """Finite double written in a text column; NULL for anything else ('', 'NA', 'nan', '<1').

    The cast also reads Java literals such as '1.0d', '1f' and '0x1p3', hence the check for
    letters that no plain number has.
    """
    text = F.col(column) if isinstance(column, str) else column
    number = text.try_cast("double")
    plain = F.translate(text, "dDfFxX", "") == text
    return F.when(plain & (F.abs(number) < F.lit(float("inf"))), number)


def percent(part: Column, whole: Column) -> Column:
    """One-decimal percentage, ties to even; NULL when the whole is zero."""
    return F.bround(part * F.lit(100e0) / F.nullif(whole, F.lit(0)), 1)


def log2p1(column: Column | str) -> Column:
    """log2(value + 1), applied to RNA-seq values before groups are compared."""
    return F.log2((F.col(column) if isinstance(column, str) else column) + F.lit(1e0))


def contains_any(columns: list[str], terms: list[str]) -> Column:
    """Case-insensitive: any of the terms occurs in any of the columns, wildcards taken literally."""
    return any_of(F.contains(F.lower(F.col(c)), F.lit(t.lower())) for c in columns for t in terms)


def any_of(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))
