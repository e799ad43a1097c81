"""Money that adds up alike in every order, and rounding that is alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "UNKNOWN_CUSTOMER"


def rounded(value: Column, digits: int = 2) -> Column:
    """Half-up rounding of the decimal rendering, as a double."""
    return F.round(value.cast("decimal(30,10)"), digits).cast("double")


def total(column: str = "total_amount") -> Column:
    """Sum of a money column: exact decimals, given as a double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def mean(column: str = "total_amount") -> Column:
    """Exact sum over the number of values that are there."""
    return total(column) / F.count(column)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; null for an empty whole."""
    return rounded(F.try_divide(part, whole) * 100, digits)
