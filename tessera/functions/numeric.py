"""Column helpers for ratios and fixed-point text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def speedup(slow: Column, fast: Column) -> Column:
    """slow / fast; a zero divisor gives null (plain division raises under ANSI mode)."""
    return F.try_divide(slow, fast)


def fixed2(value: Column) -> Column:
    """Text with exactly two decimals, rounded from the exact binary value and without grouping commas."""
    plain = F.call_function("format_number", value, F.lit("0.00"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == F.lit(float("inf")), F.lit("inf"))
        .when(value == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(plain)
    )
