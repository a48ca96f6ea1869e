"""Sums over a vector, whole or over its first n elements. An empty sum is 0.0, never null.

A vector of fewer than n elements ends the query with an error.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix(df: DataFrame, n: int | None, index: str = "i") -> DataFrame:
    """The rows whose index is below n (all rows for None)."""
    return df if n is None else df.filter(F.col(index) < F.lit(n))


def _total(value: Column, rows: Column, n: int | None) -> Column:
    """The sum of an aggregation, or an error if it saw fewer than n rows."""
    total = F.coalesce(F.sum(value), F.lit(0.0))
    return total if n is None else F.when(F.coalesce(rows, F.lit(0)) < F.lit(n), F.raise_error(F.lit("the vector has fewer elements than asked for")).cast("double")).otherwise(total)


def array_sum(df: DataFrame, value: str = "v", n: int | None = None, index: str = "i") -> DataFrame:
    """One row (s): partial sums in each task, then one final sum; only one row per task is shuffled."""
    return prefix(df, n, index).agg(_total(F.col(value), F.count(F.lit(1)), n).alias("s"))


def _lanes(df: DataFrame, value: str, n: int | None, index: str, lanes: int) -> DataFrame:
    """(lane, s, n)"""
    length = n if n is not None else df.count()
    whole = length - length % lanes
    at = F.col(index)
    lane = F.when(at < F.lit(whole), at % F.lit(lanes)).otherwise(F.lit(0).cast("bigint"))
    return prefix(df, n, index).groupBy(lane.alias("lane")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))


def lane_sums(df: DataFrame, value: str = "v", n: int | None = None, index: str = "i", lanes: int = 4) -> DataFrame:
    """One row per lane that holds a row: (lane, s). The tail beyond the last whole stripe belongs to lane 0.

    The stripe bound needs the vector's length: n where it is given, else the row count of df, which takes a job.
    """
    return _lanes(df, value, n, index, lanes).select("lane", "s")


def array_sum_lanes(df: DataFrame, value: str = "v", n: int | None = None, index: str = "i", lanes: int = 4) -> DataFrame:
    """The same total as ``array_sum`` through per-lane sums."""
    return _lanes(df, value, n, index, lanes).agg(_total(F.col("s"), F.sum("n"), n).alias("s"))


def packed_sum(array: Column, n: int | None = None) -> Column:
    """Sum of a packed array's elements, or of its first n, or of all if there are fewer; 0.0 when there are none."""
    part = array if n is None else F.slice(array, 1, max(n, 0))
    return F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)
