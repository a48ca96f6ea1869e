"""Sums of doubles that are exact up to one rounding at the end, whatever the order and the partitions.

A finite double is a whole number times a power of two. The whole numbers are added up by exponent, in a high and a low
half: as longs within a task, as decimals over the tasks. There are some 2,100 exponents, so what is left of any number
of rows is a short list; one function adds that up without error and rounds to the nearest double, ties to even.
"""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the low half of a whole number of up to 55 bits; a task may so add up 2**35 rows.
LOW_BITS = 27
#: Stand in an exponent's place for what isn't finite.
NAN, PLUS, MINUS = 9999, 9998, 9997


def _exponent(v: Column) -> Column:
    """One less than the binary exponent, as the logarithm may be off by one; 0 for zero and null."""
    finite = F.when(F.coalesce(v, F.lit(0.0)) == 0, 0).otherwise(F.floor(F.log2(F.abs(v))).cast("int") - 1)
    return F.when(F.isnan(v), NAN).when(v == math.inf, PLUS).when(v == -math.inf, MINUS).otherwise(finite)


def _whole(v: Column, exponent: Column) -> Column:
    """v * 2**(52 - exponent), in two steps so that neither power overflows."""
    by = F.lit(52) - exponent
    half = F.shiftright(by, 1)
    two = F.lit(2.0)
    return F.when(exponent >= MINUS, F.lit(1)).otherwise(F.coalesce(v, F.lit(0.0)) * F.pow(two, half) * F.pow(two, by - half)).cast("bigint")


def rounded(exponents: Sequence[int], high: Sequence, low: Sequence) -> float:
    """The double nearest to the sum of (high * 2**LOW_BITS + low) * 2**(exponent - 52)."""
    exponents = [int(e) for e in exponents]
    found = set(exponents)
    if NAN in found or {PLUS, MINUS} <= found:
        return math.nan
    if found & {PLUS, MINUS}:
        return math.inf if PLUS in found else -math.inf
    least = min(found, default=0)
    total = sum(((int(h) << LOW_BITS) + int(w)) << (e - least) for e, h, w in zip(exponents, high, low, strict=True))
    scale = least - 52
    try:
        return float(total << scale) if scale >= 0 else total / (1 << -scale)  # whole numbers divide correctly rounded
    except OverflowError:
        return math.copysign(math.inf, total)


def _round(exponents: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
    return pd.Series([rounded(list(e), list(h), list(w)) for e, h, w in zip(exponents, high, low, strict=True)], dtype="float64")


def exact_sum(df: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by..., s): the correctly rounded sum, of all rows or by group; the same bits however df is partitioned.

    Nulls count as nothing and an empty sum is 0.0. NaN, and infinities of both signs, give NaN; a sum beyond the
    largest double gives infinity. A hot group is added up in every task first: it shuffles a row an exponent and task.
    """
    v = F.col(value).cast("double")
    cells = df.select(*by, v.alias("_v"), F.spark_partition_id().alias("_task")).withColumn("_e", _exponent(F.col("_v")))
    whole = cells.select(*by, "_task", "_e", _whole(F.col("_v"), F.col("_e")).alias("_m"))
    low = F.col("_m").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    tasks = whole.groupBy(*by, "_e", "_task").agg(F.sum(F.shiftright("_m", LOW_BITS)).alias("_h"), F.sum(low).alias("_l"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    bins = tasks.groupBy(*by, "_e").agg(wide("_h").alias("_h"), wide("_l").alias("_l"))
    held = bins.groupBy(*by).agg(F.collect_list(F.struct("_e", "_h", "_l")).alias("_b"))
    total = F.pandas_udf(_round, "double")("_b._e", "_b._h", "_b._l")  # pandas hands NaN over as null
    return held.select(*by, F.coalesce(total, F.lit(math.nan)).alias("s"))
