"""Prefix sums over a positioned vector (i, v): all running sums, or the sums of its first n elements for many n at once."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of a block of the scan; also the blocks whose totals are scanned together.
BLOCK = 1 << 16
#: Sizes that one pass takes.
SIZES = 256


def running_sums(df: DataFrame, value: str = "v", index: str = "i", length: int | None = None, block: int = BLOCK) -> DataFrame:
    """(i, v, s): s is the sum of all elements up to and with the i-th.

    A scan in levels: sums within blocks, the blocks' totals scanned by the same means, and each block's offset added.
    Every window is partitioned by block. ``length`` bounds the indices; without it a job finds the largest.
    """
    if block < 2:
        raise ValueError("a block has at least two elements")
    if length is None:
        length = (df.agg(F.max(index)).first()[0] or 0) + 1
    x = df.select(F.col(index).cast("bigint").alias("i"), F.col(value).alias("v")).withColumn("b", F.expr(f"i div {block}"))
    inner = x.withColumn("s", F.sum("v").over(Window.partitionBy("b").orderBy("i")))
    if length <= block:
        return inner.select("i", "v", "s")
    totals = x.groupBy("b").agg(F.sum("v").alias("v")).select(F.col("b").alias("i"), "v")
    before = running_sums(totals, "v", "i", -(-length // block), block).select(F.col("i").alias("b"), (F.col("s") - F.col("v")).alias("before"))
    return inner.join(before, "b").select("i", "v", (F.col("s") + F.col("before")).alias("s"))


def prefix_sums(df: DataFrame, sizes: Sequence[int], value: str = "v", index: str = "i", strict: bool = True) -> DataFrame:
    """(n, s) for every n of ``sizes``, from one pass: the sum of the elements with an index below n, 0 for none.

    Each element is added to the stretch between two sizes that it lies in; a task shuffles a row a stretch. A vector of
    fewer than n elements ends the query with an error, or gives null for that n if not strict.
    """
    bounds = sorted(set(sizes))
    if len(bounds) > SIZES:
        raise ValueError(f"more than {SIZES} sizes: take running_sums")
    if not bounds:
        return df.sparkSession.createDataFrame([], "n bigint, s double")
    at = F.col(index)
    stretch = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        stretch = F.when(at < F.lit(bounds[k]), F.lit(k)).otherwise(stretch)
    parts = df.filter(at < F.lit(bounds[-1])).groupBy(stretch.alias("k")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    upto = lambda k, c: F.coalesce(F.sum(F.when(F.col("k") <= k, F.col(c))), F.lit(0))
    short = F.raise_error(F.lit("the vector has fewer elements than asked for")).cast("double") if strict else F.lit(None)
    rows = [F.struct(F.lit(n).cast("bigint").alias("n"), F.when(upto(k, "n") < F.lit(n), short).otherwise(upto(k, "s")).alias("s")) for k, n in enumerate(bounds)]
    return parts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
