"""Compressed sparse rows: (i, block, js array<long>, cells array<double>), the entries of one row of a matrix in one block of columns.

A row with very many entries is cut by blocks of columns, so none outgrows BLOCK_COLUMNS entries.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import spread
from tessera.operators.linalg import lookup

BLOCK_COLUMNS = 4096


def compress(a: DataFrame, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """The relation (i, j, a) as compressed rows, column indices ascending; entries of one place are added up first.

    a is counted first. Entries go to tasks by their count, those of one place apart by the task that read them, so that
    a place held very often meets only its sums.
    """
    tasks = spread.tasks(a.sparkSession, a.count())
    placed = a.select("i", F.expr(f"j div {columns}").alias("block"), "j", "a", F.spark_partition_id().alias("read"))
    parts = placed.repartition(tasks, "i", "j", "read").groupBy("i", "block", "j", "read").agg(F.sum("a").alias("a"))
    once = parts.repartition(tasks, "i", "block").groupBy("i", "block", "j").agg(F.sum("a").alias("a"))
    held = once.groupBy("i", "block").agg(F.array_sort(F.collect_list(F.struct("j", "a"))).alias("es"))
    return held.select("i", "block", F.col("es.j").alias("js"), F.col("es.a").alias("cells"))


def matvec_sparse(rows: DataFrame, x: DataFrame, strategy: str | None = None, tasks: int | None = None) -> DataFrame:
    """(j, y): every entry times its row's element of x, scattered to its column; one shuffle by column. ``tasks``: as in ``linalg.lookup``."""
    met = lookup(rows, x, strategy, tasks).select("xv", F.inline(F.arrays_zip("js", "cells")))
    return met.groupBy(F.col("js").alias("j")).agg(F.sum(F.col("cells") * F.col("xv")).alias("y"))


def zero_filled(y: DataFrame, domain: DataFrame) -> DataFrame:
    """(j, y) for exactly the indices j of domain, which may be any keys; 0.0 where y has none."""
    return domain.select("j").distinct().join(y, "j", "left").select("j", F.coalesce("y", F.lit(0.0)).alias("y"))
