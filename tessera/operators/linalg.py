"""Matrix-vector products y[j] = sum over i of A[i, j] * x[i] (the transpose of a row-major A times x).

Inputs are long-form: a(i, j, a) and x(i, xv). x is read once when the plan is built and broadcast if that proves it small;
a longer x is joined by a shuffle on i. Results have one row (j, y) per column that occurs in A. Shapes are checked in the
same job: a row index of A that x lacks, or that x holds twice, ends the query with an error instead of a wrong sum.
"""

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import new_path, stored

#: Rows of x up to which it is broadcast: 16 bytes each, so 16 MB at most.
BROADCAST_ROWS = 1 << 20
TILE = 64
#: Slots of a hash of the row index, counted to find hot indices: a hot one fills its slot.
SLOTS = 1 << 14
#: Elements of an x that goes into the plan as a literal: 512 KB.
LITERAL = 1 << 16


def check_shapes(a: DataFrame, x: DataFrame) -> None:
    """ValueError if x lacks a row index of A or holds one twice; a plain join would silently drop or repeat terms."""
    if a.select("i").distinct().join(x.select("i"), "i", "left_anti").limit(1).count():
        raise ValueError("x has no element for a row of the matrix")
    if x.groupBy("i").count().filter("count > 1").limit(1).count():
        raise ValueError("x holds an index twice")


def _held(x: DataFrame) -> DataFrame | None:
    """x as a local table if it can be broadcast, else None. Reads BROADCAST_ROWS + 1 rows of x at most, when the plan is built; ValueError if they hold an index twice."""
    rows = x.select("i", "xv").limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        return None
    if len(rows.column("i").unique()) < rows.num_rows:
        raise ValueError("x holds an index twice")
    return x.sparkSession.createDataFrame(rows, x.select("i", "xv").schema)


def fail(message: str, kind: str = "double"):
    """A column that ends the query with the message when it is read."""
    return F.raise_error(F.lit(message)).cast(kind)


def _met(a: DataFrame, x: DataFrame, strategy: str | None, tasks: int | None = None) -> DataFrame:
    """A's rows with xv and ``times``: how often x holds their index, null if not at all. ``tasks``: as in ``lookup``."""
    if strategy not in ("broadcast", "merge", None):
        raise ValueError(f"unknown strategy {strategy}")
    held = _held(x) if strategy is None else None
    if held is not None:
        return a.join(held.withColumn("times", F.lit(1)).hint("broadcast"), "i", "left")
    if strategy == "broadcast":
        return a.join(x.groupBy("i").agg(F.first("xv").alias("xv"), F.count(F.lit(1)).alias("times")).hint("broadcast"), "i", "left")
    if tasks:
        a, x = a.repartition(tasks, "i"), x.repartition(tasks, "i")
    # x is sorted by i as the join needs it: an index held twice is seen beside its neighbour, without a map of all indices
    beside = Window.partitionBy("i").orderBy("i")
    marked = x.filter("i is not null").select("i", "xv", F.lag("i").over(beside).alias("before"), F.lead("i").over(beside).alias("after"))
    once = marked.filter("before is null").select("i", "xv", F.when(F.col("after").isNull(), 1).otherwise(2).alias("times"))
    return a.join(once.hint("merge"), "i", "left")


LACKS, TWICE = "x has no element for a row of the matrix", "x holds an index twice"


def lookup(a: DataFrame, x: DataFrame, strategy: str | None = None, tasks: int | None = None) -> DataFrame:
    """A's rows with x's element for their row index. strategy: broadcast, merge, or None to decide by x's size.

    A row without an element, or with two, raises an error when the query runs. ``tasks``: how many tasks a merge join
    is dealt to where no index has a large share of A's rows; without it Spark decides, and splits what is large.
    """
    element = F.when(F.col("times") == 1, F.col("xv")).when(F.col("times") > 1, fail(TWICE)).otherwise(fail(LACKS))
    return _met(a, x, strategy, tasks).withColumn("xv", element).drop("times")


def _wrong() -> Column:
    """Of a group's rows: 2 if one has no element of x, 1 if one has two, else 0. Looked at once a group, not once a row."""
    return F.max(F.when(F.col("times").isNull(), 2).when(F.col("times") > 1, 1).otherwise(0))


def _sound(total: str) -> Column:
    return F.when(F.col("wrong") == 0, F.col(total)).when(F.col("wrong") == 1, fail(TWICE)).otherwise(fail(LACKS))


def matvec(a: DataFrame, x: DataFrame, strategy: str | None = None) -> DataFrame:
    """One aggregation by j: partial sums in each task, one shuffle of at most (tasks x columns) rows."""
    sums = _met(a, x, strategy).groupBy("j").agg(F.sum(F.col("a") * F.col("xv")).alias("y"), _wrong().alias("wrong"))
    return sums.select("j", _sound("y").alias("y"))


def matvec_tiled(a: DataFrame, x: DataFrame, tile: int = TILE, strategy: str | None = None) -> DataFrame:
    """The same product by row tiles: sums per (tile, j), then per j.

    A column with very many rows is so dealt over its tiles before it meets in one group.
    """
    if tile < 1:
        raise ValueError("a tile has at least one row")
    each = F.floor(F.col("i") / F.lit(tile)).alias("tile")
    per_tile = _met(a, x, strategy).groupBy(each, "j").agg(F.sum(F.col("a") * F.col("xv")).alias("part"), _wrong().alias("wrong"))
    return per_tile.groupBy("j").agg(F.sum("part").alias("y"), F.max("wrong").alias("wrong")).select("j", _sound("y").alias("y"))


def matvec_rows(rows: DataFrame, x: DataFrame, strategy: str | None = None) -> DataFrame:
    """The product over packed rows (i, row array<double>): scale each row by x[i], then add up by position."""
    joined = lookup(rows, x, strategy)
    scaled = F.transform("row", lambda e: e * F.col("xv"))
    return joined.select(F.posexplode(scaled).alias("j", "part")).groupBy(F.col("j").cast("bigint").alias("j")).agg(F.sum("part").alias("y"))


def tiles(n: int, spark, tile: int = TILE) -> DataFrame:
    """The tile grid over an n x n matrix: (row_from, row_to, col_from, col_to), clipped at n, ends excluded."""
    edge = spark.range(0, n, tile)
    rows = edge.select(F.col("id").alias("row_from"), F.least(F.col("id") + tile, F.lit(n).cast("bigint")).alias("row_to"))
    span = F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint"), F.lit(tile).cast("bigint"))
    return rows.select("*", F.explode(span).alias("col_from")).select("*", F.least(F.col("col_from") + tile, F.lit(n).cast("bigint")).alias("col_to"))


def densify(y: DataFrame, n: int) -> DataFrame:
    """Exactly the rows j = 0 .. n - 1, with 0.0 where y has none."""
    return y.sparkSession.range(n).select(F.col("id").alias("j")).join(y, "j", "left").select("j", F.coalesce("y", F.lit(0.0)).alias("y"))


def _literal(x: DataFrame) -> np.ndarray:
    """x's elements in order; ValueError if there are more than LITERAL of them, or one is missing or held twice."""
    rows = sorted((r.i, r.xv) for r in x.limit(LITERAL + 1).collect())
    if len(rows) > LITERAL:
        raise ValueError(f"x has more than {LITERAL} elements: take matvec on the long form")
    if [i for i, _ in rows] != list(range(len(rows))):
        raise ValueError("x lacks an index or holds one twice")
    return np.array([v for _, v in rows], np.float64)


def matvec_packed(rows: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) with y[i] = sum over j of row[j] * x[j]: the product of the row-major matrix itself, row by row.

    Each row's dot product is made where the row is read; nothing is shuffled. x is a literal of checked size. A row
    whose length isn't x's ends the query with an error.
    """
    weights = F.lit(_literal(x))
    dot = F.aggregate(F.zip_with(F.col("row").cast("array<double>"), weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("i", F.when(F.size("row") == F.size(weights), dot).otherwise(fail("a row and x differ in length")).alias("y"))


def bucketed(df: DataFrame, buckets: int, index: str = "i", name: str = "bucketed") -> DataFrame:
    """df written to the shared folder in buckets of its index, one file each: two such tables, with as many buckets, meet without a shuffle.

    Worth it for what is joined again and again. A bucket is read by one task: where an index may hold a large share of
    the rows, take ``Buckets``.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, index).write.bucketBy(buckets, index).sortBy(index).format("parquet")
    dealt.option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


@dataclass
class Buckets:
    """A matrix in buckets of its row index, but for the rows of hot indices, which lie apart and are read by any number of tasks."""

    cool: DataFrame
    apart: DataFrame
    hot: list

    @classmethod
    def of(cls, a: DataFrame, buckets: int, name: str = "bucketed") -> "Buckets":
        """a is read twice, and once more if an index may be hot. Hot indices are those with more rows than a mean bucket, fewer than ``buckets`` of them."""
        slot = F.pmod(F.xxhash64("i"), F.lit(SLOTS))
        slots = a.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()  # SLOTS rows at most
        total = sum(r.n for r in slots)
        full = [r.slot for r in slots if r.n * buckets > total]
        hot = [r.i for r in a.filter(slot.isin(full)).groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * buckets > F.lit(total)).collect()] if full else []
        is_hot = F.coalesce(F.col("i").isin(hot), F.lit(False))
        return cls(bucketed(a.filter(~is_hot), buckets, name=name), stored(a.filter(is_hot), "hot-rows"), hot)

    def lookup(self, x: DataFrame) -> DataFrame:
        """``lookup`` with an x that is bucketed alike: cool rows meet it without an exchange, hot ones by a broadcast of their few elements."""
        few = x.filter(F.col("i").isin(self.hot))
        return lookup(self.cool, x, "merge").union(lookup(self.apart, few, "broadcast"))

    def matvec(self, x: DataFrame) -> DataFrame:
        return self.lookup(x).groupBy("j").agg(F.sum(F.col("a") * F.col("xv")).alias("y"))
