"""Deterministic dense inputs in long form, made by ``spark.range`` so that nothing is shipped from the driver."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sweep's bounds and the generators' periods and offsets.
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 512, 8192, 512
MATRIX_PERIOD, MATRIX_OFFSET = 17, 8.0
X_PERIOD, X_OFFSET = 13, 6.0
ARRAY_PERIOD, ARRAY_OFFSET = 19, 9.0


def sweep(spark: SparkSession, start: int = SWEEP_START, stop: int = SWEEP_STOP, step: int = SWEEP_STEP) -> DataFrame:
    """Problem sizes ``n`` from start to stop, both included."""
    return spark.range(start, stop + 1, step).select(F.col("id").alias("n"))


def zeros(spark: SparkSession, n: int) -> DataFrame:
    """A vector of n zeros: (i, v)."""
    return spark.range(n).select(F.col("id").alias("i"), F.lit(0.0).alias("v"))


def _cycle(column, period: int, offset: float):
    return (column % F.lit(period)).cast("double") - F.lit(offset)


def matrix(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """A row-major n x n matrix in coordinate form: (i, j, a)."""
    flat = spark.range(0, n * n, 1, partitions) if partitions else spark.range(n * n)
    k = F.col("id")
    return flat.select(
        F.expr(f"id div {max(n, 1)}").alias("i"), (k % F.lit(max(n, 1))).alias("j"), _cycle(k, MATRIX_PERIOD, MATRIX_OFFSET).alias("a")
    )


def matrix_rows(spark: SparkSession, n: int) -> DataFrame:
    """The same matrix, one packed row per i: (i, row array<double>)."""
    i = F.col("id")
    row = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda j: _cycle(i * F.lit(n) + j, MATRIX_PERIOD, MATRIX_OFFSET))
    return spark.range(n).select(i.alias("i"), row.alias("row"))


def vector_x(spark: SparkSession, n: int) -> DataFrame:
    """The vector that the matrix is multiplied by: (i, xv)."""
    return spark.range(n).select(F.col("id").alias("i"), _cycle(F.col("id"), X_PERIOD, X_OFFSET).alias("xv"))


def vector_arr(spark: SparkSession, n: int) -> DataFrame:
    """The array that is summed: (i, v)."""
    return spark.range(n).select(F.col("id").alias("i"), _cycle(F.col("id"), ARRAY_PERIOD, ARRAY_OFFSET).alias("v"))
