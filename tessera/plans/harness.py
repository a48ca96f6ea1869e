"""Repetition timing of an action: one row per repetition, means and ratios computed by Spark afterwards."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import speedup
from tessera.operators import linalg, reduce
from tessera.sources import generate

MATVEC_REPS, SUM_REPS = 20, 50


def time_action(df: DataFrame, reps: int) -> list[float]:
    """Microseconds of each of reps runs of df into the no-op sink."""
    out = []
    for _ in range(reps):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - began) * 1e6)
    return out


def mean_by_size(samples: DataFrame) -> DataFrame:
    """(n, what, us) rows to one record per n: means of all repetitions, ratios of the unrounded means."""
    mean = lambda what: F.avg(F.when(F.col("what") == what, F.col("us")))
    m = samples.groupBy("n").agg(*(mean(w).alias(w) for w in ("mat_bad_us", "mat_fast_us", "sum_slow_us", "sum_fast_us")))
    return m.select(
        F.col("n").cast("int").alias("n"), "mat_bad_us", "mat_fast_us", speedup(F.col("mat_bad_us"), F.col("mat_fast_us")).alias("mat_speedup"),
        "sum_slow_us", "sum_fast_us", speedup(F.col("sum_slow_us"), F.col("sum_fast_us")).alias("sum_speedup"),
    )


def samples(spark: SparkSession, sizes: list[int], matvec_reps: int = MATVEC_REPS, sum_reps: int = SUM_REPS) -> DataFrame:
    """(n, what, us): a row per repetition of each of the four kernels at every size."""
    out = []
    for n in sizes:
        a, x, arr = generate.matrix(spark, n), generate.vector_x(spark, n), generate.vector_arr(spark, n)
        for what, df, reps in (
            ("mat_bad_us", linalg.matvec(a, x), matvec_reps), ("mat_fast_us", linalg.matvec_tiled(a, x), matvec_reps),
            ("sum_slow_us", reduce.array_sum(arr), sum_reps), ("sum_fast_us", reduce.array_sum_lanes(arr, n=n), sum_reps),
        ):
            out += [(n, what, us) for us in time_action(df, reps)]
    return spark.createDataFrame(out, "n int, what string, us double")


def run_sweep(spark: SparkSession, sizes: list[int], matvec_reps: int = MATVEC_REPS, sum_reps: int = SUM_REPS) -> DataFrame:
    """Times the four kernels at every size and returns the record frame."""
    return mean_by_size(samples(spark, sizes, matvec_reps, sum_reps))
