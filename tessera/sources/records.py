"""Timing records: an explicit schema, a CSV reader and a CSV writer with two decimals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions.numeric import fixed2

MEASURES = ["mat_bad_us", "mat_fast_us", "mat_speedup", "sum_slow_us", "sum_fast_us", "sum_speedup"]
RECORD_SCHEMA = T.StructType([T.StructField("n", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in MEASURES])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reads records with a header; the schema is given, so no pass is spent on inference."""
    return spark.read.schema(RECORD_SCHEMA).option("header", True).csv(path)


def formatted(records: DataFrame) -> DataFrame:
    """Records as text, every measure with two decimals."""
    return records.select("n", *(fixed2(records[c]).alias(c) for c in MEASURES))


def write_records(records: DataFrame, path: str) -> None:
    """One CSV file with a header, rows by ascending n. A record exists per problem size, so one file is right."""
    formatted(records).orderBy("n").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
