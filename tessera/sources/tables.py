"""CSV in and out for tables of any size: a scan that keeps what it cannot read, and an ordered sink of many files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.position import with_positions
from tessera.sources.shared import stored

BAD = "bad_line"
PART = "part"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """The rows of a CSV with a header and ``bad_line``: the whole line where it doesn't fit the schema, else null.

    A line doesn't fit if a field can't be read as its type, or if there are too few or too many fields; the fields that
    could be read stay. A header whose names aren't the schema's ends the query with an error. The file is parsed once:
    what comes back is a table in the shared folder.
    """
    if BAD in schema.fieldNames():
        raise ValueError(f"the schema has a column {BAD} of its own")
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(whole).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return stored(reader.options(**options).csv(path), "csv-scan")


def accepted(scanned: DataFrame) -> DataFrame:
    """The rows of a scan that fit the schema."""
    return scanned.filter(F.col(BAD).isNull()).drop(BAD)


def quarantine(scanned: DataFrame) -> DataFrame:
    """(bad_line): the lines of a scan that don't."""
    return scanned.filter(F.col(BAD).isNotNull()).select(BAD)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], files: int) -> DataFrame:
    """df as CSV in ``path``/data, at most ``files`` files whose ranges follow each other in the keys' order, each sorted; the manifest as ``path``/manifest.

    The manifest has a row a file: part, rows. It is counted from what was written, so a task that was run twice can't
    make it wrong. Keys should tell rows apart: rows of equal keys are in one file and in any order.
    """
    if PART in df.columns:
        raise ValueError(f"the table has a column {PART} of its own")
    dealt = df.repartitionByRange(files, *keys).withColumn(PART, F.spark_partition_id())
    dealt.sortWithinPartitions(PART, *keys).write.partitionBy(PART).option("header", True).csv(f"{path}/data")
    spark = df.sparkSession
    manifest = _data(spark, path, df.schema).groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    manifest.coalesce(1).sortWithinPartitions(PART).write.json(f"{path}/manifest")  # a row a file
    return read_manifest(spark, path)


def _data(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])).option("header", True).csv(f"{path}/data")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PART} int, rows bigint").json(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, schema: T.StructType, name: str = "i") -> DataFrame:
    """The rows of an ordered sink with ``name``: each one's place over all files.

    Files follow the manifest's order; lines keep their order within a file, however it is split. A file that is missing,
    cut short or not in the manifest ends the read with ``ValueError``.
    """
    data = _data(spark, path, schema)
    held = data.groupBy(PART).agg(F.count(F.lit(1)).alias("found")).join(read_manifest(spark, path), PART, "full")
    wrong = held.filter(~F.col("found").eqNullSafe(F.col("rows"))).select(PART).limit(1).collect()
    if wrong:
        raise ValueError(f"file {wrong[0][0]} isn't as the manifest says")
    order = [F.col(PART), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return with_positions(data, order, name).drop(PART)
