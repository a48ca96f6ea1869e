"""Tables written to the cluster's shared folder, so that lost executors cost no more than the work since."""

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import discard, exists, fresh, new_path
from tessera.sources.shared import stored as cut

__all__ = ["arrow_batches", "cut", "discard", "exists", "fresh", "new_path", "write"]


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and where it is."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bounds the session's Arrow batches that go to Python workers; what the user has set, to whatever value, stays.

    Documents are long: the default of 10,000 rows a batch holds tens of megabytes several times over in a task. Spark
    reads the bounds when a query runs, so they can't be given to one query alone.
    """
    own = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if key not in own:
            spark.conf.set(key, value)
