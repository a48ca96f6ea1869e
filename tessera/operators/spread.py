"""Into how many tasks rows are dealt, by their count: what one task holds sorted or grouped doesn't grow with the table."""

from pyspark.sql import SparkSession

#: Rows of a few numbers that one task sorts or groups: 64 MB or less each time.
ROWS = 1 << 19
#: Times ROWS in a task before a shuffle goes to more tasks than Spark writes without sorting; beyond, a task holds all it has read.
CROWDED = 4


def tasks(spark: SparkSession, rows: int, least: int | None = None) -> int:
    """Tasks for so many rows, ROWS each at most where they are dealt evenly, or CROWDED times ROWS where they would be too many to write unsorted.

    There are at least ``least``, or else as many as the session has cores.
    """
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    dealt = max(min(-(-rows // ROWS), unsorted), -(-rows // (CROWDED * ROWS)))
    return max(dealt, spark.sparkContext.defaultParallelism if least is None else least, 1)
