"""Connected components of a distributed edge list, by alternating star contractions over shared-folder tables.

Nothing is gathered on the driver but one count and one checksum per round. The rounds grow with the logarithm
of a component's longest path. Hubs are safe: minima are pre-aggregated in each task, and edges meet their hub's
minimum in a join whose large partitions adaptive execution splits.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, write


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every neighbour below u, and u itself, is tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, either way round and repeated at will, to (node, root): root is the least node reachable.

    Nodes without an edge to another node are absent. Rows with a null end or a loop are ignored.
    """
    spark = edges.sparkSession
    now, path = write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    seen = now.agg(mark).first()[0]
    while seen[0]:
        then, last = seen, path
        now, path = write(_small_star(_large_star(now)), "edges")
        discard(spark, last)
        seen = now.agg(mark).first()[0]
        if seen == then:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
