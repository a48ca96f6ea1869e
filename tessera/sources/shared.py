"""Paths in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: By application: the folder of a local session that names none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one; a cluster must name one."""
    key = "spark.checkpoint.dir"
    where = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        where = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="shared-")
        _local[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    """The path and its file system, in the JVM."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop, files = _at(spark, path)
    files.deleteOnExit(hadoop)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, files = _at(spark, path)
    return files.exists(hadoop)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    hadoop, files = _at(spark, path)
    files.delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of df: the given ones, with underscores in front until no column bears them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
