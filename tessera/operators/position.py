"""A gapless position for stored rows: what makes a table's column a vector (i, v).

Rows are dealt to ordered ranges, sorted there and numbered by task; one count a task gives the offsets. No row meets all
others in one partition.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import spread
from tessera.sources.shared import fresh, stored

#: Bits of a row's number within its task, as ``monotonically_increasing_id`` lays it out.
ROW_BITS = 33


def with_positions(df: DataFrame, keys: Sequence[str | Column], name: str = "i", partitions: int | None = None) -> DataFrame:
    """df with ``name``: the row's 0-based place in ascending order of the keys, nulls first; written to the shared folder.

    Rows with equal keys are ordered by a hash of the whole row, so only equal rows may change places, and a key that
    holds many rows is dealt over several ranges. Without ``partitions`` there are the session's shuffle partitions, or more
    so that a range has ``spread.ROWS`` rows; df is then counted first. It is computed twice beside that, once for a sample of
    its ranges' bounds. A column of df that bears the name is left out.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() != name.lower()]
    by = [k if isinstance(k, Column) else F.col(k) for k in keys]
    names = fresh(df, *(f"key{n}" for n in range(len(by))), "mix", "read", "at", "task", "offset")
    *key, mix, read, at, task, offset = names
    order = [*key, mix, read]
    dealt = df.select(*kept, *(k.alias(n) for k, n in zip(by, key, strict=True)), F.xxhash64(*kept).alias(mix), F.monotonically_increasing_id().alias(read))
    count = partitions or spread.tasks(spark, df.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = dealt.repartitionByRange(count, *order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias(at))
    rows = stored(ranged, "positions").withColumn(task, F.shiftright(at, ROW_BITS))
    offsets, before = [], 0
    for r in sorted(rows.groupBy(task).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a task
        offsets.append((r[0], before))
        before += r[1]
    where = spark.createDataFrame(offsets, f"`{task}` bigint, `{offset}` bigint")
    place = (F.col(offset) + F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).cast("bigint")
    return rows.join(F.broadcast(where), task).select(*kept, place.alias(name))
