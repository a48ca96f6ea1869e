"""Chart-ready frames and plan profiles."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The charts, their columns and the series' labels.
CHARTS = {
    "mat_time": {"mat_bad_us": "Naive Mat-Vec", "mat_fast_us": "Optimized Mat-Vec"},
    "mat_speedup": {"mat_speedup": "Speedup"},
    "sum_time": {"sum_slow_us": "Naive Sum", "sum_fast_us": "Optimized Sum"},
    "sum_speedup": {"sum_speedup": "Speedup"},
}


def chart(records: DataFrame, name: str) -> DataFrame:
    """(chart, n, series, value) of one chart, made by one unpivot of the records."""
    series = CHARTS[name]
    label = F.element_at(F.create_map(*(F.lit(x) for pair in series.items() for x in pair)), F.col("column"))
    return records.unpivot("n", list(series), "column", "value").select(F.lit(name).alias("chart"), "n", label.alias("series"), "value")


def chart_frames(records: DataFrame) -> DataFrame:
    """All charts' series from one pass over the records."""
    cells = F.array(*(F.struct(F.lit(name).alias("chart"), F.lit(label).alias("series"), F.col(c).alias("value")) for name, s in CHARTS.items() for c, label in s.items()))
    return records.select("n", F.explode(cells).alias("cell")).select("cell.chart", "n", "cell.series", "cell.value")


def profile(df: DataFrame, lines: int = 50) -> tuple[dict, str]:
    """Row count and checksum as observed while df runs once, and the first lines of its formatted plan."""
    seen = Observation()
    row_hash = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("bigint")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(row_hash).alias("checksum")).write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return seen.get, "\n".join(plan.splitlines()[:lines])
