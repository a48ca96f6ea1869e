"""Metrics of every node of the plan that a query really ran with, as a frame."""

from pyspark.sql import DataFrame

SCHEMA = "node int, parent int, depth int, operator string, detail string, rows bigint, shuffled_rows bigint, bytes bigint, spill bigint, ms double"
# Spark's names of the metrics that are read, and of nodes that only wrap others.
ROWS, SHUFFLED, SPILL = "numOutputRows", "shuffleRecordsWritten", "spillSize"
BYTES = ("dataSize", "filesSize")
WRAPPERS = ("WholeStageCodegenExec", "InputAdapter", "AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec")
#: Characters of a node's own description that are kept.
DETAIL = 2000


def _children(plan, kind: str) -> list:
    if kind == "AdaptiveSparkPlanExec":
        return [plan.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [plan.plan()]
    if kind == "ReusedExchangeExec":  # its own rows are counted where it was made
        return []
    found = plan.children()
    return [found.apply(k) for k in range(found.size())]


def _measures(plan, convert) -> dict:
    out, ms = {}, 0.0
    for entry in convert(plan.metrics()).entrySet():
        name, metric = entry.getKey(), entry.getValue()
        value, kind = metric.value(), metric.metricType()
        out[name] = max(value, 0)
        ms += {"timing": 1.0, "nsTiming": 1e-6}.get(kind, 0.0) * max(value, 0)
    out["ms"] = ms
    return out


def node_metrics(df: DataFrame) -> DataFrame:
    """Runs df and returns a row for each node of its final plan, after adaptive changes, in the order of the plan's text.

    parent is the node that reads it, null at the top; nodes that only wrap others are left out. rows is null where a
    node doesn't count its output, shuffled_rows is what an exchange wrote; bytes are those of exchanges, broadcasts and
    files read; ms adds up the node's own timings over all tasks. The result's rows stay on the executors.
    """
    spark = df.sparkSession
    convert = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    run = df._jdf.queryExecution()
    run.toRdd().count()
    out = []

    def walk(plan, parent: int | None, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind not in WRAPPERS:
            m = _measures(plan, convert)
            size = [m[b] for b in BYTES if b in m]
            out.append((len(out), parent, depth, kind, plan.simpleString(100)[:DETAIL], m.get(ROWS), m.get(SHUFFLED), size[0] if size else None, m.get(SPILL), m["ms"]))
            parent, depth = len(out) - 1, depth + 1
        for child in _children(plan, kind):
            walk(child, parent, depth)

    walk(run.executedPlan(), None, 0)
    return spark.createDataFrame(out, SCHEMA)
