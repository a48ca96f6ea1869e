"""Registered queries that run the numeric operators over the given tables, with their DuckDB SQL.

Prices are taken in cents and quantities as they are: whole numbers, so that sums are the same in any order.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import fixed2, speedup
from tessera.operators import exact, linalg, position, reduce, scan, sparse, spread, tiled
from tessera.plans import harness, metrics, report
from tessera.sources import generate, tables
from tessera.sources.records import MEASURES, formatted
from tessera.sources.shared import new_path

#: Rows of a table in order of these are a vector; rows that agree in all of them hold the same value.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
BUCKETS = 8
DIMENSIONS = 64
FILES = 6
#: Every so manieth order's line is spoiled in the CSV that is scanned.
SPOILED = {"type": 97, "short": 89}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str, scale: int) -> Column:
    """The nearest whole number of scaled units, as a double."""
    return F.floor(F.col(column).cast("double") * F.lit(float(scale)) + F.lit(0.5)).cast("double")


def weight(column: str) -> Column:
    return (F.col(column) % 13 - 6).cast("double")


def line_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's prices in cents as a vector (i, v) in line order."""
    return position.with_positions(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER).select("i", whole("l_extendedprice", 100).alias("v"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored embeddings as packed rows, in millionths."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda e: F.floor(e.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("double")).alias("row"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_rows(spark, sf_dir).select("i", F.posexplode("row").alias("j", "a")).withColumn("j", F.col("j").cast("bigint"))


def embedding_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), weight("vec_id").alias("xv"))


def order_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), weight("o_orderkey").alias("xv"))


def long_y(y: DataFrame) -> DataFrame:
    return y.withColumn("y", F.col("y").cast("bigint"))


def bucketed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by line number, each times its order's weight; both sides are bucketed by order, into at least BUCKETS."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j"), F.col("l_quantity").alias("a"))
    x = order_x(spark, sf_dir)
    buckets = spread.tasks(spark, max(a.count(), x.count()), BUCKETS)
    return long_y(linalg.Buckets.of(a, buckets, "lines").matvec(linalg.bucketed(x, buckets, name="orders")))


def sparse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the quantities of its lines times their orders' weights, zero for a part without lines."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("a"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"))
    x = order_x(spark, sf_dir)
    tasks = spread.tasks(spark, max(a.count(), x.count()))  # an order has few lines, so evenly
    return long_y(sparse.zero_filled(sparse.matvec_sparse(sparse.compress(a), x, tasks=tasks), parts))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, what, us): lineitem's rows as samples, line number for size, four kinds by flag and status, the price in cents as time."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when((flag == "N") & (status == "O"), "mat_bad_us").when(flag == "N", "mat_fast_us").when(status == "O", "sum_slow_us").otherwise("sum_fast_us")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), kind.alias("what"), whole("l_extendedprice", 100).alias("us"))


def line_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.mean_by_size(line_samples(spark, sf_dir))


def line_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, reps): how often the harness ran two sums over lineitem with a positive time."""
    prices = table(spark, sf_dir, "lineitem").select(whole("l_extendedprice", 100).alias("v"))
    runs = [(what, us) for what, df, reps in (("sum", reduce.array_sum(prices), 3), ("exact_sum", exact.exact_sum(prices), 2)) for us in harness.time_action(df, reps)]
    return spark.createDataFrame(runs, "what string, us double").filter("us > 0").groupBy("what").agg(F.count(F.lit(1)).alias("reps"))


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, rows): what the scans, the join and the last aggregation of lines by order status made, as the plan's nodes counted it."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = metrics.node_metrics(joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("lines")))
    scan_ = F.col("operator") == "FileSourceScanExec"
    name = F.when(scan_ & F.col("detail").contains("l_orderkey"), "lineitem").when(scan_, "orders").when(F.col("operator").endswith("JoinExec"), "join").when(F.col("operator").endswith("AggregateExec") & (F.col("depth") == 0), "aggregate")
    return m.select(name.alias("node"), "rows").filter("node is not null")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def generated_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated square matrix times the embeddings' weighted sum: two products, one behind the other."""
    x = linalg.matvec(embedding_cells(spark, sf_dir), embedding_x(spark, sf_dir)).select(F.col("j").alias("i"), F.col("y").alias("xv"))
    return long_y(linalg.matvec(generate.matrix(spark, DIMENSIONS), x, "merge"))


def generated_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first elements of lineitem's vector times both generated vectors, element by element, added up."""
    both = generate.vector_x(spark, generate.SWEEP_STOP).join(generate.vector_arr(spark, generate.SWEEP_STOP).withColumnRenamed("v", "av"), "i")
    met = line_vector(spark, sf_dir).join(both, "i")
    return met.agg(F.sum(F.col("v") * F.col("xv")).cast("bigint").alias("by_x"), F.sum(F.col("v") * F.col("av")).cast("bigint").alias("by_arr"))


def hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a matrix of three columns, its return flags, each with a third of all rows: the tiled product deals a column over its tiles."""
    placed = position.with_positions(table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_returnflag"), [*LINE_ORDER, "l_returnflag"])
    dealt = placed.repartition(spread.tasks(spark, placed.count()), "i")  # one row an index, so evenly
    a = dealt.select("i", F.ascii("l_returnflag").cast("bigint").alias("j"), whole("l_extendedprice", 100).alias("a"))
    x = dealt.select("i", weight("i").alias("xv"))
    return long_y(linalg.matvec_tiled(a, x, 4096, "merge"))


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, within, rows): the first line of the profile of a join, whether it has 50 lines at most, and the rows it counted."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    seen, text = report.profile(joined)
    lines = text.splitlines()
    return spark.createDataFrame([(lines[0], len(lines) <= 50, seen["rows"])], "head string, within boolean, rows bigint")


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, lines, keys) of a scan of orders as CSV where some lines hold a price that is no number, and some lack fields."""
    o = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    price = F.when(key % SPOILED["type"] == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.when(key % SPOILED["short"] == 0, F.concat_ws(",", key, "o_custkey")).otherwise(F.concat_ws(",", key, "o_custkey", "o_orderstatus", price))
    path = new_path(spark, "spoiled")
    headed = o.select(line.alias(",".join(o.columns)))
    headed.write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    found = tables.scan_csv(spark, path, o.schema)
    good = tables.accepted(found).select(F.lit("good").alias("kind"), "o_orderkey")
    bad = tables.quarantine(found).select(F.lit("bad").alias("kind"), F.split("bad_line", ",")[0].cast("bigint").alias("o_orderkey"))
    return good.union(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.sum("o_orderkey").alias("keys"))


def ordered_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, o_orderkey, cents): orders written as ordered CSV files by falling-price key order and read back through the manifest."""
    o, path = _orders(spark, sf_dir), new_path(spark, "ordered")
    tables.write_ordered(o, path, ["o_totalprice", "o_orderkey"], FILES)
    return tables.read_ordered(spark, path, o.schema).select("i", "o_orderkey", whole("o_totalprice", 100).cast("bigint").alias("cents"))


def _total(df: DataFrame) -> DataFrame:
    return df.select(F.col("s").cast("bigint").alias("s"))


def queries() -> dict:
    return {
        "lineitem_exact_sum": lambda s, d: exact.exact_sum(table(s, d, "lineitem"), "l_extendedprice"),
        "lineitem_exact_sum_by_line": lambda s, d: exact.exact_sum(table(s, d, "lineitem"), "l_extendedprice", ["l_linenumber"]),
        "lineitem_positions": lambda s, d: line_vector(s, d).select("i", F.col("v").cast("bigint").alias("cents")),
        "lineitem_vector_sum": lambda s, d: _total(reduce.array_sum(line_vector(s, d))),
        "lineitem_vector_lane_sums": lambda s, d: reduce.lane_sums(line_vector(s, d), lanes=4).select("lane", F.col("s").cast("bigint").alias("s")),
        "lineitem_vector_lanes_total": lambda s, d: _total(reduce.array_sum_lanes(line_vector(s, d))),
        "lineitem_vector_prefix": lambda s, d: _total(reduce.array_sum(line_vector(s, d), n=5000)),
        "lineitem_sweep_prefix_sums": lambda s, d: scan.prefix_sums(line_vector(s, d), [r.n for r in generate.sweep(s).collect()], strict=False).select("n", F.col("s").cast("bigint").alias("s")),
        "lineitem_running_sums": lambda s, d: scan.running_sums(line_vector(s, d), block=4096).select("i", F.col("s").cast("bigint").alias("s")),
        "embed_matvec": lambda s, d: long_y(linalg.matvec(embedding_cells(s, d), embedding_x(s, d))),
        "embed_matvec_tiled": lambda s, d: long_y(linalg.matvec_tiled(embedding_cells(s, d), embedding_x(s, d))),
        "embed_matvec_packed_rows": lambda s, d: long_y(linalg.matvec_rows(embedding_rows(s, d), embedding_x(s, d))),
        "embed_stored_tiles": lambda s, d: long_y(tiled.matvec_tiles(tiled.store_tiles(embedding_rows(s, d)), embedding_x(s, d))),
        "embed_row_dots": lambda s, d: long_y(linalg.matvec_packed(embedding_rows(s, d), s.range(64).select(F.col("id").alias("i"), weight("id").alias("xv")))),
        "lineitem_bucketed_lookup": bucketed_lookup,
        "lineitem_sparse_weights": sparse_weights,
        "lineitem_means": line_means,
        "lineitem_means_text": lambda s, d: formatted(line_means(s, d)),
        "lineitem_charts": lambda s, d: report.chart_frames(line_means(s, d)),
        "lineitem_timings": line_timings,
        "orders_price_ratio": lambda s, d: table(s, d, "orders").select("o_orderkey", fixed2(speedup(F.col("o_totalprice"), F.col("o_custkey").cast("double"))).alias("ratio")),
        "embed_generated_product": generated_product,
        "lineitem_generated_dot": generated_dot,
        "lineitem_hot_columns": hot_columns,
        "plan_node_rows": node_rows,
        "plan_report": plan_report,
        "orders_csv_quarantine": csv_quarantine,
        "orders_csv_ordered": ordered_csv,
    }


def oracle_sql() -> dict[str, str]:
    cents = lambda c: f"floor({c} * 100::DOUBLE + 0.5::DOUBLE)::BIGINT"
    vector = f"(SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS i, {cents('l_extendedprice')} AS v FROM lineitem)"
    cells = "(SELECT vec_id, p - 1 AS j, floor(embedding[p]::DOUBLE * 1000000::DOUBLE + 0.5::DOUBLE)::BIGINT AS a FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) e)"
    columns = f"SELECT j::BIGINT AS j, sum(a * (vec_id % 13 - 6))::BIGINT AS y FROM {cells} c GROUP BY j"
    rounded = "(sum((l_extendedprice * 4503599627370496)::HUGEINT)::DOUBLE / 4503599627370496) AS s"
    kinds = {"mat_bad_us": "l_returnflag = 'N' AND l_linestatus = 'O'", "mat_fast_us": "l_returnflag = 'N' AND l_linestatus <> 'O'", "sum_slow_us": "l_returnflag <> 'N' AND l_linestatus = 'O'", "sum_fast_us": "l_returnflag <> 'N' AND l_linestatus <> 'O'"}
    mean = {k: f"(sum({cents('l_extendedprice')}) FILTER (WHERE {w}))::DOUBLE / (count(*) FILTER (WHERE {w}))::DOUBLE" for k, w in kinds.items()}
    means = f"SELECT l_linenumber AS n, {mean['mat_bad_us']} AS mat_bad_us, {mean['mat_fast_us']} AS mat_fast_us, ({mean['mat_bad_us']}) / ({mean['mat_fast_us']}) AS mat_speedup, {mean['sum_slow_us']} AS sum_slow_us, {mean['sum_fast_us']} AS sum_fast_us, ({mean['sum_slow_us']}) / ({mean['sum_fast_us']}) AS sum_speedup FROM lineitem GROUP BY 1"
    charts = " UNION ALL ".join(f"SELECT '{name}' AS chart, n, '{label}' AS series, {c} AS value FROM m" for name, series in report.CHARTS.items() for c, label in series.items())
    bad = f"o_orderkey % {SPOILED['type']} = 0 OR o_orderkey % {SPOILED['short']} = 0"
    return {
        "lineitem_exact_sum": f"SELECT {rounded} FROM lineitem",
        "lineitem_exact_sum_by_line": f"SELECT l_linenumber, {rounded} FROM lineitem GROUP BY 1",
        "lineitem_positions": f"SELECT i, v AS cents FROM {vector} z",
        "lineitem_vector_sum": f"SELECT sum(v)::BIGINT AS s FROM {vector} z",
        "lineitem_vector_lane_sums": f"SELECT CASE WHEN i < (SELECT count(*) - count(*) % 4 FROM lineitem) THEN i % 4 ELSE 0 END AS lane, sum(v)::BIGINT AS s FROM {vector} z GROUP BY 1",
        "lineitem_vector_lanes_total": f"SELECT sum(v)::BIGINT AS s FROM {vector} z",
        "lineitem_vector_prefix": f"SELECT sum(v)::BIGINT AS s FROM {vector} z WHERE i < 5000",
        "lineitem_sweep_prefix_sums": f"SELECT n, CASE WHEN n <= (SELECT count(*) FROM lineitem) THEN sum(v)::BIGINT END AS s FROM range(512, 8193, 512) t(n) JOIN {vector} z ON z.i < t.n GROUP BY n",
        "lineitem_running_sums": f"SELECT i, (sum(v) OVER (ORDER BY i))::BIGINT AS s FROM {vector} z",
        **dict.fromkeys(("embed_matvec", "embed_matvec_tiled", "embed_matvec_packed_rows", "embed_stored_tiles"), columns),
        "embed_row_dots": f"SELECT vec_id AS i, sum(a * (j % 13 - 6))::BIGINT AS y FROM {cells} c GROUP BY 1",
        "lineitem_bucketed_lookup": "SELECT l_linenumber::BIGINT AS j, sum(l_quantity * (l_orderkey % 13 - 6))::BIGINT AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "lineitem_sparse_weights": "SELECT p_partkey AS j, coalesce(sum(l_quantity * (l_orderkey % 13 - 6)), 0)::BIGINT AS y FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
        "lineitem_means": means,
        "lineitem_means_text": "SELECT n, " + ", ".join(f"printf('%.2f', {c}) AS {c}" for c in MEASURES) + f" FROM ({means}) m",
        "lineitem_charts": f"WITH m AS ({means}) {charts}",
        "lineitem_timings": "SELECT what, reps::BIGINT AS reps FROM (VALUES ('sum', 3), ('exact_sum', 2)) v(what, reps) WHERE EXISTS (SELECT 1 FROM lineitem)",
        "orders_price_ratio": "SELECT o_orderkey, CASE WHEN o_custkey <> 0 THEN printf('%.2f', o_totalprice / o_custkey::DOUBLE) END AS ratio FROM orders",
        "embed_generated_product": f"SELECT k % 64 AS j, sum((k % 17 - 8) * y)::BIGINT AS y FROM range(4096) t(k) JOIN ({columns}) x ON x.j = k // 64 GROUP BY 1",
        "lineitem_generated_dot": f"SELECT sum(v * (i % 13 - 6))::BIGINT AS by_x, sum(v * (i % 19 - 9))::BIGINT AS by_arr FROM {vector} z WHERE i < 8192",
        "lineitem_hot_columns": f"SELECT ascii(l_returnflag)::BIGINT AS j, sum(v * (i % 13 - 6))::BIGINT AS y FROM (SELECT l_returnflag, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}, l_returnflag) - 1 AS i, {cents('l_extendedprice')} AS v FROM lineitem) z GROUP BY 1",
        "plan_report": "SELECT '== Physical Plan ==' AS head, true AS within, count(*) AS rows FROM (SELECT DISTINCT o_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) g",
        "plan_node_rows": "SELECT 'lineitem' AS node, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'join', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'aggregate', count(DISTINCT o_orderstatus) FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "orders_csv_quarantine": f"SELECT CASE WHEN {bad} THEN 'bad' ELSE 'good' END AS kind, count(*) AS lines, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
        "orders_csv_ordered": f"SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, o_orderkey, {cents('o_totalprice')} AS cents FROM orders",
    }
