"""The registered queries over the generators, the timing records and the driver's tables, with their DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import fixed2, speedup
from tessera.operators import linalg, reduce
from tessera.plans import harness, report, stored
from tessera.sources import generate
from tessera.sources.records import MEASURES, RECORD_SCHEMA, read_records, write_records
from tessera.sources.shared import new_path

N, LARGE = 512, 4096
# The published timing records.
PUBLISHED = [
    (512, 1108.34, 196.26, 5.65, 0.53, 0.27, 1.93),
    (1024, 7699.94, 1287.99, 5.98, 1.20, 0.55, 2.17),
    (1536, 31405.91, 3982.62, 7.89, 2.59, 1.16, 2.24),
    (2048, 92803.39, 7369.92, 12.59, 3.12, 1.37, 2.27),
    (2560, 108190.48, 8021.27, 13.49, 3.11, 1.35, 2.30),
    (3072, 207764.21, 13314.62, 15.60, 4.50, 1.95, 2.31),
    (3584, 238289.15, 17032.44, 13.99, 4.79, 2.06, 2.33),
    (4096, 368931.68, 28630.92, 12.89, 6.14, 4.00, 1.53),
    (4608, 470585.35, 23235.65, 20.25, 5.68, 3.01, 1.88),
    (5120, 647996.98, 39426.33, 16.44, 6.35, 2.69, 2.36),
    (5632, 767537.65, 41592.18, 18.45, 8.37, 3.38, 2.47),
    (6144, 994086.81, 60962.48, 16.31, 8.32, 3.54, 2.35),
    (6656, 1253576.88, 96984.23, 12.93, 11.01, 5.16, 2.13),
    (7168, 1534984.30, 93071.17, 16.49, 13.37, 5.32, 2.52),
    (7680, 1940948.03, 76263.56, 25.45, 9.53, 4.03, 2.36),
    (8192, 2134475.63, 152087.23, 14.03, 11.03, 6.56, 1.68),
]
KERNELS = ["mat_bad_us", "mat_fast_us", "sum_slow_us", "sum_fast_us"]
PROBES = [(0, 0.125), (1, 1.005), (2, 2.675), (3, 1234.5), (4, 2134475.63)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, RECORD_SCHEMA)


def stored_records(spark: SparkSession) -> str:
    """The records written as CSV to the shared folder; where they are."""
    path = new_path(spark, "records")
    write_records(records(spark), path)
    return path


def timings(spark: SparkSession) -> DataFrame:
    """Repetitions of the four kernels at every size, made up: n * (1 + place of the kernel) + repetition microseconds."""
    kinds = F.array(*(F.struct(F.lit(c).alias("what"), F.lit(k).alias("k")) for k, c in enumerate(KERNELS, 1)))
    each = generate.sweep(spark).select("n", F.explode(kinds).alias("x"), F.sequence(F.lit(0), F.lit(harness.MATVEC_REPS - 1)).alias("reps"))
    rep = each.select("n", "x", F.explode("reps").alias("rep"))
    return rep.select(F.col("n").cast("int").alias("n"), "x.what", (F.col("n") * F.col("x.k") + F.col("rep")).cast("double").alias("us"))


def repetitions(spark: SparkSession) -> DataFrame:
    """(n, what, reps): how many positive times the harness took of each kernel."""
    taken = harness.samples(spark, [64], 2, 3)
    return taken.filter("us > 0").groupBy("n", "what").agg(F.count(F.lit(1)).alias("reps"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lineitem's run was observed to have."""
    seen, _ = report.profile(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return spark.createDataFrame([(seen["rows"],)], "observed_rows bigint")


def _products(f, n: int = N):
    return lambda spark, _: f(generate.matrix(spark, n), generate.vector_x(spark, n))


def embed_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix-vector product over the stored embeddings: weight vec_id % 13 - 6, values in millionths as integers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    units = F.floor(F.col("e").cast("double") * F.lit(1e6) + F.lit(0.5)).cast("bigint")
    return e.groupBy(F.col("pos").cast("bigint").alias("j")).agg(F.sum(units * (F.col("vec_id") % 13 - 6)).alias("y"))


def _price():
    return F.col("l_extendedprice").cast("decimal(18,2)")


def lineitem_lane_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 4).alias("lane")).agg(F.sum(_price()).alias("s"))
    return lanes.agg(F.sum("s").cast("decimal(38,2)").cast("string").alias("total"))


def orders_mean_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("bigint")).cast("double")
    mean = F.floor(cents / F.count(F.lit(1)).cast("double") + F.lit(0.5)).cast("bigint")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(mean.alias("mean_cents"))


def queries() -> dict:
    probe = lambda spark: spark.createDataFrame(PROBES, "k int, x double")
    out = {
        "gen_matrix_512": lambda s, _: generate.matrix(s, N),
        "gen_vectors_512": lambda s, _: generate.vector_x(s, N).join(generate.vector_arr(s, N), "i"),
        "gen_zeros_512": lambda s, _: generate.zeros(s, N),
        "sweep_sizes": lambda s, _: generate.sweep(s),
        "tile_grid_1000": lambda s, _: linalg.tiles(1000, s),
        "matvec_512": _products(linalg.matvec),
        "matvec_merge_512": _products(lambda a, x: linalg.matvec(a, x, "merge")),
        "matvec_tiled_512": _products(linalg.matvec_tiled),
        "matvec_rows_512": lambda s, _: linalg.matvec_rows(generate.matrix_rows(s, N), generate.vector_x(s, N)),
        "matvec_dense_600": lambda s, _: linalg.densify(linalg.matvec(generate.matrix(s, N), generate.vector_x(s, N)), 600),
        "matvec_4096": _products(linalg.matvec, LARGE),
        "matvec_tiled_4096": _products(linalg.matvec_tiled, LARGE),
        "arr_sum_512": lambda s, _: reduce.array_sum(generate.vector_arr(s, N)),
        "arr_sum_lanes_512": lambda s, _: reduce.array_sum_lanes(generate.vector_arr(s, N), n=N),
        "arr_lane_sums_511": lambda s, _: reduce.lane_sums(generate.vector_arr(s, N), n=511),
        "arr_sum_prefix": lambda s, _: reduce.array_sum(generate.vector_arr(s, N), n=100),
        "arr_sum_empty": lambda s, _: reduce.array_sum(generate.vector_arr(s, N), n=0),
        "embed_weighted_sum": embed_weighted_sum,
        "lineitem_sum_price": lambda s, d: table(s, d, "lineitem").agg(F.sum(_price()).cast("decimal(38,2)").cast("string").alias("total")),
        "lineitem_sum_by_line": lambda s, d: table(s, d, "lineitem").groupBy("l_linenumber").agg(F.sum(_price()).cast("decimal(38,2)").cast("string").alias("total")),
        "lineitem_lane_sum": lineitem_lane_sum,
        "orders_mean_price": orders_mean_price,
        "speedup_ratio": lambda s, _: records(s).select("n", speedup(F.col("mat_bad_us"), F.col("mat_fast_us")).alias("mat_ratio"), speedup(F.col("sum_slow_us"), F.lit(0.0)).alias("by_zero")),
        "fixed2_format": lambda s, _: probe(s).select("k", fixed2(F.col("x")).alias("text")),
        "records_project": lambda s, _: records(s),
        "records_csv_scan": lambda s, _: read_records(s, stored_records(s)),
        "records_csv_lines": lambda s, _: s.read.text(stored_records(s)).select(F.col("value").alias("line")),
        "timing_means": lambda s, _: harness.mean_by_size(timings(s)),
        "timing_repetitions": lambda s, _: repetitions(s),
        "observed_rows": observed,
        "chart_frames": lambda s, _: report.chart_frames(records(s)),
    }
    return out | stored.queries() | {f"chart_{name}": (lambda s, _, name=name: report.chart(records(s), name)) for name in report.CHARTS}


def oracle_sql() -> dict[str, str]:
    values = "(VALUES " + ", ".join(f"({n}, {', '.join(f'{v!r}::DOUBLE' for v in r)})" for n, *r in PUBLISHED) + ") AS r(n, mat_bad_us, mat_fast_us, mat_speedup, sum_slow_us, sum_fast_us, sum_speedup)"
    a = f"(SELECT k // {N} AS i, k % {N} AS j, (k % 17)::DOUBLE - 8::DOUBLE AS a FROM range({N * N}) t(k))"
    x = f"(SELECT k AS i, (k % 13)::DOUBLE - 6::DOUBLE AS xv FROM range({N}) t(k))"
    arr = f"(SELECT k AS i, (k % 19)::DOUBLE - 9::DOUBLE AS v FROM range({N}) t(k))"
    product = f"SELECT j, sum(a * xv) AS y FROM {a} m JOIN {x} x USING (i) GROUP BY j"
    large = product.replace(f"// {N}", f"// {LARGE}").replace(f"% {N}", f"% {LARGE}").replace(f"range({N * N})", f"range({LARGE * LARGE})").replace(f"range({N})", f"range({LARGE})")
    line = "concat_ws(',', n, " + ", ".join(f"printf('%.2f', {c})" for c in MEASURES) + ")"
    taken = ", ".join(f"({k}, '{c}')" for k, c in enumerate(KERNELS, 1))
    mean = {c: f"avg(us) FILTER (WHERE what = '{c}')" for c in KERNELS}
    total = f"SELECT coalesce(sum(v), 0)::DOUBLE AS s FROM {arr} z"
    price = "CAST(l_extendedprice AS DECIMAL(18,2))"
    series = {name: " UNION ALL ".join(f"SELECT '{name}' AS chart, n, '{label}' AS series, {c} AS value FROM {values}" for c, label in s.items()) for name, s in report.CHARTS.items()}
    out = {
        "gen_matrix_512": f"SELECT i, j, a FROM {a} m",
        "gen_vectors_512": f"SELECT i, xv, v FROM {x} x JOIN {arr} z USING (i)",
        "gen_zeros_512": f"SELECT k AS i, 0::DOUBLE AS v FROM range({N}) t(k)",
        "sweep_sizes": "SELECT k AS n FROM range(512, 8193, 512) t(k)",
        "tile_grid_1000": "SELECT r AS row_from, least(r + 64, 1000) AS row_to, c AS col_from, least(c + 64, 1000) AS col_to FROM range(0, 1000, 64) a(r), range(0, 1000, 64) b(c)",
        **dict.fromkeys(("matvec_512", "matvec_merge_512", "matvec_tiled_512", "matvec_rows_512"), product),
        **dict.fromkeys(("matvec_4096", "matvec_tiled_4096"), large),
        "matvec_dense_600": f"SELECT k AS j, coalesce(y, 0)::DOUBLE AS y FROM range(600) t(k) LEFT JOIN ({product}) p ON p.j = t.k",
        "arr_sum_512": total,
        "arr_sum_lanes_512": total,
        "arr_lane_sums_511": f"SELECT CASE WHEN i < 508 THEN i % 4 ELSE 0 END AS lane, sum(v) AS s FROM {arr} z WHERE i < 511 GROUP BY 1",
        "arr_sum_prefix": f"{total} WHERE i < 100",
        "arr_sum_empty": f"{total} WHERE i < 0",
        "embed_weighted_sum": "SELECT (p - 1)::BIGINT AS j, sum(floor(embedding[p]::DOUBLE * 1000000::DOUBLE + 0.5::DOUBLE)::BIGINT * (vec_id % 13 - 6))::BIGINT AS y FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) e GROUP BY 1",
        "lineitem_sum_price": f"SELECT sum({price})::DECIMAL(38,2)::VARCHAR AS total FROM lineitem",
        "lineitem_sum_by_line": f"SELECT l_linenumber, sum({price})::DECIMAL(38,2)::VARCHAR AS total FROM lineitem GROUP BY 1",
        "lineitem_lane_sum": f"SELECT sum(s)::DECIMAL(38,2)::VARCHAR AS total FROM (SELECT l_orderkey % 4 AS lane, sum({price}) AS s FROM lineitem GROUP BY 1) t",
        "orders_mean_price": "SELECT o_orderstatus, floor(sum(floor(o_totalprice * 100 + 0.5::DOUBLE)::BIGINT)::DOUBLE / count(*)::DOUBLE + 0.5::DOUBLE)::BIGINT AS mean_cents FROM orders GROUP BY 1",
        "speedup_ratio": f"SELECT n, mat_bad_us / mat_fast_us AS mat_ratio, NULL::DOUBLE AS by_zero FROM {values}",
        "fixed2_format": f"SELECT k, printf('%.2f', x) AS text FROM (VALUES {', '.join(f'({k}, {v!r}::DOUBLE)' for k, v in PROBES)}) p(k, x)",
        "records_project": f"SELECT * FROM {values}",
        "records_csv_scan": f"SELECT * FROM {values}",
        "records_csv_lines": f"SELECT 'n,{','.join(MEASURES)}' AS line UNION ALL SELECT {line} FROM {values}",
        "timing_means": f"SELECT n, {mean['mat_bad_us']} AS mat_bad_us, {mean['mat_fast_us']} AS mat_fast_us, {mean['mat_bad_us']} / {mean['mat_fast_us']} AS mat_speedup, {mean['sum_slow_us']} AS sum_slow_us, {mean['sum_fast_us']} AS sum_fast_us, {mean['sum_slow_us']} / {mean['sum_fast_us']} AS sum_speedup FROM (SELECT n::INTEGER AS n, what, (n * k + rep)::DOUBLE AS us FROM range(512, 8193, 512) t(n), (VALUES {taken}) v(k, what), range({harness.MATVEC_REPS}) r(rep)) s GROUP BY n",
        "timing_repetitions": "SELECT 64::INTEGER AS n, what, reps::BIGINT AS reps FROM (VALUES ('mat_bad_us', 2), ('mat_fast_us', 2), ('sum_slow_us', 3), ('sum_fast_us', 3)) v(what, reps)",
        "observed_rows": "SELECT count(*) AS observed_rows FROM lineitem",
        "chart_frames": " UNION ALL ".join(series.values()),
    }
    return out | stored.oracle_sql() | {f"chart_{name}": sql for name, sql in series.items()}
