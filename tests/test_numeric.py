import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tessera.functions.numeric import fixed2, speedup
from tessera.operators import linalg, reduce
from tessera.plans import catalog, harness, report
from tessera.sources import generate, records
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
# n: sum of the array, y[0], y[n-1], sum y, sum y squared
GOLDEN = {
    1: (-9, 48, 48, 48, 2304), 2: (-17, 78, 67, 145, 10573), 3: (-24, 81, 51, 198, 13518), 4: (-30, 56, 2, 116, 4984), 5: (-35, 44, 15, 173, 6987),
    63: (-39, 53, 34, -209, 226755), 64: (-42, -288, 99, 582, 1800286), 65: (-44, -27, 7, 13, 183691), 127: (-39, -16, -70, 200, 837148), 512: (-9, 85, -37, 48, 5771594),
}


def y_of(df):
    return [r["y"] for r in df.orderBy("j").collect()]


@pytest.mark.parametrize("n", GOLDEN)
def test_golden(spark, n):
    total, first, last, sum_y, sum_y2 = GOLDEN[n]
    a, x, arr = generate.matrix(spark, n), generate.vector_x(spark, n), generate.vector_arr(spark, n)
    y = y_of(linalg.matvec(a, x))
    assert (y[0], y[-1], sum(y), sum(v * v for v in y), len(y)) == (first, last, sum_y, sum_y2, n)
    assert y == y_of(linalg.matvec_tiled(a, x)) == y_of(linalg.matvec_rows(generate.matrix_rows(spark, n), x)) == y_of(linalg.matvec(a, x, "merge"))
    assert reduce.array_sum(arr).first().s == reduce.array_sum_lanes(arr, n=n).first().s == reduce.array_sum_lanes(arr).first().s == total


def test_orientation(spark):
    assert y_of(linalg.matvec(generate.matrix(spark, 4), generate.vector_x(spark, 4))) == [56, 38, 20, 2]


def test_edges(spark):
    arr = generate.vector_arr(spark, 0)
    assert reduce.array_sum(arr).first().s == 0.0 == reduce.array_sum_lanes(arr).first().s
    assert linalg.matvec(generate.matrix(spark, 0), generate.vector_x(spark, 0)).count() == 0
    assert reduce.array_sum(generate.vector_arr(spark, 512), n=100).first().s == -35
    dense = linalg.densify(linalg.matvec(generate.matrix(spark, 3), generate.vector_x(spark, 3)), 5).orderBy("j").collect()
    assert [r.y for r in dense] == [81, 66, 51, 0, 0]
    with pytest.raises(ValueError):
        linalg.check_shapes(generate.matrix(spark, 4), generate.vector_x(spark, 3))
    linalg.check_shapes(generate.matrix(spark, 4), generate.vector_x(spark, 4))
    nan = spark.createDataFrame([(0, 1.0), (1, math.nan)], "i long, v double")
    assert math.isnan(reduce.array_sum(nan).first().s)
    packed = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],)], "v array<double>")
    assert [(r[0], r[1]) for r in packed.select(reduce.packed_sum(F.col("v")), reduce.packed_sum(F.col("v"), 2)).collect()] == [(7, 3), (0, 0)]


def test_shapes_are_checked_by_the_product(spark):
    """A vector that lacks an index, or holds one twice, ends the query instead of changing its sums."""
    a, rows, short = generate.matrix(spark, 4), generate.matrix_rows(spark, 4), generate.vector_x(spark, 3)
    twice = short.union(generate.vector_x(spark, 4))
    for strategy in (None, "broadcast", "merge"):
        for product in (lambda x: linalg.matvec(a, x, strategy), lambda x: linalg.matvec_tiled(a, x, 2, strategy), lambda x: linalg.matvec_rows(rows, x, strategy)):
            with pytest.raises(Exception, match="no element for a row"):
                product(short).collect()
            with pytest.raises(Exception, match="holds an index twice"):
                product(twice).collect()
            assert y_of(product(generate.vector_x(spark, 5))) == [56, 38, 20, 2]
    arr = generate.vector_arr(spark, 10)
    for f in (reduce.array_sum, reduce.array_sum_lanes):
        with pytest.raises(Exception, match="fewer elements"):
            f(arr, n=11).collect()
        assert f(arr, n=10).first().s == -45 and f(generate.vector_arr(spark, 0), n=0).first().s == 0


def test_entry_without_a_dependency(tmp_path):
    """If a module that the corpus operators need is missing, the other queries are there all the same."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('blocked')")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{os.path.dirname(__spark_entry__.__file__)}"}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, check=True).stdout.split()
    assert said[-2:] == [str(len(catalog.queries())), "False"]


def test_linear_and_partition_invariant(spark):
    a, x = generate.matrix(spark, 65, partitions=3), generate.vector_x(spark, 65)
    y = y_of(linalg.matvec(a, x))
    assert y_of(linalg.matvec(a.repartition(7), x.withColumn("xv", F.col("xv") * 3))) == [3 * v for v in y]


def test_format(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (2.675,), (1234.5,), (math.inf,)], "x double")
    assert [r[0] for r in df.select(fixed2(F.col("x"))).collect()] == ["0.12", "1.00", "2.67", "1234.50", "inf"]
    assert df.select(speedup(F.col("x"), F.lit(0.0)).alias("r")).first().r is None


def test_records_round_trip(spark, tmp_path):
    r = catalog.records(spark)
    records.write_records(r, str(tmp_path / "r"))
    assert sorted(records.read_records(spark, str(tmp_path / "r")).collect()) == sorted(r.collect())
    assert report.chart_frames(r).count() == 96


def test_harness_and_profile(spark):
    out = harness.run_sweep(spark, [64], 2, 2).first()
    assert out.n == 64 and out.mat_speedup == pytest.approx(out.mat_bad_us / out.mat_fast_us)
    seen, plan = report.profile(generate.vector_x(spark, 10))
    assert seen["rows"] == 10 and 0 < len(plan.splitlines()) <= 50


def _table(rows, names):
    return sorted(tuple(repr(r[c]) for c in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _table([r.asDict() for r in got.collect()], names) == _table([dict(zip(names, r, strict=True)) for r in want.fetchall()], names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 64
    assert set(catalog.queries()) == set(catalog.oracle_sql())
