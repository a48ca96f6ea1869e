"""Exact sums, positions, scans, stored tiles, packed, bucketed and sparse products, plan metrics, CSV in and out: against plain loops, with plans and edge cases."""

import itertools
import math
import os
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import exact, linalg, position, scan, sparse, spread, tiled
from tessera.plans import metrics
from tessera.plans import stored as queries
from tessera.sources import tables

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vector(spark, values, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(parts)


# exact sums


def awkward():
    r = random.Random(1)
    out = [r.uniform(-1, 1) * 2.0 ** r.randint(-1060, 1000) for _ in range(3000)] + [5e-324, -5e-324, 2.0**-1022, 1e16, 1.0, -1e16, 0.1, 0.0, -0.0]
    return out + [2.0**k for k in range(-1074, 1020, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 11)]


def test_exact_sum_equals_fsum_over_any_partitions(spark):
    for values in (awkward(), [0.1] * 1000, [1e16, 1.0, -1e16] * 99, [1.0, 2.0**-53, 2.0**-106], [2.0**53, 1.0, 1.0, -0.5]):
        want = math.fsum(values)
        for parts in (1, 4, 64):
            got = exact.exact_sum(vector(spark, values, parts)).collect()
            assert [r.s for r in got] == [want]


def test_exact_sum_of_prices(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_linenumber")
    want = math.fsum(r[0] for r in lines.collect())
    assert {exact.exact_sum(lines.repartition(n), "l_extendedprice").first().s for n in (1, 4, 64)} == {want}


def test_exact_sum_special_cases(spark):
    nan, inf = math.nan, math.inf
    rows = [("a", 1.0), ("a", None), ("b", None), ("c", nan), ("c", 1.0), ("d", inf), ("d", 1.0), ("e", inf), ("e", -inf), ("f", -inf), (None, 2.0), ("g", 1.7e308), ("g", 1.7e308), ("h", -1.7e308), ("h", -1.7e308), ("i", 0.0)]
    got = {r.g: r.s for r in exact.exact_sum(spark.createDataFrame(rows, "g string, v double"), by=["g"]).collect()}
    assert math.isnan(got.pop("c")) and math.isnan(got.pop("e"))
    assert got == {"a": 1.0, "b": 0.0, "d": inf, "f": -inf, None: 2.0, "g": inf, "h": -inf, "i": 0.0}
    huge = [1.7e308, 1.7e308, -1.7e308, -1.6e308, 3.0]  # beyond the largest double on the way
    assert exact.exact_sum(vector(spark, huge)).first().s == float(sum(map(Fraction, huge)))
    empty = spark.createDataFrame([], "v double")
    assert [r.s for r in exact.exact_sum(empty).collect()] == [0.0]
    assert exact.rounded([0], [1], [0]) == 2.0 ** (exact.LOW_BITS - 52)


# positions and scans


def test_positions_are_gapless_and_ordered(spark):
    r = random.Random(2)
    rows = [(r.choice([7, 7, 7, k]), r.randint(0, 5), k) for k in range(2000)] + [(None, 1, -1)] + [(9, 9, 9)] * 50
    df = spark.createDataFrame(rows, "a long, b long, at long").repartition(6)
    for parts in (1, 5, 40):
        out = position.with_positions(df, ["a", F.col("b")], partitions=parts)
        got = out.orderBy("i").collect()
        assert [x.i for x in got] == list(range(len(rows))) and out.columns == ["a", "b", "at", "i"]
        assert [(x.a, x.b) for x in got] == sorted(((a, b) for a, b, _ in rows), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        assert sorted((x.a or 0, x.b, x.at) for x in got) == sorted((a or 0, b, c) for a, b, c in rows)
    assert "Window" not in plan(out) and "SinglePartition" not in plan(out)
    assert position.with_positions(df.limit(0), ["a"]).count() == 0
    clash = df.withColumnRenamed("at", "task")
    assert position.with_positions(clash.withColumn("I", F.lit("x")), ["a"], "i").columns == ["a", "b", "task", "i"]


def test_hot_key_is_dealt_over_ranges(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id"))
    out = position.with_positions(df, ["k"], partitions=8)
    ranges = out.groupBy(F.input_file_name()).count().collect()
    assert len(ranges) > 4 and max(r[1] for r in ranges) < 8000


def test_ranges_grow_in_number_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    out = position.with_positions(spark.range(4000).select(F.col("id").alias("k")), ["k"])
    ranges = [r[1] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(ranges) > 30 and max(ranges) < 300
    assert [spread.tasks(spark, n * 100) for n in (199, 201, 800, 801, 4000)] == [199, 200, 200, 201, 1000]
    assert spread.tasks(spark, 0, 3) == 3 and spread.tasks(spark, 301, 3) == 4 and spread.tasks(spark, 0) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("block", [2, 3, 64, 1 << 16])
def test_running_sums(spark, block):
    values = [float((k * 37) % 101 - 50) for k in range(300)]
    got = scan.running_sums(vector(spark, values), block=block).orderBy("i").collect()
    assert [r.s for r in got] == list(itertools.accumulate(values)) and [r.v for r in got] == values
    assert scan.running_sums(vector(spark, values).limit(0), block=block).count() == 0


def test_prefix_sums(spark):
    values = [float((k * 37) % 101 - 50) for k in range(300)]
    sizes = [0, 1, 7, 64, 299, 300]
    df = vector(spark, values)
    assert {r.n: r.s for r in scan.prefix_sums(df, [*sizes, 7]).collect()} == {n: sum(values[:n]) for n in sizes}
    assert {r.n: r.s for r in scan.prefix_sums(df, [10, 301], strict=False).collect()} == {10: sum(values[:10]), 301: None}
    assert [tuple(r) for r in scan.prefix_sums(df.limit(0), [0]).collect()] == [(0, 0.0)] and scan.prefix_sums(df, []).count() == 0
    with pytest.raises(Exception, match="fewer elements"):
        scan.prefix_sums(df, [301]).collect()
    with pytest.raises(ValueError):
        scan.prefix_sums(df, range(1000))
    with pytest.raises(ValueError):
        scan.running_sums(df, block=1)


def test_sweep_of_prefixes_is_one_scan_without_a_whole_window(spark):
    df = queries.queries()["lineitem_sweep_prefix_sums"](spark, SF)
    assert plan(df).count("FileScan") == 1 and "Window" not in plan(df)
    running = scan.running_sums(vector(spark, [1.0] * 100), length=100, block=8)
    assert all("windowspecdefinition(b#" in line for line in plan(running).splitlines() if "windowspecdefinition" in line)


# products


def packed(spark, m, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in m.items()] + list(extra), "i long, row array<double>").repartition(3)


def x_of(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in x.items()], "i long, xv double")


@pytest.mark.parametrize("rows,cols,tile", [(1, 1, 64), (5, 7, 2), (10, 4, 4), (65, 130, 64), (12, 9, 3)])
def test_tiles_match_loops(spark, rows, cols, tile):
    r = random.Random(rows)
    m = {i: [r.randint(-9, 9) for _ in range(cols)] for i in range(rows) if rows < 6 or i % 5 != 3}  # rows may be missing
    x = {i: r.randint(-9, 9) for i in range(rows + 2)}
    stored = tiled.store_tiles(packed(spark, m), tile)
    shapes = {(t.tile_row, t.tile_col): (len(t.at), t.cols, len(t.cells)) for t in stored.collect()}
    for (i, j), (height, width, cells) in shapes.items():
        assert width == min(tile, cols - j * tile) and cells == height * width and height == sum(i * tile <= k < (i + 1) * tile for k in m)
    got = {t.j: t.y for t in tiled.matvec_tiles(stored, x_of(spark, x), tile).collect()}
    assert got == {j: sum(m[i][j] * x[i] for i in m) for j in range(cols)}


def test_tiles_check_shapes(spark):
    m, x = {0: [1, 2], 1: [3, 4]}, {0: 1, 1: 1}
    with pytest.raises(Exception, match="row twice"):
        tiled.to_tiles(packed(spark, m, [(1, [5.0, 6.0])])).collect()
    with pytest.raises(Exception, match="differ in length"):
        tiled.to_tiles(packed(spark, m, [(2, [5.0])])).collect()
    stored = tiled.store_tiles(packed(spark, m))
    with pytest.raises(Exception, match="no element"):
        tiled.matvec_tiles(stored, x_of(spark, {0: 1})).collect()
    with pytest.raises(Exception, match="no element"):
        tiled.matvec_tiles(stored, x_of(spark, {70: 1})).collect()
    with pytest.raises(Exception, match="index twice"):
        tiled.matvec_tiles(stored, x_of(spark, x).union(x_of(spark, x))).collect()
    assert tiled.matvec_tiles(tiled.to_tiles(packed(spark, m).limit(0)), x_of(spark, x)).count() == 0
    with pytest.raises(ValueError):
        tiled.to_tiles(packed(spark, m), 0)


def test_tiles_shuffle_fewer_rows_than_cells(spark):
    stored = tiled.store_tiles(queries.embedding_rows(spark, SF))
    x = queries.embedding_x(spark, SF)
    moved = lambda df: sum(r.shuffled_rows or 0 for r in metrics.node_metrics(df).collect())
    tiles, cells = moved(tiled.matvec_tiles(stored, x)), moved(linalg.matvec(queries.embedding_cells(spark, SF), x))
    assert 0 < tiles < cells


def test_packed_product_shuffles_nothing(spark):
    m, x = {0: [1, 2, 3], 5: [4, 5, 6], 9: [0, 0, 1]}, {0: 2, 1: 3, 2: -1}
    out = linalg.matvec_packed(packed(spark, m).coalesce(1), x_of(spark, x))
    assert {r.i: r.y for r in out.collect()} == {i: sum(a * x[j] for j, a in enumerate(row)) for i, row in m.items()}
    assert "Exchange" not in plan(queries.queries()["embed_row_dots"](spark, SF))
    with pytest.raises(Exception, match="differ in length"):
        linalg.matvec_packed(packed(spark, {0: [1, 2]}), x_of(spark, x)).collect()
    for wrong in ({0: 1, 2: 1}, {1: 1}):
        with pytest.raises(ValueError):
            linalg.matvec_packed(packed(spark, m), x_of(spark, wrong))
    with pytest.raises(ValueError):
        linalg.matvec_packed(packed(spark, m), spark.range(linalg.LITERAL + 1).select(F.col("id").alias("i"), F.lit(1.0).alias("xv")))


def test_merge_join_holds_no_map_of_indices(spark):
    a, x = spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 3).alias("j"), F.lit(2.0).alias("a")), x_of(spark, {i: i for i in range(60)})
    x = x.union(spark.createDataFrame([(None, 5.0), (None, 6.0)], x.schema))  # met by no row, so no index held twice
    out = linalg.matvec_tiled(a, x, 4, "merge")
    assert "SortMergeJoin" in plan(out) and "keys=[i#" not in plan(out)
    assert {r.j: r.y for r in out.collect()} == {j: 2.0 * sum(range(j, 50, 3)) for j in range(3)}
    with pytest.raises(Exception, match="index twice"):
        linalg.lookup(a, x.union(x.filter("i = 7")), "merge").collect()


def test_hot_columns_meet_in_tasks_by_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 2000)
    df = queries.queries()["lineitem_hot_columns"](spark, SF)
    count = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 2000)
    assert set(re.findall(r"hashpartitioning\(i#\d+L?, (\d+)\)", plan(df))) == {str(count)}


def test_bucketed_lookup_joins_without_an_exchange(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").alias("a"))
    x = queries.order_x(spark, SF)
    a, b = linalg.bucketed(lines, 8, name="lines"), linalg.bucketed(x, 8, name="orders")
    met = linalg.lookup(a, b, "merge")
    assert "SortMergeJoin" in plan(met) and "Exchange" not in plan(met)
    assert met.count() == lines.count()
    short = linalg.bucketed(x.filter("i % 7 <> 0"), 8)
    with pytest.raises(Exception, match="no element for a row"):
        linalg.lookup(a, short, "merge").collect()
    with pytest.raises(Exception, match="index twice"):
        linalg.lookup(a, linalg.bucketed(x.union(x), 8), "merge").collect()


def test_hot_index_lies_apart_from_the_buckets(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("i"), (F.col("id") % 5).alias("j"), F.col("id").cast("double").alias("a"))
    x = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") % 13 - 6.0).alias("xv"))
    held, by_index = linalg.Buckets.of(rows, 6), linalg.bucketed(x, 6)
    assert held.hot == [7] and held.apart.count() == rows.filter("i = 7").count() and held.cool.filter("i = 7").count() == 0
    met = held.lookup(by_index)
    assert "ShuffleExchange" not in plan(met) and "Exchange hashpartitioning" not in plan(met)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, linalg.lookup(rows, x).collect()))
    assert sorted(map(tuple, held.matvec(by_index).collect())) == sorted(map(tuple, linalg.matvec(rows, x).collect()))
    with pytest.raises(Exception, match="no element for a row"):
        held.lookup(linalg.bucketed(x.filter("i <> 7"), 6)).collect()
    none = linalg.Buckets.of(rows.limit(0), 6)
    assert none.hot == [] and none.matvec(by_index).count() == 0


def test_buckets_grow_in_number_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 4000)
    df = queries.queries()["lineitem_bucketed_lookup"](spark, SF)
    count = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 4000)
    assert set(re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", df._jdf.queryExecution().toString())) == {str(count)} and count > queries.BUCKETS
    assert df.count() == 7


def test_hot_index_is_told_from_others_in_its_slot(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("a"))
    for slots in (1, 2, 1 << 14):
        monkeypatch.setattr(linalg, "SLOTS", slots)
        held = linalg.Buckets.of(rows.filter("i is not null"), 6)
        assert held.hot == [7] and held.apart.count() == 1000 and held.cool.count() == 1000
        assert linalg.Buckets.of(rows, 6).cool.filter("i is null").count() == 1000
        assert linalg.Buckets.of(rows.filter("i <> 7"), 6).hot == []


def test_sparse_product(spark):
    entries = [(0, 5, 1.0), (0, 5000, 2.0), (0, 5, 4.0), (3, 7, -1.0), (3, 5, 2.0)]
    a = spark.createDataFrame(entries, "i long, j long, a double").repartition(3)
    rows = {(r.i, r.block): (r.js, r.cells) for r in sparse.compress(a).collect()}
    assert rows == {(0, 0): ([5], [5.0]), (0, 1): ([5000], [2.0]), (3, 0): ([5, 7], [2.0, -1.0])}
    y = sparse.matvec_sparse(sparse.compress(a, 3), x_of(spark, {0: 10, 3: 1, 4: 9}))
    assert {r.j: r.y for r in y.collect()} == {5: 52.0, 7: -1.0, 5000: 20.0}
    domain = spark.createDataFrame([(5,), (6,), (6,), (7,)], "j long")
    assert sorted(tuple(r) for r in sparse.zero_filled(y, domain).collect()) == [(5, 52.0), (6, 0.0), (7, -1.0)]
    with pytest.raises(Exception, match="no element for a row"):
        sparse.matvec_sparse(sparse.compress(a), x_of(spark, {0: 1})).collect()
    assert sparse.matvec_sparse(sparse.compress(a.limit(0)), x_of(spark, {0: 1})).count() == 0


def test_sparse_rows_meet_in_tasks_by_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 2000)
    monkeypatch.setattr(linalg, "BROADCAST_ROWS", 100)
    df = queries.queries()["lineitem_sparse_weights"](spark, SF)
    count = str(-(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 2000))
    dealt = re.findall(r"hashpartitioning\(((?:\w+#\d+L?, )+)(\d+)\), REPARTITION_BY_NUM", plan(df))
    assert sorted((re.sub(r"#\d+L?, ", " ", keys), n) for keys, n in dealt) == [("i ", count), ("i ", count), ("i block ", count), ("i j read ", count)]
    assert df.count() == 2000


def test_place_held_often_meets_only_its_sums(spark):
    a = spark.range(0, 4000, 1, 8).select((F.col("id") % 2).alias("i"), (F.col("id") % 2 * 5000).alias("j"), F.lit(1.0).alias("a"))
    assert sorted(map(tuple, sparse.compress(a).collect())) == [(0, 0, [0], [2000.0]), (1, 1, [5000], [2000.0])]
    rows = [r.shuffled_rows for r in metrics.node_metrics(sparse.compress(a)).collect() if r.shuffled_rows]
    assert sorted(rows) == [16, 4000]  # the entries by place and reading task, then a sum for each of the 8 tasks


# metrics, CSV


def test_node_metrics(spark):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    df = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.sum("l_quantity").alias("q"))
    m = metrics.node_metrics(df).orderBy("node").collect()
    assert [r.node for r in m] == list(range(len(m))) and m[0].parent is None and all(r.parent < r.node and r.depth == m[r.parent].depth + 1 for r in m[1:])
    by = lambda part: [r for r in m if part in r.operator]
    assert sorted(r.rows for r in by("Scan")) == [orders.count(), lines.count()] and by("SortMergeJoin")[0].rows == lines.count()
    exchanges = by("ShuffleExchange")
    assert {lines.count(), orders.count()} <= {r.shuffled_rows for r in exchanges} and all(r.bytes > 0 for r in exchanges)
    assert by("Sort")[0].spill == 0 and sum(r.ms for r in m) > 0
    assert metrics.node_metrics(spark.range(10)).first().rows == 10


def test_scan_keeps_bad_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
    (tmp_path / "a.csv").write_text('k,name,price\n1,one,1.5\n2,two,x\n3,three\nz,"a,b",4\n5,five,5,6\n6,"si""x",6\n7,,\n')
    found = tables.scan_csv(spark, str(tmp_path / "a.csv"), schema, escape='"')
    assert sorted(tuple(r) for r in tables.accepted(found).collect()) == [(1, "one", 1.5), (6, 'si"x', 6.0), (7, None, None)]
    assert sorted(r.bad_line for r in tables.quarantine(found).collect()) == ["2,two,x", "3,three", "5,five,5,6", 'z,"a,b",4']
    (tmp_path / "b.csv").write_text("k,title,price\n1,one,1.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.scan_csv(spark, str(tmp_path / "b.csv"), schema)
    (tmp_path / "c.csv").write_text("k,name,price\n")
    assert tables.scan_csv(spark, str(tmp_path / "c.csv"), schema).count() == 0
    with pytest.raises(ValueError):
        tables.scan_csv(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("bad_line", T.StringType())]))


def test_ordered_sink(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, r.random() * 100, f'name "{k}", x') for k in range(1000)]
    r.shuffle(rows)
    df, path = spark.createDataFrame(rows, "k long, price double, name string").repartition(7), str(tmp_path / "o")
    manifest = tables.write_ordered(df, path, ["price", "k"], 5).orderBy("part").collect()
    assert [m.part for m in manifest] == list(range(5)) and sum(m.rows for m in manifest) == 1000
    back = tables.read_ordered(spark, path, df.schema).orderBy("i").collect()
    assert [(b.k, b.price) for b in back] == [(k, p) for k, p, _ in sorted(rows, key=lambda t: (t[1], t[0]))] and [b.i for b in back] == list(range(1000))
    part = f"{path}/data/part=2"
    os.remove(next(f"{part}/{f}" for f in os.listdir(part) if f.startswith("part")))
    with pytest.raises(ValueError, match="file 2"):
        tables.read_ordered(spark, path, df.schema)
    with pytest.raises(ValueError):
        tables.write_ordered(df.withColumnRenamed("k", "part"), str(tmp_path / "p"), ["part"], 2)
