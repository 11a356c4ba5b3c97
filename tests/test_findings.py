"""Small tables on which queries once differed from their SQL or did not end."""

import math
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from loomwork import queries
from loomwork.operators import graph, shape, stats, taxonomy


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_equal_lines_share_a_rank(spark, tmp_path):
    nan = float("nan")
    rows = [(1, 1, 5.0), (1, 1, 5.0), (1, 2, 5.0), (1, 3, 9.0), (1, 3, None), (1, 4, nan), (1, None, 5.0), (2, 1, 7.0), (None, 1, 7.0), (None, 1, 7.0), (None, 2, 1.0), (2**60 + 1, 1, 1.0), (2**60, 1, 2.0), (3, 1, 0.0), (3, 1, -0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL["python_cell_rank"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["python_cell_rank"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "price_rank").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def brute_betweenness(pairs, sources):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        gained = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    gained[v] += paths[v] / paths[w] * (1 + gained[w])
            if w != s:
                total[w] += gained[w]
    n = len(near)
    return {k: v / ((n - 1) * (n - 2)) for k, v in total.items()}


def test_betweenness_of_branches_and_circles(spark, monkeypatch):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (5, 7), (3, 8), (8, 9), (9, 10), (10, 8), (10, 11), (20, 21), (21, 22), (21, 23), (30, 31), (40, 41), (41, 42), (42, 40), (42, 43)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    nodes = sorted({x for p in pairs for x in p})
    for asked in (nodes, [1, 6, 8, 22, 43]):
        want = brute_betweenness(pairs, asked)
        sources = None if asked is nodes else spark.createDataFrame([(x,) for x in asked], "node long")
        got = as_dict(graph.betweenness(df, sources), "node", "betweenness")
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    monkeypatch.setattr(graph, "BREADTH", 30)  # several blocks of sources
    got, want = as_dict(graph.betweenness(df), "node", "betweenness"), brute_betweenness(pairs, nodes)
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_betweenness_of_a_large_star(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))  # 10^10 pairs of nodes
    assert graph.betweenness(star).filter("betweenness > 0").collect() == [(0, 1.0)]


def test_triangles_over_several_colours_and_rounds(spark, monkeypatch):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)} | {(0, x) for x in range(1, 200)} | {(-(2**60), -(2**60) + k) for k in (1, 2)} | {(-(2**60) + 1, -(2**60) + 2)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: sum(b in near[a] for a in s for b in s if a < b) for v, s in near.items()}
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    monkeypatch.setattr(graph, "TRIANGLE_EDGES", 120)
    for copies in (100, 2):
        monkeypatch.setattr(graph, "COPIES", copies)
        assert as_dict(graph.clustering(df), "node", "triangles") == want
    text = df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    assert as_dict(graph.clustering(text), "node", "triangles") == {str(k): n for k, n in want.items()}


def test_a_task_of_triangles_holds_few_bytes_an_edge():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 80_000, 1_000_000)
    a, b = np.divmod(np.unique(a * 100_000 + a + rng.integers(1, 200, len(a))), 100_000)
    pack, count = graph._triangle_tasks(1, 1)
    packed = list(pack(0)([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]))
    packed = [pa.RecordBatch.from_arrays([x.column("tasks").flatten(), x.column("edges")], names=["task", "edges"]) for x in packed]
    tracemalloc.start()
    try:
        found = sum(pc.sum(x.column("triangles")).as_py() for x in count(iter(packed)))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > 0 and held < 100 * len(a)


@pytest.mark.parametrize("few", [10_000, 1])
def test_a_level_of_detail_field_gathers_no_group(spark, monkeypatch, few):
    monkeypatch.setattr(shape, "FEW_GROUPS", few)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), (None, 4.0), ("b", None)], "k string, v double")
    out = shape.lod(shape.lod(df, "total", "sum", "v", ["k"]), "n", "count", "v", ["k"])
    assert sorted((str(r.k), str(r.v), str(r.total), r.n) for r in out.collect()) == [("None", "3.0", "7.0", 2), ("None", "4.0", "7.0", 2), ("a", "1.0", "3.0", 2), ("a", "2.0", "3.0", 2), ("b", "None", "None", 0)]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_values_of_nodes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    ways = spark.range(100).select(F.col("id").alias("src"), (F.col("id") % 7).alias("dst"))
    values = spark.range(7).select(F.col("id").alias("node"), F.col("id").alias("h"))
    out = graph.beside(ways, values, ways.count(), "dst")
    assert out.count() == 100 and out.rdd.getNumPartitions() == 10
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_percentiles_hold_no_column_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 7)
    nan = float("nan")
    rows = [(float(k * 37 % 101), float(k % 3), None, nan if k % 2 else 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, none double, nan double")
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in df.columns]).first()
    got = stats.percentiles(df, {c: F.col(c) for c in df.columns}, shares)
    for c in df.columns:
        assert [str(x) for x in got[c]] == [str(x) for x in (want[c] or [None] * 5)]
    assert stats.percentiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    assert "percentile(" not in stats.descriptives(df, ["a", "b"])._jdf.queryExecution().toString()


def test_every_number_passes_the_guard_of_the_cast(spark):
    texts = ["1", " 1.5\t", "+.5", "5.", "-1e3", "1E-2", "1d", "2.5F", "0x1p3", "0X1.8P-1d", "inf", "-Infinity", "NaN", "nan", "+INF", "", ".", "e5", "5-LOW", "2024-01-01", "Customer#1", "1,5", "1e", "0x10", "\n7\r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.filter(F.col("t").try_cast("double").isNotNull() & ~F.col("t").rlike(taxonomy._NUMBER))
    assert wrong.collect() == [] and df.filter(F.col("t").rlike(taxonomy._NUMBER)).filter("t in ('5-LOW', '2024-01-01', 'Customer#1')").count() == 0


def test_columns_are_classified_one_by_one(spark):
    df = spark.createDataFrame([("a@b.c", "5"), ("x@y.z", "7")], "email string, qty string")
    seen = []
    whole = type(df).agg
    try:
        type(df).agg = lambda self, *aggs: seen.append(len(aggs)) or whole(self, *aggs)
        got = {r["column"]: r["type"] for r in taxonomy.classify(df)}
    finally:
        type(df).agg = whole
    assert got == {"email": "email", "qty": "quantity"} and len(seen) == 2 and max(seen) < 100
