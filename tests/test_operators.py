from pyspark.sql import functions as F

from sparkloom.operators import aggs, graph, joins


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and None not in got
    assert graph.components(edges.limit(0), "a", "b").count() == 0
    nxt = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "node long, next long")
    ends = {r.start: r.end for r in graph.chain_end(spark.createDataFrame([(1,), (5,), (9,)], "node long"), nxt).collect()}
    assert ends == {1: 3, 5: None, 9: 9}


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 1)], "id int, k string, t int")
    right = spark.createDataFrame([(20, "a", 5), (10, "a", 5), (30, "a", 4)], "id int, k string, t int")
    got = {r.id: r.owner for r in joins.asof_backward(left, right, "k", "t", {"id": "owner"}, "id").collect()}
    assert got == {1: 10, 2: None, 3: None, 4: None}


def test_global_number_is_gapless_under_any_partitioning(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r.number, r.v, r.id) for r in aggs.global_number(rows, ["v", "id"]).collect())
        assert [g[0] for g in got] == list(range(1, 1001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert aggs.global_number(rows.limit(0), ["v", "id"]).count() == 0


def test_largest_remainder_adds_up(spark):
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert sorted((r.k, r.percent) for r in aggs.largest_remainder(c, "k", "n").collect()) == [("a", 34), ("b", 33), ("c", 33)]


def test_paths_share_tails_and_circles_have_none(spark):
    from sparkloom.operators import graph

    steps = [(i, i + 1) for i in range(37)] + [(100, 3), (101, 100), (50, 51), (51, 52), (52, 50), (53, 51), (60, None), (61, 60), (70, 70)]
    got = {r.start: (r.end, r.path) for r in graph.resolve_paths(spark.createDataFrame(steps, "node int, next int")).collect()}
    assert {k: got[k] for k in (50, 51, 52, 53, 70)} == dict.fromkeys((50, 51, 52, 53, 70), (None, None))
    assert got[0] == (37, list(range(38))) and got[36] == (37, [36, 37]) and got[101] == (37, [101, 100, *range(3, 38)]) and got[60] == (60, [60]) and got[61] == (60, [61, 60])
    assert graph.resolve_paths(spark.createDataFrame([], "node int, next int")).count() == 0
