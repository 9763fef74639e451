"""Iterative and graph operators on edge tables: components, closure, bounded chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import cut, drop_cut, sorted_join


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node of its component.

    Large-star and small-star rounds until nothing changes; each round ends in a scratch table, and only a row count and
    a checksum come to the driver. Loops and repeated edges are allowed; null ends are not links; no edges: no rows.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = cut(_downhill(links))
    state = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen[0] == 0 or seen == state:
            break
        state, before = seen, now
        now = cut(_downhill(_small_star(_downhill(_large_star(before)))))
        drop_cut(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, origin, depth): what each seed (node, origin) reaches over edges (a, b), at its least depth.

    Semi-naive: each round joins only what the last round added, until it adds nothing; nothing is broadcast. ``edges`` are
    read each round: a frame that is work to make is cut before.
    """
    known = fresh = cut(seeds.select("node", "origin", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        step = sorted_join(fresh).join(edges, fresh["node"] == edges["a"]).select(F.col("b").alias("node"), "origin").distinct()
        fresh = cut(step.join(sorted_join(known.select("node", "origin")), ["node", "origin"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known


def chain_end(starts: DataFrame, next_of: DataFrame, hops: int = 8) -> DataFrame:
    """(start, end, hops): follow ``next_of`` (node, next) for at most ``hops`` steps; end is null on a cycle or beyond.

    ``next_of`` has one row a node.
    """
    now = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(False).alias("done"))
    for _ in range(hops + 1):
        joined = now.join(next_of, now["at"] == next_of["node"], "left")
        stuck = F.col("done") | F.col("next").isNull()
        now = joined.select(
            "start", F.when(F.col("done") | F.col("next").isNull(), F.col("at")).when(F.array_contains("path", F.col("next")), None).otherwise(F.col("next")).alias("at"),
            F.when(stuck, F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"), (stuck | F.array_contains("path", F.col("next"))).alias("done"))
    return now.select("start", F.when(F.col("done"), F.col("at")).alias("end"), (F.size("path") - 1).alias("hops"))


def resolve_paths(next_of: DataFrame) -> DataFrame:
    """(start, end, path): where each node of ``next_of`` (node, next) leads in the end, and over which nodes, both included.

    Pointer jumping: each round a node takes over all that the node it points at has found, so shared tails are followed
    once and a chain of n nodes takes log2(n) rounds. Distances along a chain have no gaps: a round in which no node
    reaches its end shows that those still on the way never will. They run in circles, and have neither end nor path.
    ``next_of`` has one row a node; a null next, or one without a row, is an end.
    """
    steps = next_of.select("node", "next").distinct()
    known = steps.select("node")
    ahead = steps.join(known.withColumnRenamed("node", "next").withColumn("_on", F.lit(True)), "next", "left")
    done = F.coalesce(~F.col("_on"), F.lit(True))
    last = F.when(done, F.coalesce("next", "node")).otherwise(F.col("next"))
    now = cut(ahead.select("node", last.alias("at"), F.when(F.col("next").isNull(), F.array("node")).otherwise(F.array("node", "next")).alias("path"), done.alias("done")))
    left = now.where("not done").count()
    while left:
        tail = now.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.slice("path", 2, 1 << 30).alias("_tail"), F.col("done").alias("_done"))
        far = now.where("not done").join(tail, "at").select("node", F.col("_at").alias("at"), F.concat("path", "_tail").alias("path"), F.col("_done").alias("done"))
        before, now = now, cut(now.where("done").unionByName(far))
        drop_cut(before)
        more = now.where("not done").count()
        if more == left:
            break
        left = more
    return now.select(F.col("node").alias("start"), F.when(F.col("done"), F.col("at")).alias("end"), F.when(F.col("done"), F.col("path")).alias("path"))
