"""MinHash sketches, lossless banding, duplicate clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import LANES, sketch_similarity
from sparkloom.operators.graph import components
from sparkloom.scratch import cut, sorted_join


def candidate_pairs(sketches: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct sketches with similarity of at least ``least``.

    Pairs that differ in at most d lanes share a band if there are more than d bands, so the banding misses none. Equal
    sketches are one representative (the smallest name) here; :func:`clusters` puts their members back.
    """
    differ = LANES - -(-int(round(least * LANES * 1e6)) // 1_000_000)
    bands = next(b for b in (1, 2, 4, 8, 16, 32, 64) if b > differ)
    width = LANES // bands
    rows = cut(sketches.where("sketch is not null").groupBy("sketch").agg(F.min(name).alias("name")))  # both sides read it
    keyed = rows.select("name", "sketch", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("sketch", i * width + 1, width)))).alias("band", "key"))
    left = keyed.select(F.col("name").alias("a"), F.col("sketch").alias("sa"), "band", "key")
    right = keyed.select(F.col("name").alias("b"), F.col("sketch").alias("sb"), "band", "key")
    # a pair counts in its first common band only
    first = F.array_position(F.zip_with(F.sequence(F.lit(0), F.lit(bands - 1)), F.sequence(F.lit(0), F.lit(bands - 1)), lambda i, _: F.slice("sa", i * width + 1, width) == F.slice("sb", i * width + 1, width)), F.lit(True)) - 1
    pairs = left.join(sorted_join(right), ["band", "key"]).where((F.col("a") < F.col("b")) & (first == F.col("band")))
    return pairs.select("a", "b", sketch_similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)


def clusters(sketches: DataFrame, name: str, least: float = 0.8) -> DataFrame:
    """(name, anchor, members) of all clusters with two or more members; the anchor is the smallest name."""
    named = cut(sketches.select(F.col(name).alias("name"), "sketch")).where("sketch is not null")  # sketches are made once, not for the test too
    representative = named.groupBy("sketch").agg(F.min("name").alias("representative"))
    members = named.join(sorted_join(representative), "sketch").select("name", "representative")
    joined = components(candidate_pairs(named, "name", least), "a", "b")
    rooted = members.join(sorted_join(joined), F.col("representative") == F.col("node"), "left").select("name", F.coalesce("component", "representative").alias("anchor"))
    sizes = rooted.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1")
    return rooted.join(sorted_join(sizes), "anchor").select("name", "anchor", "members")
