"""Join idioms: first match, as-of, band, longest prefix, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(build: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """One build row per key, the first in order; a map-side minimum instead of a window."""
    best = build.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in take if c not in order])).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in take))


def first_match_join(probe: DataFrame, build: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """Left join to the first build row of each key."""
    return probe.join(first_per_key(build, keys, order, take), keys, "left")


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, take: dict[str, str], tie: str) -> DataFrame:
    """Each left row with the last right row at or before it (within ``by``); of equal times the smallest ``tie``.

    One sort-based pass over the union of both sides, not a range join.
    """
    value = F.struct(*(F.col(c).alias(n) for c, n in take.items()))
    firsts = right.groupBy(by, at).agg(F.min(F.struct(F.col(tie).alias("_tie"), value.alias("_value"))).alias("_m"))
    both = left.select(by, at, F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(firsts.select("_m._value").schema[0].dataType).alias("_value")).unionByName(
        firsts.select(by, at, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"), F.col("_m._value").alias("_value")))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_left.*", *(F.col(f"_seen.{n}").alias(n) for n in take.values()))


def dotted_prefixes(key: Column) -> Column:
    """All dotted prefixes of a key, shortest first."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def longest_prefix_join(rows: DataFrame, key: str, rules: DataFrame, rule_key: str, take: str) -> DataFrame:
    """Left join to the rule with the longest dotted prefix of the key: distinct keys are exploded, not rows."""
    keys = rows.select(key).distinct().select(key, F.explode(dotted_prefixes(F.col(key))).alias(rule_key))
    best = keys.join(rules.select(rule_key, take), rule_key).groupBy(key).agg(F.max_by(take, F.length(rule_key)).alias(take))
    return rows.join(best, key, "left")


def nearest(rows: DataFrame, candidates: DataFrame, distance: Column, key: list[str], tie: list[str], take: list[str]) -> DataFrame:
    """Each key with its nearest candidate. Every row meets every candidate, which suits a dictionary: Spark broadcasts it
    while it is under its size limit, and else joins without, whatever its size."""
    pairs = rows.join(candidates, F.lit(True)).withColumn("_d", distance)
    best = pairs.groupBy(*key).agg(F.min(F.struct("_d", *tie, *[c for c in take if c not in tie])).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in take), F.col("_b._d").alias("distance"))
